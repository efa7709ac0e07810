"""Conversations of very many turns: read back whole, in time that grows with their length."""

import time

from pyspark.sql import functions as F

from sonarium.llm import chat
from sonarium.llm.common import prefix_sums


def turns_of(n):
    texts = ["é🙂<|end|> &lt; ", "", "x" * 1500, "[INST]\n"]
    return [(9, i, ["user", "assistant"][i % 3 > 0], f"{texts[i % 4] if i % 50 < 4 else 't'}{i}") for i in range(n)]


def test_prefix_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.createDataFrame([([3 * k % 7 for k in range(n)],)], "v array<long>").select(prefix_sums(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(3 * k % 7 for k in range(i)) for i in range(n)]


def test_chat_of_many_turns(spark):
    spent = []
    for n in (5_000, 50_000):
        rows = turns_of(n)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        start = time.time()
        read = chat.read_chats(chat.format_chats(df)).first()
        spent.append(time.time() - start)
        assert [tuple(t) for t in read.turns] == [(r, x) for _, _, r, x in rows]
        assert read.learned == [x for _, _, r, x in rows if r == "assistant"]
    assert spent[1] < 40 * spent[0] + 10, spent
    print("seconds", spent)
