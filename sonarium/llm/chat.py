"""Chat formatting with Spark expressions only: turns become one marked text with a loss mask, and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import let, prefix_sums

#: Characters of the chunks in which runs of a text are looked up.
CHUNK = 1024

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>"

#: Strings that a text must not contain as they are: this template's and those of other usual chat templates.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def _mask_of(control: str) -> str:
    return ("&lt;" if control[0] == "<" else "&lb;") + control[1:]


def escape(text: Column) -> Column:
    """Hide control strings; every ``&`` becomes ``&amp;``, so :func:`unescape` restores any text."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(_mask_of(control)))
    return out


def unescape(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def format_chats(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns (conv_id, turn, role, text)``: ``conv_id, formatted, mask``.

    Collected turns are sorted by turn (null first), role and text; neighbours of one role are merged into a block
    ``<|start|>role\\ntext<|next|>text<|end|>\\n``, which keeps where each turn ended. ``mask`` lists runs of characters
    ``(chars, loss)`` that cover ``formatted``: the texts of the ``learned`` role bear loss, markers and roles do not.

    Null role or text: empty. Null ``conv_id``: one conversation. Repeated rows are turns of their own. Empty table: no rows.
    A conversation becomes one text, so it must fit a row; many conversations, or equal ones, spread over the tasks.
    """
    rows = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t")
    )

    def blocks(t: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i).role != F.get(t, i - 1).role)
        )

        def block(b: Column) -> Column:
            return F.transform(
                b,
                lambda at, k: F.struct(
                    F.get(t, at).role.alias("role"),
                    F.transform(
                        F.slice(t, at + 1, F.coalesce(F.get(b, k + 1), F.size(t)) - at), lambda x: escape(x.text)
                    ).alias("texts"),
                ),
            )

        return let(begins, block)

    def piece(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    def runs(b: Column) -> Column:
        head = F.length(F.concat(F.lit(START), _escape_role(b.role), F.lit("\n")))
        inner = F.flatten(
            F.transform(
                b.texts,
                lambda x, k: F.array(
                    piece(F.when(k == 0, head).otherwise(len(NEXT)), F.lit(False)), piece(F.length(x), b.role == learned)
                ),
            )
        )
        return F.concat(inner, F.array(piece(F.lit(len(END) + 1), F.lit(False))))

    def text(b: Column) -> Column:
        return F.concat(F.lit(START), _escape_role(b.role), F.lit("\n"), F.array_join(b.texts, NEXT), F.lit(END + "\n"))

    merged = rows.select("conv_id", let(F.col("t"), blocks).alias("b"))
    return merged.select(
        "conv_id",
        F.array_join(F.transform("b", text), "").alias("formatted"),
        F.flatten(F.transform("b", runs)).alias("mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read ``conv_id, turns array<struct<role, text>>, learned array<string>`` back from the text and its mask.

    The turns come from the markers alone, the learned texts from the mask alone. A place of a text is found by counting its characters
    from the start, so the text is cut into chunks once and a run looks only into its own: work grows with the text and its turns.
    """

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, "\n", 1))
        body = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - len(END) - 1)
        return let(
            role,
            lambda r: F.transform(F.split(body, _literal(NEXT)), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))),
        )

    blocks = F.slice(F.split("formatted", _literal(START)), F.lit(2), F.size(F.split("formatted", _literal(START))))
    def learned(chunks: Column) -> Column:
        def cut(span: Column) -> Column:
            first, last = (F.floor(place / CHUNK).cast("int") for place in (span.at, span.at + span.chars))
            near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            return unescape(F.substr(near, (span.at % CHUNK + 1).cast("int"), span.chars.cast("int")))

        starts = prefix_sums(F.transform("mask", lambda run: run.chars))
        spans = let(starts, lambda at: F.transform("mask", lambda run, i: F.struct(F.get(at, i).alias("at"), run.chars.alias("chars"), run.loss.alias("loss"))))
        return F.transform(F.filter(spans, lambda span: span.loss), cut)

    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        let(F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), learned).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _literal(text: str) -> str:
    return text.replace("|", r"\|")


def chat_digests(read: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`read_chats` gives back."""
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""
    )
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
