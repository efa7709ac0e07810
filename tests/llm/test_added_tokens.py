"""Texts that hold the tokenizer file's added tokens get the ids of the file's own library at its defaults."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from sonarium.llm import packing
from sonarium.llm.queries import TOKENIZER, op8_pack_documents

END = "<|endoftext|>"
TEXTS = [
    f"a {END} b", END, f"{END}{END} x", f"one  {END}  two\n\n{END}", f"x{END}y", "a <|endoftext| > b", "plain text", "", f"é {END}你好 <|endof{END}"
]


def ids(text):
    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(monkeypatch):
    assert ids(TEXTS[0]) == [64, 220, 50256, 275]
    for chars in (packing.SEGMENT_CHARS, 4):
        monkeypatch.setattr(packing, "SEGMENT_CHARS", chars)
        encoder = packing.Encoder(TOKENIZER, added=True)
        for text in [*TEXTS, " and ".join(TEXTS) * 3]:
            assert b"".join(encoder.parts(text)) == np.array(ids(text), "<u4").tobytes(), text


def test_query_gives_the_ids_of_the_file(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in op8_pack_documents(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        whole = [*ids(text), 1]
        assert got[i] == (0, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()), len(whole))
