"""Registered queries with SQL against it, and the pipeline's stages against plain versions."""

import collections
import re

import oracle
import pytest
from support import words

import corpus_pipeline
from sonarium.llm import mixing, near_dups, quality, secrets
from sonarium.llm.queries import ORACLES, QUERIES
from test_documents import plain_components, plain_statistics

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) is None


def test_pipeline_against_plain_steps(spark, docs, corpus, tmp_path):
    """Each stage over what its predecessor kept, compared with a plain pass over the same rows."""
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    now = spark.read.parquet(path)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        held[name] = before, now.collect()
        if name != "pack":
            assert sorted(now.columns) == sorted(docs.columns)
    before, after = held["quality_rules"]
    judged = quality.judge(spark.createDataFrame(before, docs.schema)).collect()
    assert collections.Counter(r.doc_id for r in after) == collections.Counter(r.doc_id for r in judged if r.kept)
    assert all(not plain_statistics(r.text)[-1] for r in after)
    before, after = held["near_dedup"]
    groups = collections.defaultdict(set)
    for r, (_, _, component) in zip(before, plain_components([(r.doc_id, r.text) for r in before], 80)):
        groups[component].add((r.doc_id, r.text))
    assert len(after) == len(groups) and all(sum((r.doc_id, r.text) in g for r in after) == 1 for g in groups.values())
    before, after = held["secret_scan"]
    assert {(r.doc_id, re.sub(re.escape(secrets.MASK), "", r.text)) for r in after} >= {
        (r.doc_id, r.text) for r in before if not re.search(r"[A-Za-z0-9+/_=\-]{16}", r.text)
    }
    assert len(after) == len(before)
    before, after = held["mix_sources"]
    taken = collections.Counter()
    for r in mixing.mixed_documents(spark.createDataFrame(before, docs.schema)).collect():
        taken[r.doc_id] += r.taken
    drawn = collections.Counter()
    for r in after:
        drawn[r.doc_id] += len(words(r.text))
    assert drawn == +taken
    before, after = held["pack"]
    assert sum(r.length for r in after) == sum({(r.doc_id, r.doc_tokens, k): r.doc_tokens for k, r in enumerate(after) if r.start == 0}.values())


def test_pipeline_on_no_documents(spark, docs, tmp_path):
    docs.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert near_dups.near_duplicates(docs.filter("false")).count() == 0
