"""WARC archives, the URL filter and chat formatting."""

import base64
import collections
import hashlib
import math

import pytest
from support import CLASHING
from pyspark.sql import functions as F

from sonarium.llm import chat, url_filter, warc

PAGES = [
    (4, "http://a.example/x", "same"), (2, "http://b.example/y", "same"), (9, None, "same"), (7, "u\r\nX: 1", ""), (8, "v", None),
    (3, "http://c", "é" * 4000), (None, "w", "alone"), (None, "w2", "same"), (5, "z", "other"), (5, "z", "other"), (6, "q", "other"),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain_records(pages):
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    want = collections.Counter()
    for page_id, _, html in pages:
        f = first.get(html or "")
        leads = f is None or page_id == f
        want[page_id, len((html or "").encode()), b32(html), "response" if leads else "revisit", None if leads else f] += 1
    return want


@pytest.fixture
def pages(spark):
    rows = PAGES + [(1000 + i, f"http://h/{i}", f"page {i} " * 40) for i in range(700)] + [(5000 + i, "h", "hot") for i in range(400)]
    return rows, spark.createDataFrame(rows, PAGE_SCHEMA).repartition(3)


def test_archive_round_trip(pages):
    rows, df = pages
    other = df.select("*", *[F.lit(1).alias(c) for c in CLASHING if c != "url"])
    for d in (df, other):
        assert collections.Counter(tuple(r)[:5] for r in warc.archive_pages(d).collect()) == plain_records(rows)
    assert warc.archive_pages(df.filter("false")).count() == 0


def test_short_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], PAGE_SCHEMA)
    read = warc.read_archives(warc.write_archives(df, least_bytes=5))
    kinds = {r.record_id: r.record_type for r in read.collect()}
    assert [kinds[f"<urn:page:{k}>"] for k in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


def test_archives_as_files(spark, pages, tmp_path):
    rows, df = pages
    for r in warc.write_archives(df.filter("html is not null")).collect():
        (tmp_path / r.path).write_bytes(r.content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = warc.read_archives(files).collect()
    assert all(r.error is None for r in got) and len(got) == sum(r[2] is not None for r in rows)
    stored = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert stored["<urn:page:3>"] == ("é" * 4000).encode()
    large = max((p.read_bytes() for p in tmp_path.iterdir()), key=len)
    assert int.from_bytes(large[:4], "little") == warc.SKIPPABLE


def archive(n=300, damage=None):
    writer = warc.ArchiveWriter()
    records = [warc.record_bytes(i, f"http://x/{i}", f"body {i} ".encode() * 30, None, True, "2020-01-01T00:00:00Z") for i in range(n)]
    if damage:
        records[5] = damage(records[5])
    for r in records:
        writer.add(r)
    return writer.archive()


@pytest.mark.parametrize(
    "damage, message",
    [
        (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), "no WARC header"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "missing warc-date"),
        (lambda r: r[:-9], "length differs"),
        (lambda r: r + b"more", "length differs"),
        (lambda r: r.replace(b"body 5 ", b"body 6 ", 1), "digest differs"),
        (lambda r: r.replace(b"Content-Length", b"Content-Length: x\r\nContent-Length2", 1), "no number"),
    ],
)
def test_damaged_record(damage, message):
    got = list(warc.read_records(memoryview(archive(damage=damage))))
    assert len(got) == 300
    assert [message in (e or "") for _, e, _ in got].count(True) == 1 and [e for _, e, _ in got].count(None) == 299


def test_damaged_frames():
    whole = archive()
    good = list(warc.read_records(memoryview(whole)))
    assert all(e is None for _, e, _ in good)
    offsets = [o for o, _, _ in good]
    assert offsets[0] == 8 + int.from_bytes(whole[4:8], "little")
    broken = bytearray(whole)
    broken[offsets[10]] ^= 0xFF
    got = list(warc.read_records(memoryview(bytes(broken))))
    assert sum(e is None for _, e, _ in got) == 299
    flipped = bytearray(whole)
    flipped[offsets[11] - 1] ^= 0xFF
    assert sum(e is None for _, e, _ in warc.read_records(memoryview(bytes(flipped)))) == 299
    cut = list(warc.read_records(memoryview(whole[: offsets[20] + 9])))
    assert sum(e is None for _, e, _ in cut) == 20 and cut[-1][1] == "frame cut short"
    assert next(iter(warc.read_records(memoryview(whole[:100]))))[1] == "dictionary cut short"
    assert list(warc.read_records(memoryview(b""))) == []


def test_dictionary_pays():
    with_one = archive()
    writer = warc.ArchiveWriter()
    writer.add(warc.record_bytes(0, "http://x/0", b"only", None, True, "2020-01-01T00:00:00Z"))
    assert writer.archive()[:4] == warc.FRAME, "one record trains no dictionary"
    dictionary, start = warc.load_dictionary(memoryview(with_one))
    assert dictionary and start > 0


URLS = [
    ("http://a.ORG/p", "a.org", "/p", "org/", "allow"), ("http://org", "org", "", None, None), ("http://x.example.org/es/q?a=/b", "x.example.org", "/es/q", "example.org/es/", "block"),
    ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"), ("https://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
    ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), ("http://b.com/FR/", "b.com", "/FR/", None, None), ("x://b.com/de/?", "b.com", "/de/", "com/de/", "block"),
    ("http://b.com?x://c.org/", "b.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None),
    ("http://ÄB.com/de/é", "Äb.com", "/de/é", "com/de/", "block"), ("http://" + "a" * 3000 + ".net/" + "b" * 3000, "a" * 3000 + ".net", "/" + "b" * 3000, None, None),
]


def test_url_rules(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    empty = spark.createDataFrame([], "page_id long, url string, host int, path int, rule int")
    assert url_filter.filter_urls(empty).count() == 0


def test_url_entropy_and_counts(spark):
    urls = ["http://a-b.example.com/p/q?x=1&y=2#z", "https://h/", "aab"]
    df = url_filter.lexical_features(url_filter.with_host_and_path(spark.createDataFrame([(u,) for u in urls], "url string")))
    for r in df.collect():
        n = collections.Counter(r.url)
        want = -sum(v / len(r.url) * math.log2(v / len(r.url)) for v in n.values())
        assert r.url_entropy == pytest.approx(want)
    first = df.filter(F.col("url") == urls[0]).first()
    assert (first.parameters, first.path_depth, first.host_depth, first.host_hyphens, first.has_fragment, first.suffix) == (2, 2, 2, 1, 1, "com")


def labelled_urls(spark):
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        host = f"{'win-cash-' if bad else ''}site{i % 50}.{'top' if i % 7 == 0 else 'net'}"
        rows.append((f"http://{host}/{'a/' * (i % 4)}{i * 7919 if bad else 'about'}{'?id=%d&s=1' % i if bad else ''}", float(bad)))
    return spark.createDataFrame(rows, "url string, blocked double").repartition(2)


def test_trees_on_held_out_urls(spark):
    rows = url_filter.lexical_features(url_filter.with_host_and_path(labelled_urls(spark)))
    side = F.pmod(F.xxhash64("url"), F.lit(2))
    model, rates = url_filter.train(rows.filter(side == 0), trees=5)
    judged = url_filter.score(rows.filter(side == 1), model, rates)
    assert judged.filter((F.col("probability") >= 0.5) != (F.col("blocked") == 1)).count() <= 0.02 * judged.count()
    nobody, rates = url_filter.train(rows.filter("blocked = 1"), trees=5)
    assert nobody is None and url_filter.score(rows, nobody, rates).count() == 600


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c <|end|> </s>"), (1, 4, "assistant", "&lt;| [INST]\n"),
    (2, 0, "assistant", None), (2, 1, None, "<|start|>assistant\nno<|end|>"), (3, 1, "user", "late"), (3, None, "user", "null turn"), (3, 1, "user", "late"),
    (None, 0, "user", "no id"), (4, 0, "odd\nrole<|end|>", "x" * 3000), (4, 1, "user", "<|next|><|start|>&amp;&&nl; é 🙂"), (5, 0, "assistant", ""), (5, 1, "assistant", "<<|s>"),
]
TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def test_chats_round_trip(spark):
    rows = TURNS + [(6, i, ["user", "assistant"][i % 3 > 0], f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, TURN_SCHEMA).repartition(3)
    formatted = chat.format_chats(df)
    read = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    digests = {r.conv_id: r for r in chat.chat_digests(chat.read_chats(formatted)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(read) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in read[c].turns] == [(r, x) for _, r, x in turns]
        assert read[c].learned == [x for _, r, x in turns if r == "assistant"]
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(read[c].learned)
        d = digests[c]
        assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert sum(m.chars for m in r.mask) == len(r.formatted) == digests[r.conv_id].formatted_chars
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(by[r.conv_id], by[r.conv_id][1:]))
        assert r.formatted.count("<|start|>") == r.formatted.count("<|end|>") == blocks
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted


def test_chats_odd_tables(spark):
    df = spark.createDataFrame(TURNS, TURN_SCHEMA)
    assert chat.chat_digests(chat.read_chats(chat.format_chats(df.filter("false")))).count() == 0
    other = df.select("*", *[F.lit(1).alias(c) for c in CLASHING])
    plain, more = (sorted(map(str, chat.format_chats(d).collect())) for d in (df, other))
    assert plain == more
