"""Operators on documents against plain versions, with nulls, odd texts, repeated rows, empty tables and clashing columns."""

import random
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from support import prose, words
from pyspark.sql import functions as F

from sonarium.llm import common, mixing, near_dups, packing, quality, secrets, shards
from sonarium.llm.media import text_media
from sonarium.llm.queries import TOKENIZER


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "media": text_media,
    "near": lambda d: near_dups.near_duplicates(d, 85),
    "mix": mixing.mixed_documents,
    "shards": shards.shard_documents,
    "quality": quality.judge,
    "pack": lambda d: packing.pack_documents(d, TOKENIZER),
    "secrets": secrets.scan_secrets,
}
STAGES = {"good": quality.keep_good, "single": near_dups.without_near_duplicates, "masked": secrets.remove_secrets, "drawn": mixing.draw_mix}


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_empty_table(docs, name):
    assert (OPERATORS | STAGES)[name](docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_clashing_columns_change_nothing(docs, crowded, name):
    run = (OPERATORS | STAGES)[name]
    plain, other = run(docs), run(crowded)
    if name == "shards":  # which of two equal rows comes first is open
        plain, other = (d.groupBy("shard").count() for d in (plain, other))
    if name in ("pack", "quality"):
        plain, other = (d.drop("sequence_id", "offset", "start", "length", "ids_crc32", "distance2") for d in (plain, other))
    assert rows_of(plain.distinct()) == rows_of(other.select(plain.columns).distinct())


def test_media(docs, corpus):
    got = collections.Counter(
        (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in text_media(docs).collect()
    )
    want = collections.Counter()
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert got == want
    by_text = collections.defaultdict(set)
    for r in text_media(docs).collect():
        by_text[r.payload_sha256].add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())


def shingles(text, width=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_components(rows, percent):
    """Smallest id reachable for each row; ids may repeat or be missing."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            label[find(j)] = find(i)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    smallest = {k: min((v for v in ids if v is not None), default=None) for k, ids in members.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, corpus, percent):
    want = plain_components([(r[0], r[1]) for r in corpus], percent)
    want = collections.Counter((d, n, c, c is None or d == c) for d, n, c in want)
    got = near_dups.near_duplicates(docs, percent)
    assert collections.Counter(map(tuple, got.collect())) == want


def test_near_duplicates_beyond_the_centres(spark):
    """Two families in common tables, linked neither to the smallest node nor to each other, and a chain."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for family in range(3):
        stem = list(base)
        for k in range(0, 200, 40):
            stem[k + family] = f"f{family}"
        for copy in range(6):
            text = list(stem)
            text[100 + copy] = f"c{family}{copy}"
            rows.append((len(rows) * 7 % 31, " ".join(text)))
    chain = list(base[:100])
    for k in range(12):
        chain[k * 8] = f"z{k}"
        rows.append((100 + k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(df, 85).collect()}
    assert got == {d: c for d, _, c in plain_components(rows, 85)}


def test_single_representatives(docs, corpus):
    left = near_dups.without_near_duplicates(docs, 80)
    assert left.columns == docs.columns
    rows = [(r[0], r[1]) for r in corpus]
    filled = plain_components(rows, 80)
    groups = {c if n else ("empty", d, t) for (d, n, c), (_, t) in zip(filled, rows)}
    assert left.count() == len(groups)


def test_tables_follow_from_the_threshold():
    for percent in (50, 80, 85, 99, 100):
        m = near_dups.root_tables(percent)
        assert 1 - (1 - (1 - (percent / 100) ** 2) ** m) ** 2 <= 1e-6


def water_level(sizes, weights, most):
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return {s: most * sizes[s] for s in sizes}
        level = (sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        new = {s for s in free if weights[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= new


def test_mix(docs, corpus):
    size = collections.Counter()
    for _, text, _, source, _ in corpus:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s))
    target = water_level(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    assert any(abs(target[s] - 3 * size[s]) < 1e-9 for s in size) and any(target[s] < 3 * size[s] - 1 for s in size)
    source_of = collections.defaultdict(set)
    for doc_id, text, _, source, _ in corpus:
        source_of[doc_id, len(words(text))].add(source)
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == len(corpus)
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size
        if r.size:
            (source,) = source_of[r.doc_id, r.size]
            assert r.source_size == size[source] and r.target == pytest.approx(target[source], rel=1e-12)
            taken[source] += r.taken
    assert all(taken[s] == int(target[s] + 0.5) for s in size)
    assert rows_of(mixing.mixed_documents(docs.repartition(5))) == sorted(map(tuple, got), key=repr)


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 6400.0), ("b", 3200.0), ("c", 640.0), ("d", 0.0)], "key string, target double")
    slots = sorted(map(tuple, mixing.schedule(targets, 64).collect()))
    assert collections.Counter(k for _, k, _ in slots) == {"a": 100, "b": 50, "c": 10}
    for key in "abc":
        ranks = [r for _, k, r in slots if k == key]
        assert ranks == list(range(len(ranks)))
    head = collections.Counter(k for s, k, _ in slots if s < 80)
    assert abs(head["a"] - 50) <= 2 and abs(head["b"] - 25) <= 2 and abs(head["c"] - 5) <= 2


def test_drawn_texts(docs, corpus):
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns
    texts = collections.defaultdict(set)
    for doc_id, text, *_ in corpus:
        texts[doc_id].add(text)
    got = drawn.collect()
    for r in got:
        whole = [t for t in texts[r.doc_id] if t and (t == r.text or t.lstrip("\t\n\x0b\x0c\r ").startswith(r.text.strip()))]
        assert whole and r.n_chars == len(r.text)
        assert words(whole[0])[: len(words(r.text))] == words(r.text)
    total = sum(len(words(t)) for _, t, *_ in corpus)
    assert abs(sum(len(words(r.text)) for r in got) - total) <= len({r[3] for r in corpus})


def test_every_prefix_of_the_mix_has_the_weights(spark):
    """The ordered corpus: after any number of rows no source is farther from its share than the longest texts and a few blocks."""
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 150)), "en", f"s{min(i % 9, 3)}", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    drawn = mixing.draw_mix(df, ordered=True).collect()
    share = {}
    for r in mixing.mixed_documents(df.select("doc_id", "text", "source")).collect():
        share[f"s{min(r.doc_id % 9, 3)}"] = r.target
        assert (r.first_slot is None) == (r.taken == 0) and r.slots >= r.taken / mixing.BLOCK_WORDS
    whole, taken, sofar = sum(share.values()), collections.Counter(), 0
    for r in drawn:
        n = len(words(r.text))
        taken[r.source] += n
        sofar += n
        assert all(abs(taken[s] - share[s] / whole * sofar) <= 150 * len(share) + 8 * mixing.BLOCK_WORDS for s in share)
    assert sofar > 100_000 and collections.Counter(r.doc_id for r in drawn) == collections.Counter(r.doc_id for r in mixing.draw_mix(df).collect())


def test_first_words(spark):
    text = " \n one  two\tthree "
    df = spark.createDataFrame([(text, n) for n in range(1, 5)], "t string, n long")
    got = [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert [words(g) for g in got] == [["one"], ["one", "two"], ["one", "two", "three"], ["one", "two", "three"]]


def test_shards(docs, corpus):
    got = shards.shard_documents(docs).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_shards_keep_links_together(spark):
    rows = [(i, f"group {i // 5}" if i < 400 else ("hot" if i < 700 else f"single {i}")) for i in range(1000)]
    got = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    homes = collections.defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    split = sum(len(v) > 1 for k, v in homes.items() if k.startswith("group"))
    assert split <= 4, "of 80 small groups"
    assert len(homes["hot"]) <= 12


def plain_statistics(text):
    text = text or ""
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(spark, docs, corpus):
    got = quality.judge(docs).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == collections.Counter((d, *plain_statistics(t)) for d, t, *_ in corpus)
    assert all(not (r.kept and r.base_failed) for r in got)
    loops = ["a b c d e f g h a b c d e f g h", "x " * 30, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0", "l\nl\n \n \nl x\n<b>|"]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(loops)], "doc_id long, text string, lang string, source string")
    assert rows_of(quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == [
        (k, *plain_statistics(t)) for k, t in enumerate(loops)
    ]


def plain_mcd(x, floors, half, steps):
    """The same estimate with numpy, exact quantiles in place of sketches."""

    def rank(v, q):
        return np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]

    centre = np.array([rank(c, 0.5) for c in x.T])
    scale = np.maximum([(rank(c, 0.75) - rank(c, 0.25)) / 1.349 for c in x.T], floors)
    inverse = np.diag(1 / scale**2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        near = x[d <= rank(d, half)]
        centre = near.mean(axis=0)
        inverse = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(floors**2))
    d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    return d / max(rank(d, 0.5) / quality.chi_square(x.shape[1], 0.0), 1.0)


def test_outliers(spark):
    rng = np.random.default_rng(3)
    rows = []
    for lang, shift in (("en", 0), ("de", 1)):
        for i in range(400):
            n = int(rng.integers(30, 300))
            text = " ".join("".join(rng.choice(list("abcdefgh"), 3 + shift + rng.integers(0, 3))) for _ in range(n))
            if i < 40:
                text = text.replace(" ", "### ")
            rows.append((len(rows), text, lang, "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    z = quality.text_statistics(df).select("doc_id", "lang", *[c.alias(n) for n, c in quality._features().items()]).toPandas()
    got = quality.judge(df).toPandas().set_index("doc_id")
    floors = np.array(list(quality.FLOORS.values()))
    for _, part in z.groupby("lang"):
        want = plain_mcd(part[list(quality.FEATURES)].to_numpy(), floors, 0.75, 4)
        assert np.allclose(got.loc[part.doc_id, "distance2"], want, rtol=1e-3)
    junk = {r[0] for r in rows if "###" in r[1]}
    rejected = set(got.index[~got.kept & ~got.base_failed])
    assert junk == rejected


def test_pack_round_trip(docs, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = packing.pack_documents(docs, TOKENIZER).collect()
    want = collections.Counter()
    ids_of = collections.defaultdict(list)
    for doc_id, text, *_ in corpus:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids)] += len(ids)
        ids_of[doc_id, len(ids)].append(ids)
    have = collections.Counter()
    places = collections.defaultdict(list)
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        crcs = {zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) for i in ids_of[r.doc_id, r.doc_tokens]}
        assert r.ids_crc32 in crcs
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for pieces in places.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    tokens = sum(have.values())
    assert len(places) <= tokens / 2048 + docs.rdd.getNumPartitions() + 1


def test_encoder_cuts_nothing(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 40)
    encoder = packing.Encoder(TOKENIZER)
    texts = ["a b", " lead", "trail ", "two  blanks\tand\n\nlines  ", "it's we'll 12 34", " x  y z\x1c q \x85 r", "w" * 90 + " v", "x y " * 60]
    texts.append("don 't stop <|endoftext|> now " * 9 + "émile ñandú 你好 世界 🙂 🙂")
    for text in texts:
        assert b"".join(encoder.parts(text)) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_vector_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(t), int(t * rng.random())) for i, t in enumerate(rng.integers(1, 700, 900))] + [(900, 5000, 10), (901, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens long, loss long").repartition(2)
    got = packing.pack(df, "id", "tokens", "loss", max_tokens=2048, max_segments=6, max_loss=1200).collect()
    assert sorted(r.id for r in got) == [r[0] for r in rows]
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        sums[r.sequence_id] = [a + b for a, b in zip(sums[r.sequence_id], (r.tokens, 1, r.loss))]
    assert sum(t > 2048 or s > 6 or x > 1200 for t, s, x in sums.values()) == 1
    assert len(sums) <= 1.2 * max(sum(r[1] or 0 for r in rows[:900]) / 2048, len(rows) / 6, sum(r[2] or 0 for r in rows) / 1200) + 3


def secret_rows():
    rng = np.random.default_rng(9)
    rows, planted = [], {}
    for i in range(400):
        w = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(40)]
        w[7] = "".join(rng.choice(list("etaoinshr"), 22))
        if i % 4 == 0:
            value = "".join(rng.choice(list("0123456789abcdef"), 40))
            planted[i] = value
            w[20] = f'{["token", "api_key", "password"][i % 3]} = "{value}"'
        if i % 5 == 0:
            w[30] = "".join(rng.choice(list("0123456789"), 16))
        rows.append((i, " ".join(w), "src/a.txt" if i % 2 else None))
    return rows, planted


def test_secrets(spark):
    rows, planted = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan_secrets(df).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert hashlib.sha256(text[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.candidate_sha256
    want = {(i, m.start(), len(m[0])) for i, t, _ in rows for m in re.finditer(r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,}", t)}
    assert {(r.doc_id, r.start, r.length) for r in got} == want
    found = {(r.doc_id, text[r.doc_id][r.start : r.start + r.length]) for r in got if r.is_secret}
    assert found == set(planted.items())
    clean = {r.doc_id: r.text for r in secrets.remove_secrets(df).collect()}
    assert clean == {i: t.replace(planted[i], secrets.MASK) if i in planted else t for i, t in text.items()}


def test_forest_on_held_out_findings(spark):
    """Trained on half of the findings with given labels, the forest tells the other half apart."""
    rows, planted = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = secrets.candidates(secrets._nodes(df, "source"))
    known = known.withColumn("secret", F.col("candidate").isin([*planted.values()]).cast("double"))
    half = known.filter(F.col("node.d") % 2 == 0)
    judged = secrets.judge_candidates(df, labelled=half).filter(F.col("node.d") % 2 == 1)
    assert judged.filter(F.col("is_secret") != F.col("candidate").isin([*planted.values()])).count() <= 0.02 * judged.count()


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.unionByName(spark.range(5).select((F.col("id") + 1000).alias("a"), (F.col("id") + 1000).alias("b")))
    assert {tuple(r) for r in common.components(links).collect()} == {(i, 0) for i in range(n)}


def test_attach_hot_keys(spark):
    rows = [("h" if i % 3 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, i long").cache()
    side = df.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.min("i").alias("least"))
    got = common.attach(df, side.filter("key != 'k0'"), ["key"]).collect()
    assert len(got) == 3000 and all(r.least == (None if r.key == "k0" else 1 if r.key == "h" else r.i) for r in got)


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_running_sums(spark, bits):
    rows = [("a" if i % 4 else "b", i, (i * 7919) % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, w long").withColumn("h", F.xxhash64("i"))
    got = common.running(df, "g", "h", ["i"], F.col("w"), "before", bits).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.h & ((1 << 64) - 1)) if bits else r.h):
            if bits:
                continue
            assert r.before == total
            total += r.w
        spans = sorted((r.before, r.before + r.w) for r in got if r.g == g)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
