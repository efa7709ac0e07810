"""The result table at rest: appended parts, snapshots that replace them, and a key filter for each part."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType, IntegerType

from sonarium.functions.fixed import SHORT_TTL, TTL_BY_KIND
from sonarium.operators.results import latest_results, score_missing, visible_results

LOG_TYPE = StructType(
    [
        StructField("key", StringType()),
        StructField("payload", StringType()),
        StructField("written_at", TimestampType()),
        StructField("seq", LongType()),
        StructField("ttl_s", IntegerType()),
        StructField("model", StringType()),
    ]
)
PART_TYPE = StructType([*LOG_TYPE.fields, StructField("part", StringType())])

#: Keys of a part at most that has a filter, and of a snapshot's part on average.
PART_KEYS = 1_000_000
#: Keys of a lookup at most for which parts are tested; longer lists hit nearly every part anyway.
LOOKUP_KEYS = 1_000_000
BITS_PER_KEY = 10
PROBES = 7


def filter_bits(hashes: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit hashes: a power of two of bits, at least :data:`BITS_PER_KEY` for each."""
    bits = np.zeros(1 << max(6, int(np.ceil(np.log2(max(1, BITS_PER_KEY * len(hashes)))))), bool)
    for at in _places(hashes, len(bits)):
        bits[at] = True
    return np.packbits(bits)


def filter_hits(packed: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether any of the hashes can be in the filter."""
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(packed)):
        found &= (packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    return bool(found.any())


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    whole = hashes.astype(np.int64).view(np.uint64)
    first, step = whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step & np.uint64(bits - 1)).astype(np.int64)


class ResultLog:
    """Writes append parts; a read takes the last write per (model, key) that has not expired.

    ``parts/part=…/model=…`` holds the rows. A write makes a part of its own, visible once it is complete, and asks nobody. :meth:`compact` writes the
    last write of every key as a snapshot, cut by key into parts, and then a manifest that names the snapshot's parts and the parts it
    stands for; readers take the newest manifest and the parts written since. Manifests are only ever created, so of two compactions
    at a time one fails and changes nothing. :meth:`vacuum` deletes what no reader needs any more.

    ``filters/of=…`` holds a Bloom filter per part, so that a lookup of known keys reads only the parts that may hold one
    (:meth:`parts_for`). A part without filter is always read.
    """

    def __init__(self, spark: SparkSession, path: str, part_keys: int = PART_KEYS):
        self.spark, self.path, self.part_keys = spark, path.rstrip("/"), part_keys

    # --- files --------------------------------------------------------------------------------------------------------------

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def manifest(self) -> dict:
        """The newest manifest: ``version``, the snapshot's parts, and the parts it stands for."""
        names = self._names("manifests")
        if not names:
            return {"version": 0, "snapshot": [], "covered": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def parts(self) -> list[str]:
        """Parts a reader takes: the newest snapshot's and complete later ones."""
        now = self.manifest()
        covered = set(now["covered"])
        written = [n.removeprefix("part=") for n in self._names("parts") if n.startswith("part=delta-")]
        return now["snapshot"] + [p for p in written if p not in covered and self._exists(f"parts/part={p}/_SUCCESS")]

    # --- writing --------------------------------------------------------------------------------------------------------------

    def put(self, results: DataFrame, model: str, kind: str = "prediction", now: Column | None = None, seq: int = 0) -> None:
        """Append ``(key, payload)`` rows; ``seq`` orders writes of the same instant."""
        self.append(
            results.select(
                F.col("key").cast("string").alias("key"),
                F.col("payload").cast("string").alias("payload"),
                (now if now is not None else F.current_timestamp()).cast("timestamp").alias("written_at"),
                F.lit(seq).cast("long").alias("seq"),
                F.lit(TTL_BY_KIND.get(kind, SHORT_TTL)).cast("int").alias("ttl_s"),
                F.lit(model).alias("model"),
            )
        )

    def append(self, rows: DataFrame) -> None:
        """Append rows of the log's own columns, of any models."""
        part = f"delta-{uuid.uuid4().hex}"
        rows.select(*LOG_TYPE.names).write.partitionBy("model").parquet(f"{self.path}/parts/part={part}")
        self._add_filters(part, [part])

    def _add_filters(self, of: str, parts: list[str]) -> None:
        """Filters of parts with few enough keys, in one folder that goes with the parts."""
        rows = self.log(parts, keep_part=True).select("part", F.xxhash64("model", "key").alias("hash"))
        small = [r["part"] for r in rows.groupBy("part").count().collect() if r["count"] <= 2 * self.part_keys]
        if not small:
            return

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            packed = filter_bits(np.unique(rows["hash"].to_numpy()))
            return pd.DataFrame({"part": [key[0]], "bits": [packed.tobytes()]})

        # one task takes the hashes of one part, of which there are at most twice part_keys
        filters = rows.filter(F.col("part").isin(small)).groupBy("part").applyInPandas(build, "part string, bits binary")
        filters.write.parquet(f"{self.path}/filters/of={of}")

    def compact(self) -> int:
        """Replace all parts a reader takes now by a snapshot of the last write per key; returns its version.

        Expired writes stay, as they hide older ones that a late writer may still add. Keys are dealt to parts by hash, so every part has
        about ``part_keys`` rows at most whatever the keys are.
        """
        before, parts = self.manifest(), self.parts()
        version = before["version"] + 1
        log = self.log(parts)
        # by keys, not by writes: a key written a hundred times is one row of the snapshot
        buckets = max(1, -(-log.select("model", "key").distinct().count() // self.part_keys))
        tag = uuid.uuid4().hex[:8]
        part = F.concat(F.lit(f"snap-{version}-{tag}-"), F.pmod(F.xxhash64("model", "key"), F.lit(buckets)).cast("string"))
        last = latest_results(log).select(*LOG_TYPE.names).withColumn("part", part)
        last.repartition(buckets, "part").write.mode("append").partitionBy("part", "model").parquet(f"{self.path}/parts")
        new = [n.removeprefix("part=") for n in self._names("parts") if n.startswith(f"part=snap-{version}-{tag}-")]
        self._add_filters(f"snap-{version}-{tag}", new)
        covered = sorted({p for p in before["covered"] + parts if self._exists(f"parts/part={p}")})
        fs, path = self._fs(f"manifests/{version:020d}.json")
        out = fs.create(path, False)  # an error if another compaction was first
        out.write(json.dumps({"version": version, "snapshot": new, "covered": covered}).encode())
        out.close()
        return version

    def vacuum(self) -> int:
        """Delete the parts the newest manifest does without, and their filters; no reader may still use an older one. Returns their number."""
        now = self.manifest()
        keep = set(self.parts())
        gone = [p for p in (n.removeprefix("part=") for n in self._names("parts") if n.startswith("part=")) if p not in keep and (p in now["covered"] or p.startswith("snap-"))]
        for p in gone:
            self._delete(f"parts/part={p}")
        held = {p if p.startswith("delta-") else p.rsplit("-", 1)[0] for p in self.parts()}
        for n in self._names("filters"):
            if n.removeprefix("of=") not in held:
                self._delete(f"filters/{n}")
        return len(gone)

    # --- reading ----------------------------------------------------------------------------------------------------------------

    def log(self, parts: list[str] | None = None, keep_part: bool = False) -> DataFrame:
        """The writes in ``parts``, by default all a reader takes; none before the first."""
        parts = self.parts() if parts is None else parts
        if not parts:
            rows = self.spark.createDataFrame([], PART_TYPE)
        else:
            reader = self.spark.read.schema(PART_TYPE).option("basePath", f"{self.path}/parts")
            rows = reader.parquet(*[f"{self.path}/parts/part={p}" for p in parts])
        return rows.select(*LOG_TYPE.names, *(["part"] if keep_part else []))

    def parts_for(self, model: str, keys: DataFrame, key: str = "key") -> list[str]:
        """Parts that may hold a result of ``model`` for one of ``keys``, by their filters.

        Up to :data:`LOOKUP_KEYS` distinct keys are hashed and sent to the filters; with more, all parts are returned.
        """
        parts = self.parts()
        hashed = keys.select(F.xxhash64(F.lit(model), F.col(key).cast("string")).alias("h")).distinct()
        wanted = hashed.limit(LOOKUP_KEYS + 1).toPandas()["h"].to_numpy(np.int64)
        folders = {p if p.startswith("delta-") else p.rsplit("-", 1)[0] for p in parts}
        there = sorted(folders & {n.removeprefix("of=") for n in self._names("filters")})
        if len(wanted) > LOOKUP_KEYS or not there:
            return parts

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [filter_hits(np.frombuffer(b.as_py(), np.uint8), wanted) for b in batch.column("bits")]
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(hits, pa.bool_())], ["part", "hit"])

        filters = self.spark.read.schema("part string, bits binary").parquet(*[f"{self.path}/filters/of={f}" for f in there])
        seen = {r["part"]: r["hit"] for r in filters.mapInArrow(probe, "part string, hit boolean").collect()}
        return [p for p in parts if seen.get(p, True)]

    def get(self, model: str, now: Column | None = None, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
        """Visible results of one model; the partition filter reaches the scan.

        With ``keys`` only parts that may hold one of them are read. The results then cover those keys, and may hold others too.
        """
        at = (now if now is not None else F.current_timestamp()).cast("timestamp")
        parts = None if keys is None else self.parts_for(model, keys, key)
        return visible_results(self.log(parts).filter(F.col("model") == model), at)

    def score(
        self, files: DataFrame, key: str, model: str, make_predict: Callable, features: Sequence[str],
        input_shapes: list | None = None, now: Column | None = None, seq: int = 0,
    ) -> DataFrame:
        """Score the files the log lacks, append their results, and return the score of every file.

        A file the model fails on is not stored: its score is null here, and the next call tries it again.
        """
        typed = files.withColumn(key, F.col(key).cast("string"))
        held = self.get(model, now, typed, key).select(F.col("key").alias(key), F.col("payload").cast("double").alias("score"))
        fresh = score_missing(typed, held, key, make_predict, features, "score", DoubleType(), input_shapes=input_shapes)
        new = fresh.filter(~F.col("from_cache") & F.col("score").isNotNull()).select(F.col(key).alias("key"), F.col("score").alias("payload"))
        self.put(new, model, now=now, seq=seq)
        stored = self.get(model, now, typed, key).select(F.col("key").alias(key), F.col("payload").cast("double").alias("score"))
        return typed.select(key).join(stored, key, "left")
