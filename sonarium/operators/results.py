"""The result table as an append-only log, and scoring of what it does not hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from sonarium.functions.fixed import SHORT_TTL, TTL_BY_KIND
from sonarium.functions.rows import literal_map

# Names of scoring functions a caller may register: name -> function that loads a model and returns its batch function.
MODELS: dict[str, Callable] = {}


def register_model(name: str, make_predict: Callable) -> None:
    MODELS[name] = make_predict


def ttl_seconds(kind: Column) -> Column:
    """Lifetime of a result by its kind; unknown kinds live the short time."""
    ttls = literal_map({k: str(v) for k, v in TTL_BY_KIND.items()})
    return F.coalesce(F.try_element_at(ttls, kind).cast("int"), F.lit(SHORT_TTL))


def latest_results(log: DataFrame, keys: Sequence[str] = ("model", "key"), order: Sequence[str] = ("written_at", "seq")) -> DataFrame:
    """Last write per key. A maximum combines on the map side, so a key written very often is no hot spot."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_w")
    return log.groupBy(*keys).agg(newest).select(*keys, "_w.*")


def visible_results(
    log: DataFrame, now: Column, keys: Sequence[str] = ("model", "key"), order: Sequence[str] = ("written_at", "seq"),
    ttl: str = "ttl_s",
) -> DataFrame:
    """Results that can be read at ``now``: the last write per key, while now < written_at + ttl.

    A last write that has expired hides older ones. The lifetime is the writer's and may be of any length.
    """
    current = latest_results(log, keys, order)
    return current.filter(now < F.col("written_at") + F.make_interval(secs=F.col(ttl)))


def strip_heavy_column(results: DataFrame, column: str) -> DataFrame:
    """The column is not stored."""
    return results.withColumn(column, F.lit(None).cast(results.schema[column].dataType))


def usable_results(results: DataFrame, column: str, wanted: bool) -> DataFrame:
    """A stored row without the heavy column is a miss when the column is asked for."""
    return results.filter(F.col(column).isNotNull()) if wanted else results


def _forgiving(make: Callable) -> Callable:
    """A batch function that gives NaN for the rows the model fails on; a failing batch is tried again row by row."""

    def build() -> Callable:
        predict = make()

        def safe(*inputs: np.ndarray) -> np.ndarray:
            try:
                return predict(*inputs)
            except Exception:
                scores = []
                for k in range(len(inputs[0])):
                    try:
                        scores.append(float(predict(*[x[k : k + 1] for x in inputs])[0]))
                    except Exception:
                        scores.append(float("nan"))
                return np.array(scores)

        return safe

    return build


def score(df: DataFrame, model: str | Callable, features: Sequence[str], out: str, out_type: DataType, batch: int = 1024,
          input_shapes: list | None = None) -> DataFrame:
    """Score rows in Arrow batches; the model is loaded once per Python worker.

    With a double result a row the model fails on gets null and the rest go on.
    """
    make = MODELS[model] if isinstance(model, str) else model
    single = isinstance(out_type, DoubleType)
    predict = predict_batch_udf(
        _forgiving(make) if single else make, return_type=out_type, batch_size=batch, input_tensor_shapes=input_shapes
    )
    scored = df.withColumn(out, predict(*[F.col(f) for f in features]))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out))) if single else scored


def score_or_error(
    df: DataFrame, model: str | Callable, features: Sequence[str], out: str, out_type: DataType, error: str = "error"
) -> DataFrame:
    """Score rows in Arrow batches and keep the model's own error text of each row it fails on.

    A failing batch is tried again row by row, so a bad row costs only itself; its ``out`` is null. A model that cannot be loaded gives
    its error to every row. Rows without an error have a null ``error``; an exception without a text gives its name. Scores that are NaN
    are kept as the model gave them.
    """
    make = MODELS[model] if isinstance(model, str) else model

    def told(e: Exception) -> str:
        return str(e) or type(e).__name__

    @F.pandas_udf(StructType([StructField("out", out_type), StructField("error", StringType())]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        try:
            predict, broken = make(), None
        except Exception as e:
            predict, broken = None, told(e)

        def attempt(inputs: list[np.ndarray]) -> tuple[list, list]:
            n = len(inputs[0])
            if broken is not None:
                return [None] * n, [broken] * n
            try:
                return list(predict(*inputs)), [None] * n
            except Exception as e:
                if n == 1:
                    return [None], [told(e)]
            each = [attempt([x[k : k + 1] for x in inputs]) for k in range(n)]
            return [s for scores, _ in each for s in scores], [t for _, texts in each for t in texts]

        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            scores, texts = attempt([c.to_numpy() for c in columns]) if len(columns[0]) else ([], [])
            yield pd.DataFrame({"out": pd.Series(scores, dtype=object), "error": pd.Series(texts, dtype=object)})

    scored = df.withColumn("_scored", run(*[F.col(f) for f in features]))
    return scored.withColumns({out: F.col("_scored.out"), error: F.col("_scored.error")}).drop("_scored")


def score_missing(
    df: DataFrame, results: DataFrame, key: str, model: str | Callable, features: Sequence[str], out: str, out_type: DataType,
    batch: int = 1024, input_shapes: list | None = None, no_cache: bool = False,
) -> DataFrame:
    """All rows with their score and ``from_cache``; only rows the result table lacks reach the model.

    Append ``filter(~from_cache)`` of the result to the log to store the new scores. Rows the model cannot score carry a
    null score.
    """
    kept = [key, out, "from_cache"]
    if no_cache:
        fresh, held = df, None
    else:
        fresh = df.join(results.select(key), key, "left_anti")
        held = df.select(key).join(results.select(key, out), key).withColumn("from_cache", F.lit(True)).select(*kept)
    scored = (
        score(fresh, model, features, out, out_type, batch, input_shapes)
        .withColumn("from_cache", F.lit(False))
        .select(*kept)
    )
    return scored if held is None else held.unionByName(scored)


def progress(files: DataFrame, results: DataFrame, key: str, failed: Column) -> DataFrame:
    """Number of files per status: done, error or idle, with the share of all files."""
    marked = files.join(results.select(key, failed.alias("_bad")), key, "left").select(
        F.when(F.col("_bad").isNull(), "idle").when(F.col("_bad"), "error").otherwise("done").alias("status")
    )
    counts = marked.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    total = counts.agg(F.sum("files"))
    return counts.withColumn("share", F.col("files") / total.scalar())
