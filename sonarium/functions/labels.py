"""Label probability expressions; row-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return F.transform(e, lambda x: x / total)

    def exps(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp(x.cast("double") - top))

    # one-element transforms bind the maximum and the exponentials once per row
    peak = F.transform(F.array(F.array_max(logits).cast("double")), exps)
    return F.transform(peak, shares)[0]


def label_names(n: Column, id2label: Sequence[str], missing: str) -> Column:
    """Label per class index; an index without a name becomes ``missing`` + index."""
    known = F.array(*[F.lit(x) for x in id2label])
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(known, i), F.concat(F.lit(missing), i.cast("string")))
    )


def probability_map(probs: Column, id2label: Sequence[str]) -> Column:
    return F.map_from_arrays(label_names(F.size(probs), id2label, "emotion_"), probs)


def top_index(probs: Column) -> Column:
    """Index of the largest probability, the lowest one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def top_label(probs: Column, id2label: Sequence[str]) -> Column:
    return F.get(label_names(F.size(probs), id2label, ""), top_index(probs))
