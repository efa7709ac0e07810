"""Row-level expressions of the catalog and table views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarium.functions.fixed import (
    DATASET_ALIASES,
    FEATURE_CLASS_TEXTS,
    FEATURE_DEFAULT_TEXT,
    FEATURE_EMPTY_TEXT,
    FEATURE_TEXTS,
    MEDIA_TYPES,
    NAME_LABELS,
    ORDINALS,
    PREDICTION_FIELDS,
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def first_nonempty(*cols: Column, default: str | None = None) -> Column:
    """First value that is neither null nor the empty string."""
    filled = [F.nullif(c.cast("string"), F.lit("")) for c in cols]
    return F.coalesce(*filled, F.lit(default))


def prediction_text(payload: Column) -> Column:
    """A plain string as it is; of a JSON object the first filled known field, otherwise the JSON text."""
    is_object = F.ltrim(payload).startswith("{")
    fields = [F.nullif(F.get_json_object(payload, f"$.{name}"), F.lit("")) for name in PREDICTION_FIELDS]
    return F.when(is_object, F.coalesce(*fields, payload)).otherwise(payload)


def file_name(path: Column) -> Column:
    """Last piece of a path, with either slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def row_id(candidates: Sequence[Column], ordinal: Column) -> Column:
    """First filled identifier, otherwise the row's ordinal."""
    return first_nonempty(*candidates, ordinal.cast("string"))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def media_type(path: Column) -> Column:
    """Media type by extension, null for a file that is not accepted."""
    return F.try_element_at(literal_map(MEDIA_TYPES), extension(path))


def human_size(size: Column) -> Column:
    """Size in Bytes, KB, MB or GB, 1024-based, at most two decimals."""
    power = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    value = F.round(size / F.pow(F.lit(1024.0), power), 2)
    number = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")]), power + 1)
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(F.concat_ws(" ", number, unit))


def dataset_ref(name: Column) -> Column:
    """struct(kind, session_id, dataset). ``custom:{session}:{name}`` keeps further colons in the name."""
    parts = F.split(name, ":", 3)
    custom = name.startswith("custom:")
    lowered = F.lower(name)
    known = F.coalesce(F.try_element_at(literal_map(DATASET_ALIASES), lowered), lowered)
    bad = custom & (F.size(parts) != 3)
    return F.struct(
        F.when(bad, F.lit("invalid")).when(custom, F.lit("custom")).otherwise(F.lit("global")).alias("kind"),
        F.when(custom & ~bad, F.get(parts, F.lit(1))).alias("session_id"),
        F.when(bad, F.lit(None)).when(custom, F.get(parts, F.lit(2))).otherwise(known).alias("dataset"),
    )


def contains_any_case(cols: Sequence[Column], needle: str) -> Column:
    """True where any column contains the text, in any case; an empty text matches every row."""
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(needle.lower())), F.lit(False))
    return hit


def truth_applicable(model: Column, dataset: Column) -> Column:
    """Which ground truth a model can be compared with."""
    return (
        F.when(model.startswith("whisper"), dataset == "common-voice")
        .when(model == "wav2vec2", dataset == "ravdess")
        .otherwise(F.lit(False))
    )


def intensity_bucket(x: Column) -> Column:
    return F.when(x > 0.7, "high").when(x > 0.4, "medium").otherwise("low")


def label_from_filename(name: Column) -> Column:
    """Ordered ladder of marks in the lower-cased name, null if none is found; the first mark wins."""
    lowered = F.lower(name)
    label = F.lit(None).cast("string")
    for value, marks in reversed(NAME_LABELS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | lowered.contains(mark)
        label = F.when(hit, value).otherwise(label)
    return label


def label_from_position(name: Column) -> Column:
    """Label by the third dash-separated number of the name, where the naming scheme puts it."""
    codes = {marks[0][-2:]: value for value, marks in NAME_LABELS}
    return F.try_element_at(literal_map(codes), F.get(F.split(file_name(name), "-"), F.lit(2)))


def describe_feature(name: Column) -> Column:
    """Explanation of a feature: exact name, normalised name, numbered sibling, class of feature, default."""
    texts = literal_map(FEATURE_TEXTS)
    normal = F.regexp_replace(F.lower(name), r"[_\s-]", "_")
    sibling = F.try_element_at(texts, F.regexp_replace(normal, r"_\d+$", "_1"))
    number = F.try_to_number(F.nullif(F.regexp_extract(normal, r"_(\d+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    tail = F.pmod(number, F.lit(100))
    suffix = F.when(
        tail >= 20,
        F.when(tail % 10 == 1, "st").when(tail % 10 == 2, "nd").when(tail % 10 == 3, "rd").otherwise("th"),
    ).otherwise("th")
    ordinal = (
        F.when(number == 0, F.lit(""))
        .when(number <= 20, F.get(F.array(*[F.lit(o) for o in ORDINALS]), (number - 1).cast("int")))
        .otherwise(F.concat(number.cast("string"), suffix))
    )
    first_ordinal = "^(.*?)(" + "|".join(ORDINALS[:13]) + ")"
    numbered = F.when(number.isNull(), sibling).otherwise(
        F.regexp_replace(sibling, F.lit(first_ordinal), F.concat(F.lit("$1"), ordinal))
    )
    by_class = F.lit(FEATURE_DEFAULT_TEXT)
    for part, text in reversed(FEATURE_CLASS_TEXTS):
        by_class = F.when(normal.contains(part), text).otherwise(by_class)
    found = F.coalesce(F.try_element_at(texts, name), F.try_element_at(texts, normal), numbered, by_class)
    return F.when(name.isNull() | (name == ""), FEATURE_EMPTY_TEXT).otherwise(found)


def category_list(feature: Column) -> Column:
    """All categories a feature belongs to."""
    rules = (
        ("spectral", feature.startswith("spectral_") | feature.startswith("zero_crossing")),
        ("energy", feature.contains("rms") | feature.contains("energy")),
        ("mfcc", feature.startswith("mfcc_")),
        ("chroma", feature.startswith("chroma_")),
        ("tonnetz", feature.startswith("tonnetz_")),
        ("temporal", feature.isin("tempo", "duration")),
        ("metadata", feature == "sample_rate"),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules]))


def result_key(
    model: Column, path: Column, kind: str | None = None, size: Column | None = None, mtime: Column | None = None,
    version: str | None = None, layer: int | None = None, head: int | None = None,
) -> Column:
    """Cache key ``{model}[_{kind}]_{md5}[_l{layer}_h{head}]``; size, mtime and a version tag join the hash or key if given."""
    content = F.concat_ws("_", path, *[c.cast("string") for c in (size, mtime) if c is not None])
    parts = [model] + ([F.lit(kind)] if kind else []) + [F.md5(content)]
    if layer is not None and head is not None:
        parts.append(F.lit(f"l{layer}_h{head}"))
    if version:
        parts.append(F.lit(version))
    return F.concat_ws("_", *parts)
