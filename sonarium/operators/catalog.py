"""Dataset catalog operators over tables of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.rows import contains_any_case, human_size
from sonarium.operators.blocks import attach_small, match_keys, number_rows, running_sums, spread_bits
from sonarium.session import settle


def with_default_duration(metadata: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Fill a missing ``duration`` from the clip table (2 decimals), otherwise the string 0.0."""
    measured = clips.select(key, F.round(F.col("duration"), 2).cast("string").alias("_measured"))
    given = F.col("duration").cast("string") if "duration" in metadata.columns else F.lit(None).cast("string")
    return (
        metadata.join(measured, key, "left")
        .withColumn("duration", F.coalesce(F.nullif(given, F.lit("")), F.col("_measured"), F.lit("0.0")))
        .drop("_measured")
    )


#: A name that a copy of another name could be given: stem, number, extension.
_SUFFIXED = r"^(.*)_([1-9]\d{0,8})(\.[^.]*)?$"


def dedupe_filenames(files: DataFrame, dataset: Sequence[str], name: str, arrival: str, out: str = "filename") -> DataFrame:
    """Unique names per dataset in the order of arrival: a name that is free stays, else the first free one of ``stem_1.ext``, ``stem_2.ext``, … is taken.

    Only names given earlier count, so ``a.wav, a.wav, a_1.wav`` become ``a.wav, a_1.wav, a_1_1.wav``. ``arrival`` is a unique integer.
    Copies of one name are numbered block by block, however many there are; :func:`_given_suffixes` finds which of their numbers literal names hold.
    """
    pair = F.struct(*dataset, name)
    ranked = number_rows(files.withColumn("_file", pair), ["_file"], arrival, "_pos", spread_bits(files, arrival))
    given = _given_suffixes(files, dataset, name, arrival)
    if given is None:
        numbered = ranked.withColumn("_suffix", F.col("_pos"))
    else:
        # a name that a copy of another one took before its own first arrival gives all its arrivals to copies
        taken = given.filter("_taken").select("_file", F.lit(1).alias("_late"))
        copies = attach_small(ranked, taken, ["_file"], "left").withColumn("_copy", F.col("_pos") + F.coalesce("_late", F.lit(0)))
        held = given.filter("_skipped").select(F.col("_parent").alias("_file"), "_no")
        # a held suffix t with j held ones before it pushes every copy from t - j on by one
        pushes = settle(
            number_rows(held, ["_file"], "_no", "_before", spread_bits(held, "_no"))
            .groupBy("_file", (2 * (F.col("_no") - F.col("_before"))).alias("_ord"))
            .agg(F.count(F.lit(1)).alias("_w"))
        )
        both = copies.withColumns({"_ord": 2 * F.col("_copy") + 1, "_w": (F.col("_copy") > 0).cast("long")}).unionByName(pushes, allowMissingColumns=True)
        summed = running_sums(both, ["_file"], "_ord", "_w", "_sum").filter(F.col("_copy").isNotNull())
        numbered = summed.withColumn("_suffix", F.when(F.col("_copy") > 0, F.col("_sum")).otherwise(0))
    ext = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    renamed = F.concat(stem, F.lit("_"), F.col("_suffix").cast("long").cast("string"), ext)
    named = numbered.withColumn(out, F.when(F.col("_suffix") == 0, F.col(name)).otherwise(renamed))
    return named.select(*files.columns, *([] if out in files.columns else [out]))


def _given_suffixes(files: DataFrame, dataset: Sequence[str], name: str, arrival: str) -> DataFrame | None:
    """``_file, _parent, _no, _skipped, _taken`` for the names that a copy of another present name could be given; None if there are none.

    ``_skipped``: the name was there before the copies came to its number. ``_taken``: a copy took it before its own first arrival. Numbers
    of one name depend on the smaller ones only: number c is skipped if fewer than c - s copies, s being the skipped numbers below c,
    had come when the literal name did. Starting from all skipped, running sums of the decisions are taken until no decision moves.
    Names depend on the names they extend, so this is done for names that extend none first, then for those that extend these.
    """
    pair = F.struct(*dataset, name)
    names = settle(files.groupBy(pair.alias("_file")).agg(F.min(arrival).alias("_first"), F.count(F.lit(1)).alias("_n")))
    text = F.col(f"_file.{name}")
    number = F.nullif(F.regexp_extract(text, _SUFFIXED, 2), F.lit("")).cast("long")
    base = F.concat(F.regexp_extract(text, _SUFFIXED, 1), F.regexp_extract(text, _SUFFIXED, 3))
    extended = names.withColumn("_no", number).filter(F.col("_no").isNotNull())
    parent = F.struct(*[F.col(f"_file.{d}").alias(d) for d in dataset], base.alias(name))
    found = extended.withColumn("_parent", parent).join(names.select(F.col("_file").alias("_parent"), F.col("_n").alias("_of")), "_parent")
    kids = settle(found.select("_file", "_parent", "_no", "_first", "_of"))
    if kids.isEmpty():
        return None
    # how many files of the parent's name had come before the name itself
    parents = kids.select(F.col("_parent").alias("_file")).distinct().withColumn("_is", F.lit(True))
    come = attach_small(files.select(pair.alias("_file"), F.col(arrival).alias("_at")), parents, ["_file"]).select("_file", "_at", F.lit(1).alias("_w"))
    marks = kids.select(F.col("_parent").alias("_file"), F.col("_first").alias("_at"), F.lit(0).alias("_w"), F.col("_file").alias("_kid"))
    events = come.unionByName(marks, allowMissingColumns=True)
    counted = running_sums(events, ["_file"], "_at", "_w", "_came", spread_bits(files, arrival)).filter(F.col("_kid").isNotNull())
    kids = settle(kids.join(counted.select(F.col("_kid").alias("_file"), "_came"), "_file"))
    # parents that extend no present name keep their first arrival's name
    level = kids.select("_parent").distinct().join(kids.select(F.col("_file").alias("_parent")), "_parent", "left_anti").withColumn("_late", F.lit(0))
    done = None
    while True:
        rows = settle(kids.join(level, "_parent"))
        if rows.isEmpty():
            return done
        # the first arrival is no copy unless its name was taken
        copies, total = F.greatest(F.col("_came") - 1 + F.col("_late"), F.lit(0)), F.col("_of") - 1 + F.col("_late")
        decided = rows.withColumn("_skip", F.lit(1))
        while True:
            below = running_sums(decided, ["_parent"], "_no", "_skip", "_s", spread_bits(kids, "_no")).withColumn("_s", F.col("_s") - F.col("_skip"))
            after = settle(below.withColumn("_now", (F.col("_s") < F.col("_no") - copies).cast("int")))
            moved = not after.filter(F.col("_now") != F.col("_skip")).isEmpty()
            decided = after.withColumn("_skip", F.col("_now")).drop("_now", "_s")
            if not moved:
                break
        reached = F.col("_no") - F.col("_s") <= total
        flags = after.select("_file", "_parent", "_no", (F.col("_now") == 1).alias("_skipped"), ((F.col("_now") == 0) & reached).alias("_taken"))
        done = flags if done is None else done.unionByName(flags)
        level = flags.select(F.col("_file").alias("_parent"), F.col("_taken").cast("int").alias("_late"))


def dataset_summary(
    files: DataFrame, dataset: Sequence[str], name: str, duration: Column, size: Column, arrival: str
) -> DataFrame:
    """Per dataset: files, total duration, total size (raw and rendered), the first three file names."""
    totals = files.select(*dataset, duration.alias("_d"), size.alias("_s")).groupBy(*dataset).agg(
        F.count(F.lit(1)).alias("files"), F.sum("_d").alias("total_duration"), F.sum("_s").alias("total_size")
    )
    # a rank limit per dataset is applied before the shuffle, so only three names per dataset and task travel
    first = top_per_group(files.select(*dataset, arrival, name), dataset, [F.asc(arrival)], 3, "_r")
    names = first.groupBy(*dataset).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(arrival, name))), lambda e: e[name]), ", ").alias(
            "first_files"
        )
    )
    return match_keys(totals, names, dataset).withColumn("size_text", human_size(F.col("total_size")))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Spark applies the limit per task before the shuffle, so hot groups stay small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= k)


def files_as_rows(datasets: DataFrame, files: str = "files") -> DataFrame:
    """One all-string row per nested file; a missing sample rate becomes 0."""
    rows = datasets.select(*[c for c in datasets.columns if c != files], F.inline(files))
    as_text = []
    for c in rows.columns:
        value = F.col(c).cast("string")
        as_text.append((F.coalesce(value, F.lit("0")) if c == "sample_rate" else value).alias(c))
    return rows.select(*as_text)


def combined_view(uploaded: DataFrame, dataset: DataFrame) -> DataFrame:
    """Uploaded rows first, then dataset rows; columns only one side has are null on the other."""
    return uploaded.withColumn("source_rank", F.lit(0)).unionByName(
        dataset.withColumn("source_rank", F.lit(1)), allowMissingColumns=True
    )


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    return df.filter(contains_any_case([F.col(c) for c in columns], text))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> DataFrame:
    """One page of the sorted rows; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def scope_to_session(files: DataFrame, session_id: str, dataset: str, owner: str | None = None) -> DataFrame:
    """Rows of one (session, dataset). A dataset name that carries another session's id is still resolved, and marked."""
    holder = owner or session_id
    return files.filter((F.col("session_id") == holder) & (F.col("dataset") == dataset)).withColumn(
        "foreign_session", F.lit(holder != session_id)
    )


def check_cohort(requested: DataFrame, known: DataFrame, key: str, max_files: int | None = None) -> DataFrame:
    """One row: requested, found and missing files. ``max_files`` is the optional request limit; none by default."""
    marked = requested.join(known.select(key, F.lit(1).alias("_hit")).dropDuplicates([key]), key, "left")
    counted = marked.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("_hit").alias("found"),
        (F.count(F.lit(1)) - F.count("_hit")).alias("missing"),
    )
    problem = F.when(F.col("requested") == 0, F.raise_error(F.lit("no files provided")).cast("boolean"))
    if max_files is not None:
        problem = problem.when(
            F.col("requested") > max_files, F.raise_error(F.lit(f"more than {max_files} files")).cast("boolean")
        )
    return counted.filter(problem.otherwise(F.lit(True)))
