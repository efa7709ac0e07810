"""Perturbation of waveforms and comparison of predictions before and after.

Waveforms are one array per row here, so a chain of perturbations is a chain of projections without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.rows import file_name
from sonarium.functions.signal import add_noise, finish_wave, mask_band, mask_time
from sonarium.operators.accuracy import METRICS, transcript_accuracy

# parameters and their defaults per built perturbation
PARAMETERS = {
    "noise": {"noise_level": 0.005},
    "time_masking": {"mask_start_percent": 20.0, "mask_end_percent": 40.0},
    "frequency_masking": {"mask_freq_start": 1000.0, "mask_freq_end": 2000.0},
}


def _step(kind: str, given: dict, wave: Column, clip: Column, rate: Column, seed: int, floor: float, two_sided: bool):
    if kind == "noise":
        return add_noise(wave, clip, given["noise_level"], seed)
    if kind == "time_masking":
        return mask_time(wave, clip, given["mask_start_percent"], given["mask_end_percent"], floor, seed)
    return mask_band(wave, rate, given["mask_freq_start"], given["mask_freq_end"], two_sided)


def _outcome(kind: str, params: dict[str, float], status: str | Column, error: str | Column | None) -> Column:
    pairs = [F.lit(x) for k, v in params.items() for x in (k, float(v))]
    as_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return F.struct(
        F.lit(kind).alias("type"), as_map.alias("params"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error")
    )


def perturb_chain(
    df: DataFrame, specs: Sequence[dict], wave: str = "wave", clip: str = "clip", rate: str = "rate",
    seed: int = 0, floor: float = 1e-4, two_sided: bool = False,
) -> DataFrame:
    """Apply ``[{type, params}]`` in order, each to the result of the one before, and record what became of each.

    Status is applied, unsupported (unknown type, pitch shift, time stretch) or failed: for all files if a parameter is no number, and for the
    files a step cannot work on (no samples, or no positive rate where frequencies count). A failed step leaves the file's wave as it was.
    """
    # a step changes neither the presence of samples nor the rate, so both are settled before the first one
    silent = F.when(F.col(wave).isNull() | (F.size(wave) == 0), "no samples")
    out = df.withColumns({"_no_samples": silent, "_no_rate": silent.when(F.col(rate).isNull() | (F.col(rate) <= 0), "no sample rate")})
    outcomes = []
    for number, spec in enumerate(specs):
        kind, given = spec.get("type"), dict(spec.get("params") or {})
        if kind not in PARAMETERS:
            outcomes.append(_outcome(str(kind), {k: v for k, v in given.items() if isinstance(v, (int, float))}, "unsupported", None))
            continue
        filled = {k: given.get(k, v) for k, v in PARAMETERS[kind].items()}
        try:
            filled = {k: float(v) for k, v in filled.items()}
        except (TypeError, ValueError) as e:
            outcomes.append(_outcome(kind, {}, "failed", str(e)))
            continue
        reason = F.col("_no_rate" if kind == "frequency_masking" else "_no_samples")
        # a Python step is given every row, so it gets no rate and no wave where it cannot work
        able_wave, able_rate = (F.when(reason.isNull(), F.col(c)) for c in (wave, rate))
        changed = _step(kind, filled, able_wave, F.col(clip), able_rate, seed + number, floor, two_sided)
        out = out.withColumn(wave, F.when(reason.isNull(), changed).otherwise(F.col(wave)))
        outcomes.append(_outcome(kind, filled, F.when(reason.isNull(), "applied").otherwise("failed"), reason))
    empty = "array<struct<type:string,params:map<string,double>,status:string,error:string>>"
    return out.withColumn("applied_perturbations", F.array(*outcomes).cast(empty)).drop("_no_samples", "_no_rate")


def finish_perturbed(df: DataFrame, path: str, wave: str = "wave", rate: str = "rate") -> DataFrame:
    """Clean and peak-normalise the wave, its duration in ms, and a name ``{stem}_perturbed_{8 hex}{ext}`` from path and wave."""
    name, ext = file_name(F.col(path)), F.regexp_extract(file_name(F.col(path)), r"(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return df.withColumn(wave, finish_wave(F.col(wave))).withColumns(
        {
            "duration_ms": F.floor(F.size(wave) / F.col(rate) * 1000),
            "filename": F.concat(
                stem,
                F.lit("_perturbed_"),
                F.substring(F.md5(F.concat_ws("_", F.col(path), F.xxhash64(F.col(wave)).cast("string"))), 1, 8),
                ext,
            ),
        }
    )


def probability_shift(before: DataFrame, after: DataFrame, key: str, probabilities: str = "probabilities") -> DataFrame:
    """Change of each label's probability in percent points; a label unknown before counts as 0 there."""
    old = before.select(key, F.col(probabilities).alias("_old"))
    joined = after.select(key, F.col(probabilities).alias("_new")).join(old, key, "left")
    shift = (F.col("p") - F.coalesce(F.try_element_at("_old", F.col("label")), F.lit(0.0))) * 100
    return (
        joined.select(key, "_old", F.explode("_new").alias("label", "p"))
        .select(key, "label", shift.alias("shift"))
        .withColumns(
            {
                "significant": F.abs("shift") > 1,
                "direction": F.when(F.col("shift") > 0, "up").when(F.col("shift") < 0, "down").otherwise("same"),
            }
        )
    )


def label_flips(before: DataFrame, after: DataFrame, key: str, label: str = "predicted_label") -> DataFrame:
    """Label before and after, and whether it changed."""
    return (
        before.select(key, F.col(label).alias("label_before"))
        .join(after.select(key, F.col(label).alias("label_after")), key)
        .withColumn("flipped", F.col("label_before") != F.col("label_after"))
    )


def flip_rate(flips: DataFrame) -> DataFrame:
    return flips.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("flipped").alias("flipped"),
        F.coalesce(F.avg(F.col("flipped").cast("double")), F.lit(0.0)).alias("flip_rate"),
    )


def transcript_change(
    df: DataFrame, before: str, after: str, truth: str, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Whether the transcript changed, and each metric for both transcripts side by side; null without truth."""
    first = transcript_accuracy(df, before, truth, metrics).withColumnsRenamed({m: f"{m}_before" for m in metrics})
    second = transcript_accuracy(first, after, truth, metrics).withColumnsRenamed({m: f"{m}_after" for m in metrics})
    return second.withColumn("changed", ~F.col(before).eqNullSafe(F.col(after)))
