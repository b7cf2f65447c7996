"""Numeric feature functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunegauge.functions.text import col
from tunegauge.schema import AUDIO_DEFAULTS, REGIME_LABELS, REGIME_T1, REGIME_T2

# Note names by pitch class.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Bin number for (-inf, e0], (e0, e1], ..., (en, inf); NULL stays NULL."""
    result = F.when(value > edges[-1], len(edges))
    for i in range(len(edges) - 1, -1, -1):
        result = F.when(value <= edges[i], i).otherwise(result)
    return F.when(value.isNotNull(), result).cast("byte")


def regime_id(listeners_log: str | Column, t1: float = REGIME_T1, t2: float = REGIME_T2) -> Column:
    """0 cold start, 1 tipping point, 2 mainstream; unknown listeners have no regime."""
    x = col(listeners_log)
    return F.when(x < t1, 0).when(x < t2, 1).when(x >= t2, 2)


def regime_label(listeners_log: str | Column, t1: float = REGIME_T1, t2: float = REGIME_T2) -> Column:
    x = col(listeners_log)
    return F.when(x < t1, REGIME_LABELS[0]).when(x < t2, REGIME_LABELS[1]).when(x >= t2, REGIME_LABELS[2])


def listeners_log(listeners: str | Column) -> Column:
    """``log1p`` of the listener count, the same in training and in scoring; a missing artist has 0 listeners."""
    return F.log1p(F.coalesce(col(listeners), F.lit(0)).cast("double"))


def recency_weight(
    year: str | Column, reference_year: int, lam: float = 0.05, null_policy: str = "current",
    median_year: float | None = None,
) -> Column:
    """``exp(-lam * age)`` with age >= 0.

    ``null_policy`` says what a missing year means: ``none`` gives no weight, ``median`` uses the given training
    median and keeps the weight within 1e-3..1, ``current`` counts as age 0, ``error`` raises at run time.
    """
    y = col(year).cast("double")
    if null_policy == "median":
        if median_year is None:
            raise ValueError("null_policy='median' needs median_year")
        y = F.coalesce(y, F.lit(float(median_year)))
    elif null_policy == "current":
        y = F.coalesce(y, F.lit(float(reference_year)))
    elif null_policy == "error":
        y = F.when(y.isNotNull(), y).otherwise(F.raise_error(F.lit("missing year in recency weight")).cast("double"))
    elif null_policy != "none":
        raise ValueError(f"unknown null_policy {null_policy}")
    # F.greatest skips NULL, so the NULL check stays outside
    age = F.when(y.isNotNull(), F.greatest(F.lit(float(reference_year)) - y, F.lit(0.0)))
    weight = F.exp(-F.lit(lam) * age)
    if null_policy == "median":
        weight = F.when(weight.isNotNull(), F.least(F.greatest(weight, F.lit(1e-3)), F.lit(1.0)))
    return weight


def clip_0_100(prediction: str | Column) -> Column:
    p = col(prediction)
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)))


def clip_round_prediction(prediction: str | Column) -> Column:
    """Whole-number score 0..100, halves to even."""
    p = F.bround(col(prediction), 0)
    return clip_0_100(p).cast("int")


def pitch_key_name(key: str | Column, mode: str | Column) -> Column:
    k = col(key)
    note = F.get(F.array(*[F.lit(p) for p in PITCHES]), k.cast("int"))
    name = F.concat_ws(" ", note, F.when(col(mode) == 1, "Maj").otherwise("Min"))
    return F.when((k >= 0) & (k <= 11), name).otherwise("Unknown")


def text_hash(*parts: str | Column) -> Column:
    """A number below 2^60 from the MD5 of the parts as text; each part carries a mark, so NULL differs from any value."""
    marked = [F.coalesce(F.concat(F.lit("v"), col(p).cast("string")), F.lit("n")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, 15), 16, 10).cast("long")


def market_count(codes: str | Column, default: float = 180.0) -> Column:
    """Number of comma-separated market codes."""
    text = col(codes)
    return F.when(F.coalesce(text, F.lit("")) != "", F.size(F.split(text, ",")).cast("double")).otherwise(default)


def default_audio(parsed: dict[str, Column]) -> list[Column]:
    """The twelve audio features: a parsable value where there is one, else the fixed default."""
    return [
        F.coalesce(parsed[name].try_cast("double") if name in parsed else F.lit(None), F.lit(default)).alias(name)
        for name, default in AUDIO_DEFAULTS.items()
    ]


def missing_to_null(value: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    v = col(value).cast("double")
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(~bad, v)
