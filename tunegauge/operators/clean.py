"""Cleaning steps and data contracts of the track table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegauge.functions.scalars import default_audio, missing_to_null, text_hash
from tunegauge.operators.ranking import rank_per_group, top_per_group
from tunegauge.schema import BYTE_COLS, DROP_FOR_MODELING, FLOAT_COLS, SHORT_COLS, STRICT_15, TARGET


def dedup_keep_max(df: DataFrame, key: str, target: str = TARGET, tie_break: list[str] | None = None) -> DataFrame:
    """One row per key: the highest target, ties by ``tie_break`` ascending."""
    require_columns(df, [key, target])
    return top_per_group(df, [key], [F.col(target).desc_nulls_last(), *(tie_break or [])])


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def normalize_release_year(df: DataFrame) -> DataFrame:
    """Fill the year from the date text, drop rows without a year, drop the date."""
    require_columns(df, ["album_release_date", "album_release_year"])
    date = F.col("album_release_date")
    year = F.coalesce(F.col("album_release_year"), F.substring(date, 1, 4).try_cast("double"))
    year = F.when(F.coalesce(date, F.lit("")) != "0000", year)
    return df.withColumn("album_release_year", year).where("album_release_year IS NOT NULL").drop("album_release_date")


def flag_suspect_year(df: DataFrame, max_year: int | None = None) -> DataFrame:
    """Years before 1901, or after ``max_year``, become NULL; rows stay and carry a flag."""
    year = F.col("album_release_year").cast("double")
    good = year > 1900
    if max_year is not None:
        good = good & (year <= max_year)
    return df.withColumn("album_release_year", F.when(good, year)).withColumn(
        "release_year_missing_or_suspect", F.col("album_release_year").isNull()
    )


def enforce_dtypes(df: DataFrame) -> DataFrame:
    """Numeric coercion, rounding half to even and narrow types; columns that are absent are passed over."""
    kinds = {c: "float" for c in FLOAT_COLS} | {c: "tinyint" for c in BYTE_COLS} | {c: "smallint" for c in SHORT_COLS}
    kinds["album_release_year"] = "smallint"
    changes = {}
    for name, kind in kinds.items():
        if name in df.columns:
            number = F.col(name).try_cast("double")
            changes[name] = number.cast("float") if kind == "float" else F.bround(number, 0).try_cast(kind)
    for name in ("release_year_missing_or_suspect", "song_explicit"):
        if name in df.columns:
            changes[name] = F.col(name).cast("boolean")
    return df.withColumns(changes)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def forbid_columns(df: DataFrame, forbidden: list[str]) -> DataFrame:
    present = sorted(set(forbidden) & set(df.columns))
    if present:
        raise ValueError(f"disallowed columns present: {present}")
    return df


def target_range_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    y = F.col(target).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y.isNull()).alias("n_missing"),
        F.min(y).alias("min_target"),
        F.max(y).alias("max_target"),
        F.count_if((y < 0) | (y > 100)).alias("n_out_of_range"),
    )


def validate_target_range(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Raise when the target is missing anywhere or outside 0..100; one aggregate."""
    row = target_range_report(require_columns(df, [target]), target).first()
    if row["n_missing"]:
        raise ValueError(f"{row['n_missing']} rows have no {target}")
    if row["n_out_of_range"]:
        raise ValueError(f"{target} outside 0..100: min {row['min_target']}, max {row['max_target']}")
    return df


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of every rule in one pass: (rule, n_violations, n_rows). A NULL outcome counts as a violation."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()],
    )
    return counted.unpivot(["n_rows"], list(rules), "rule", "n_violations").select("rule", "n_violations", "n_rows")


def track_rules() -> dict[str, Column]:
    """The row rules every prepared track table has to keep."""
    duration, tempo = F.col("duration_ms"), F.col("tempo")
    return {
        "target_in_range": F.col(TARGET).between(0, 100),
        "duration_positive": duration.isNull() | (duration > 0),
        "tempo_not_negative": tempo.isNull() | (tempo >= 0),
        "loudness_not_positive": F.col("loudness") <= 0,
        "energy_in_unit": F.col("energy").between(0, 1),
    }


def repair_merge_suffixes(df: DataFrame) -> DataFrame:
    """Undo a merge: ``name_x`` is restored to ``name``, ``name_y`` and the index column go."""
    keep = [c for c in df.columns if not c.endswith("_y") and c != "Unnamed: 0"]
    return df.select(*[F.col(f"`{c}`").alias(c.removesuffix("_x")) for c in keep])


def select_numeric(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    wanted = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (exclude or [])]
    return df.select(*wanted)


def clean_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Booleans become 0/1, NaN and infinities become NULL."""
    changes = {}
    for field in df.schema:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, T.BooleanType):
            changes[field.name] = F.col(field.name).cast("tinyint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changes[field.name] = missing_to_null(field.name)
    return df.withColumns(changes)


def strict_contract(df: DataFrame, contract: list[str] = STRICT_15) -> DataFrame:
    """Exactly the contracted columns, in order, as doubles; raises when one is absent."""
    require_columns(df, contract)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in contract])


def mainstream_work_list(df: DataFrame, threshold: float = 13.09) -> DataFrame:
    """Distinct (artist, song) pairs of tracks whose artist reaches the listener threshold."""
    return df.where(F.col("listeners_log") >= threshold).select("artist_name", "song_name").distinct()


def with_default_audio(df: DataFrame, parsed: dict[str, Column], keep: list[str]) -> DataFrame:
    """Overlay parsed audio values on the fixed defaults; ``is_partial`` marks rows that had none."""
    values = list(parsed.values())
    nothing = values[0].isNull()
    for value in values[1:]:
        nothing = nothing & value.isNull()
    return df.select(*keep, *default_audio(parsed), nothing.alias("is_partial"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows: those with the smallest seeded hashes of a unique key. No task holds the sample."""
    ranked = rank_per_group(df.withColumn("_hash", text_hash(key, F.lit(seed))), [], ["_hash", key], "_rank")
    return ranked.where(F.col("_rank") <= n).drop("_hash", "_rank")


def anti_leakage_view(df: DataFrame, identifiers: list[str] = DROP_FOR_MODELING) -> DataFrame:
    return forbid_columns(df.drop(*identifiers), identifiers)


def prepare_tracks(raw: DataFrame, key: str = "spotify_id", tie_break: list[str] | None = None) -> DataFrame:
    """Raw table to modeling table: one shuffle (the de-duplication)."""
    cleaned = dedup_keep_max(raw, key, TARGET, tie_break)
    cleaned = flag_suspect_year(normalize_release_year(drop_if_present(cleaned, "album_release_month")))
    return enforce_dtypes(cleaned)


def modeling_table(prepared: DataFrame, identifiers: list[str] = DROP_FOR_MODELING) -> DataFrame:
    """The prepared table without identifiers, with a valid target."""
    return validate_target_range(anti_leakage_view(prepared, identifiers))
