"""Feature estimators: all state comes from the training rows and is replayed on any other rows.

Every block says which aggregates it needs; ``FeatureEstimator`` asks for all of them in one pass. Blocks read raw
columns only, so fitting them together gives the same state as fitting them one after another.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.scalars import right_closed_bin
from tunegauge.operators import lookup
from tunegauge.operators.quantiles import medians
from tunegauge.schema import TARGET

YEAR = "album_release_year"
BLOCKS = ["temporal", "audio_interactions", "non_linear", "market", "year_meta", "lastfm"]
#: Blocks that need no lookup tables.
PLAIN_BLOCKS = [b for b in BLOCKS if b != "lastfm"]
INPUTS = {
    "temporal": [YEAR],
    "audio_interactions": ["energy", "danceability", "acousticness", "valence", "speechiness", "tempo", "loudness"],
    "non_linear": ["duration_ms", "energy", "danceability", "valence", "tempo"],
    "market": ["total_available_markets"],
    "year_meta": [YEAR],
    "lastfm": ["artist_name", "track_id"],
}


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def _spread(value: float | None) -> float:
    return value if value else 1.0


def _partial(name: str, prefix: str) -> list[Column]:
    x = _num(name)
    return [F.count(x).alias(f"{prefix}_n"), F.avg(x).alias(f"{prefix}_avg"), F.var_pop(x).alias(f"{prefix}_var")]


def _combined(rows: list, prefix: str) -> tuple[float | None, float | None]:
    """Mean and population deviation of the whole from the per-year counts, means and variances."""
    parts = [(r[f"{prefix}_n"], r[f"{prefix}_avg"], r[f"{prefix}_var"]) for r in rows if r[f"{prefix}_n"]]
    total = sum(n for n, _, _ in parts)
    if not total:
        return None, None
    mean = sum(n * m for n, m, _ in parts) / total
    return mean, (sum(n * (v + (m - mean) ** 2) for n, m, v in parts) / total) ** 0.5


def temporal_columns(state: dict, options: dict) -> dict[str, Column]:
    year, now = _num(YEAR), float(state["current_year"])
    t1, t2 = options["year_thresholds"]
    age = F.when(year.isNotNull(), F.greatest(F.lit(now) - year, F.lit(0.0)))
    return {
        "year_is_missing": year.isNull(),
        f"is_post_{t1}": year >= t1,
        f"is_post_{t2}": year >= t2,
        "is_future_release": year > now,
        "age": age.cast("float"),
        "age_bin": right_closed_bin(age, options["age_bins"]),
        "year_zscore": ((year - state["year_mean"]) / _spread(state["year_std"])).cast("float"),
    }


def audio_columns(present: set[str]) -> dict[str, Column]:
    """Products of audio descriptors; each appears only when its inputs are there."""
    loud = F.when(F.col("loudness").isNotNull(), F.greatest(-_num("loudness"), F.lit(0.0))) if "loudness" in present else None
    products = {
        "vibe": (["energy", "danceability"], lambda: _num("energy") * _num("danceability")),
        "soft_mood": (["acousticness", "valence"], lambda: _num("acousticness") * _num("valence")),
        "emotional_intensity": (["energy", "valence"], lambda: _num("energy") * _num("valence")),
        "rap_speed": (["speechiness", "tempo"], lambda: _num("speechiness") * _num("tempo")),
        "punch": (["loudness", "energy"], lambda: loud * _num("energy")),
    }
    return {name: make().cast("float") for name, (needs, make) in products.items() if present.issuperset(needs)}


def non_linear_columns(state: dict, squared: list[str]) -> dict[str, Column]:
    tempo = _num("tempo")
    out = {"log_duration": F.log1p(_num("duration_ms")).cast("float")}
    out |= {f"{c}_sq": (_num(c) * _num(c)).cast("float") for c in squared}
    out |= {
        "tempo_is_zero": tempo == 0,
        "tempo_zscore": ((tempo - state["tempo_mean"]) / _spread(state["tempo_std"])).cast("float"),
        "tempo_log1p": F.when(tempo.isNotNull(), F.log1p(F.greatest(tempo, F.lit(0.0)))).cast("float"),
    }
    return out


def market_columns(state: dict, edges: list[float]) -> dict[str, Column]:
    markets = _num("total_available_markets")
    return {
        "markets_zscore": ((markets - state["markets_mean"]) / _spread(state["markets_std"])).cast("float"),
        "markets_bucket": right_closed_bin(markets, edges),
    }


def smoothed_year_means(train: DataFrame, smoothing: float, min_count: int, target: str = TARGET) -> DataFrame:
    """(year, year_mean, n): mean target per year; rare years are pulled towards the global mean."""
    y = _num(target)
    years = train.where(F.col(YEAR).isNotNull()).groupBy(F.col(YEAR).cast("int").alias("year")).agg(
        F.avg(y).alias("mean"), F.count(y).alias("n")
    )
    overall = train.agg(F.avg(y).alias("m")).scalar()
    mean = F.col("mean")
    if smoothing > 0:
        pulled = (mean * F.col("n") + overall * smoothing) / (F.col("n") + smoothing)
        mean = F.when(F.col("n") < min_count, pulled).otherwise(mean)
    return years.select("year", mean.alias("year_mean"), "n")


def year_trend(means: DataFrame) -> DataFrame:
    """Mean of a year minus the mean of the year before; NULL after a gap. The table has one row per year."""
    before = means.select((F.col("year") + 1).alias("year"), F.col("year_mean").alias("_prev"))
    return means.join(before, "year", "left").select(
        "year", "year_mean", (F.col("year_mean") - F.col("_prev")).alias("year_trend")
    )


def year_meta_columns(means: dict[int, float]) -> dict[str, Column]:
    """Lookup of fitted year means; one entry per calendar year, so a literal map is enough."""
    year = F.col(YEAR).cast("int")
    if not means:
        nothing = F.lit(None).cast("float")
        return {"year_popularity_mean": nothing, "year_trend": nothing}
    table = F.create_map(*[F.lit(x) for pair in sorted(means.items()) for x in pair])
    now, prev = F.try_element_at(table, year), F.try_element_at(table, year - 1)
    return {"year_popularity_mean": now.cast("float"), "year_trend": (now - prev).cast("float")}


def listener_tag_columns(df: DataFrame, tables: dict[str, str], tags: list[str]) -> DataFrame:
    """Listener, tag and corrected-year columns from landed lookup tables; unknown artists have 0 listeners and no tags.

    ``tables`` names Parquet folders: ``artists`` (artist_name, listeners), ``tags`` (artist_name, tag) and, if there is one,
    ``proxies`` (track_id, proxy_year). Only fitted tags enter the set of an artist, so that set is bounded.
    """
    read = df.sparkSession.read.parquet
    listeners = read(tables["artists"]).select("artist_name", "listeners")
    wanted = read(tables["tags"]).select("artist_name", lookup.tag_column("tag").alias("tag")).where(F.col("tag").isin(tags))
    sets = wanted.groupBy("artist_name").agg(F.collect_set("tag").alias("tags"))
    name = "artist_lastfm_listeners_log"
    out = lookup.join_listeners(df, listeners).withColumn(name, F.col("listeners_log").cast("float"))
    out = TagEncoder(tags=tags).transform(out.join(sets, "artist_name", "left"))
    if "proxies" in tables:
        out = lookup.join_proxy(out, read(tables["proxies"]).select("track_id", F.col("proxy_year").alias("lastfm_track_proxy")))
    else:
        out = out.withColumn("lastfm_track_proxy", F.lit(None).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name, *[f"tag_{t}" for t in tags], "lastfm_track_proxy")


class _FeatureParams(Params):
    blocks = Param(Params._dummy(), "blocks", "feature blocks, in order", TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "block options as JSON", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(blocks=PLAIN_BLOCKS, options="{}")

    def settings(self) -> dict:
        given = json.loads(self.getOrDefault("options"))
        return {
            "current_year": None, "age_bins": [2, 5, 10], "year_thresholds": [2015, 2018], "market_buckets": [100, 150],
            "squared": ["energy", "danceability", "valence"], "year_smoothing": 0.0, "min_year_count": 1,
            "target": TARGET, "optional": False, "tables": None, "top_tags": 50,
        } | given

    def active_blocks(self, df: DataFrame) -> list[str]:
        """Blocks whose inputs are there; a missing input raises unless ``optional`` is set."""
        active = []
        for block in self.getOrDefault("blocks"):
            missing = [c for c in INPUTS[block] if c not in df.columns]
            if block == "lastfm" and not self.settings()["tables"]:
                missing.append("of option 'tables'")
            if missing and not self.settings()["optional"]:
                raise ValueError(f"feature block {block} needs columns {missing}")
            if not missing or block == "audio_interactions":
                active.append(block)
        return active


class FeatureEstimator(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Configurable feature blocks; ``fit`` reads the training rows once."""

    @keyword_only
    def __init__(self, *, blocks=None, options=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _fit(self, train: DataFrame) -> "FeatureModel":
        opts, active = self.settings(), self.active_blocks(train)
        sources = {"temporal": (YEAR, "year"), "non_linear": ("tempo", "tempo"), "market": ("total_available_markets", "markets")}
        wanted = [sources[b] for b in active if b in sources]
        if "year_meta" in active:
            wanted.append((opts["target"], "target"))
        state: dict = {}
        if wanted:
            # one pass for all blocks: statistics per calendar year, which the driver adds up
            year = F.col(YEAR).cast("int") if YEAR in train.columns else F.lit(None).cast("int")
            aggs = [c for name, prefix in wanted for c in _partial(name, prefix)]
            rows = train.groupBy(year.alias("_year")).agg(*aggs).collect()
            for _, prefix in wanted:
                state[f"{prefix}_mean"], state[f"{prefix}_std"] = _combined(rows, prefix)
            years = [r["_year"] for r in rows if r["_year"] is not None]
            state["current_year"] = opts["current_year"] if opts["current_year"] is not None else max(years, default=None)
            if "year_meta" in active:
                state["year_means"] = {
                    str(r["_year"]): self._year_mean(r, state["target_mean"], opts)
                    for r in rows if r["_year"] is not None and r["target_n"]}
        if "lastfm" in active:
            tags = train.sparkSession.read.parquet(opts["tables"]["tags"])
            state["tags"] = [r["tag"] for r in lookup.top_tags(tags, opts["top_tags"]).collect()]  # at most top_tags
        if "temporal" in active and state["current_year"] is None:
            raise ValueError("no training row has a year; give current_year")
        if "temporal" in active and state["year_mean"] is None:
            state["year_mean"] = float(state["current_year"])
        model = FeatureModel(state=json.dumps(state))
        return self._copyValues(model)

    @staticmethod
    def _year_mean(row, overall: float, opts: dict) -> float:
        n, mean, k = row["target_n"], row["target_avg"], opts["year_smoothing"]
        return (mean * n + overall * k) / (n + k) if k > 0 and n < opts["min_year_count"] else mean


class FeatureModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Replays fitted feature blocks on any rows: a narrow projection, and for ``lastfm`` joins with its lookup tables."""

    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def __init__(self, state: str | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    def _transform(self, df: DataFrame) -> DataFrame:
        opts, state, out = self.settings(), self.fitted(), {}
        for block in self.active_blocks(df):
            if block == "temporal":
                out |= temporal_columns(state, opts)
            elif block == "audio_interactions":
                out |= audio_columns(set(df.columns))
            elif block == "non_linear":
                out |= non_linear_columns(state, opts["squared"])
            elif block == "market":
                out |= market_columns(state, opts["market_buckets"])
            elif block == "year_meta":
                out |= year_meta_columns({int(y): m for y, m in state["year_means"].items()})
        out = df.withColumns(out)
        return listener_tag_columns(out, opts["tables"], state["tags"]) if "tags" in state else out


class TagEncoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """0/1 columns for fixed tags out of a ``tags`` array column, all in one projection."""

    tags = Param(Params._dummy(), "tags", "tag names", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, tags=None):
        super().__init__()
        if tags is not None:
            self._set(tags=tags)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"tag_{t}": F.coalesce(F.array_contains("tags", t), F.lit(False)).cast("tinyint")
            for t in self.getOrDefault("tags")
        })


class MedianImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Exact training medians; ``fit`` sees training rows only."""

    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        if columns is not None:
            self._set(columns=columns)

    def _fit(self, train: DataFrame) -> "MedianModel":
        names = self.getOrDefault("columns")
        found = medians(train, names)
        if unknown := [c for c in names if c not in found]:
            raise ValueError(f"no training value to take a median of: {', '.join(unknown)}")
        return MedianModel(columns=names, values=[float(found[c]) for c in names])


class MedianModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)
    values = Param(Params._dummy(), "values", "their medians", TypeConverters.toListFloat)

    def __init__(self, columns: list[str] | None = None, values: list[float] | None = None):
        super().__init__()
        if columns is not None:
            self._set(columns=columns, values=values)

    def fitted(self) -> dict[str, float]:
        return dict(zip(self.getOrDefault("columns"), self.getOrDefault("values")))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.fitted().items()
        })
