"""Scene catalogs: predicates, deduplication, scoring, ranking and reports over a table of scenes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import boxes_overlap, shared_area

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
ANALYSIS_READY = ("L2", "L2A", "L2SP", "ARD")


@dataclass(frozen=True)
class SceneQuery:
    """What to search for; unset fields do not filter. A field's scenes that are unknown pass where it says so."""

    bbox: tuple[float, float, float, float] | None = None
    geometry: tuple[tuple[float, float], ...] = ()  # a polygon's corners, whose box filters
    start: str | None = None
    end: str | None = None
    cloud_max: float | None = None  # unknown passes
    cloud_min: float | None = None
    providers: tuple[str, ...] = ()
    satellites: tuple[str, ...] = ()
    sensors: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    product_type: str | None = None
    polarisation: str | None = None
    pass_direction: str | None = None
    relative_orbit: int | None = None
    resolution_min: float | None = None
    resolution_max: float | None = None
    ids: tuple[str, ...] = ()
    expression: str | None = None  # SQL over the scenes' columns
    overrides: dict[str, dict] = field(default_factory=dict, hash=False)  # fields by provider
    sort_by: str | None = None  # a column; else by score
    ascending: bool = False
    limit: int = 100
    page: int = 1

    def __post_init__(self) -> None:
        for lo, hi in ((self.cloud_min, self.cloud_max), (self.start, self.end), (self.resolution_min, self.resolution_max)):
            if lo is not None and hi is not None and lo > hi:
                raise ValueError(f"{lo} is above {hi}")
        if self.bbox and not (self.bbox[0] <= self.bbox[2] and self.bbox[1] <= self.bbox[3]):
            raise ValueError(f"not a box in order: {self.bbox}")

    def predicate(self) -> Column:
        out = F.lit(True)
        own = tuple(F.col(c) for c in BOX)
        boxes = [self.bbox] if self.bbox else []
        if self.geometry:
            xs, ys = zip(*self.geometry)
            boxes.append((min(xs), min(ys), max(xs), max(ys)))
        for b in boxes:
            out = out & boxes_overlap(own, tuple(map(F.lit, b)))
        if self.start:
            out = out & (F.col("datetime") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            out = out & (F.col("datetime") <= F.lit(self.end).cast("timestamp_ntz"))
        if self.cloud_max is not None:
            out = out & (F.col("cloud_cover").isNull() | (F.col("cloud_cover") <= self.cloud_max))
        if self.cloud_min is not None:
            out = out & (F.col("cloud_cover") >= self.cloud_min)
        for name, wanted in (("provider", self.providers), ("collection", self.collections), ("id", self.ids)):
            if wanted:
                out = out & F.col(name).isin(*wanted)
        for name, wanted in (("satellite", self.satellites), ("sensor", self.sensors), ("processing_level", self.levels), ("product_type", [self.product_type]), ("pass_direction", [self.pass_direction])):
            if any(wanted):
                out = out & F.upper(name).isin(*[x.upper() for x in wanted])
        if self.polarisation:
            have = F.split(F.upper("polarisation"), r"\+")
            for p in self.polarisation.upper().split("+"):
                out = out & F.array_contains(have, p)
        if self.relative_orbit is not None:
            out = out & (F.col("track") == self.relative_orbit)
        if self.resolution_min is not None:
            out = out & (F.col("resolution_m") >= self.resolution_min)
        if self.resolution_max is not None:
            out = out & (F.col("resolution_m") <= self.resolution_max)
        if self.expression:
            out = out & F.expr(self.expression)
        return out

    def for_provider(self, provider: str) -> SceneQuery:
        """The query with the fields that hold for one provider."""
        return replace(self, **self.overrides.get(provider, {}), overrides={})


def keep_known(scenes: DataFrame, expression: str) -> DataFrame:
    """Rows of which a condition holds or cannot be told."""
    return scenes.filter(F.coalesce(F.expr(expression), F.lit(True)))


def deduplicate(scenes: DataFrame, keys: tuple[str, ...] = ("provider", "id"), order: Sequence[str | Column] = ("arrival",)) -> DataFrame:
    """The first row of each key in ``order``, which must tell rows of one key apart."""
    w = W.partitionBy(*keys).orderBy(*order)
    return scenes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def score(as_of: str) -> Column:
    """Half a point, clouds, recency and analysis-ready levels; at most 1."""
    s = F.when(F.col("cloud_cover").isNotNull(), F.lit(0.5) * 0.6 + 0.4 * (100 - F.col("cloud_cover")) / 100).otherwise(F.lit(0.5))
    days = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col("datetime").cast("date")))
    s = s + 0.3 * F.greatest(F.lit(0.0), 1 - days / 365)
    return F.least(F.lit(1.0), s + F.when(F.col("processing_level").isin(*ANALYSIS_READY), 0.1).otherwise(0.0))


def search(scenes: DataFrame, query: SceneQuery, as_of: str, order: Sequence[str | Column] = ("datetime",)) -> DataFrame:
    """The query's page of distinct scenes, best first or by its column; ties by id."""
    found = deduplicate(scenes.filter(query.predicate()), order=order).withColumn("score", score(as_of))
    by = F.col(query.sort_by or "score")
    best = found.orderBy(by.asc_nulls_last() if query.ascending else by.desc_nulls_last(), "id")
    return best.limit(query.limit) if query.page == 1 else best.offset((query.page - 1) * query.limit).limit(query.limit)


def federated(sources: dict[str, DataFrame], query: SceneQuery, as_of: str, capabilities: dict[str, set[str]] | None = None) -> DataFrame:
    """One search over several catalogs: each gets the query's fields for it, before they are united.

    capabilities: what a provider has (``sar``, ``optical``...); one without the query's product type is not read.
    """
    needed = "sar" if query.product_type or query.polarisation or query.pass_direction else None
    parts = []
    for rank, (name, scenes) in enumerate(sources.items()):
        if query.providers and name not in query.providers or needed and capabilities and needed not in capabilities.get(name, set()):
            continue
        parts.append(scenes.filter(query.for_provider(name).predicate()).withColumn("arrival", F.lit(rank)))
    if not parts:
        raise ValueError("no catalog can answer the query")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    found = deduplicate(both, order=("arrival", "datetime")).withColumn("score", score(as_of))
    return found.orderBy(F.desc("score"), "id").limit(query.limit)


def level_of(text: Column) -> Column:
    """The processing level named in a text, most specific first."""
    out = F.lit(None).cast("string")
    for token in reversed(("L2SP", "L2A", "L2", "L1TP", "L1C", "L1", "ARD")):
        out = F.when(F.upper(text).contains(token), token).otherwise(out)
    return out


def preflight(scenes: DataFrame, by: str = "provider") -> DataFrame:
    return scenes.groupBy(by).agg(
        F.count("*").alias("n_scenes"),
        F.countDistinct(F.col("datetime").cast("date")).alias("n_dates"),
        F.min("datetime").alias("first"),
        F.max("datetime").alias("last"),
        F.round(F.avg("cloud_cover"), 6).alias("mean_cloud"),
        F.sum((F.col("cloud_cover") <= 20).cast("long")).alias("n_clear"),
    )


def coverage(footprint: tuple[Column, ...], area: tuple[Column, ...]) -> Column:
    """The share of an area that a footprint covers; 0 for an area of none."""
    size = (area[2] - area[0]) * (area[3] - area[1])
    return F.coalesce(F.try_divide(shared_area(footprint, area), F.nullif(size, F.lit(0.0))), F.lit(0.0))


def organised(scenes: DataFrame) -> DataFrame:
    """The folder of each scene: day, track, satellite and level, each by a name of its own where unknown."""
    known = lambda c, name: F.coalesce(c.cast("string"), F.lit(f"unknown-{name}"))
    parts = [known(F.to_date("datetime"), "date"), known(F.col("track"), "orbit"), known(F.col("satellite"), "satellite"), known(F.col("processing_level"), "level")]
    return scenes.withColumn("folder", F.concat_ws("/", *parts))


def largest_track(scenes: DataFrame, most: int | None = None, preferred: int | None = None, by: str = "provider") -> DataFrame:
    """Scenes of one track for each ``by``: the preferred one where it occurs, else that with most scenes (the smallest of
    equals), in order of time, the first ``most``. Groups of fewer than two scenes are left out."""
    n = scenes.groupBy(by, "track").agg(F.count("*").alias("_n"), F.lit(True).alias("_one"))
    first = W.partitionBy(by).orderBy(F.desc(F.col("track") == F.lit(preferred)) if preferred is not None else F.lit(0), F.desc("_n"), "track")
    picked = n.withColumn("_r", F.row_number().over(first)).filter("_r = 1 AND _n >= 2").select(by, "track")
    out = scenes.join(picked, [by, "track"], "left_semi")
    if most is None:
        return out
    return out.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("datetime", "id"))).filter(F.col("_r") <= most).drop("_r")


def capabilities(scenes: DataFrame) -> DataFrame:
    """(provider, n_scenes, sar, optical, levels, collections, finest_m): what each provider of a catalog offers."""
    return scenes.groupBy("provider").agg(
        F.count("*").alias("n_scenes"), F.coalesce(F.bool_or(F.col("polarisation").isNotNull()), F.lit(False)).alias("sar"), F.coalesce(F.bool_or(F.col("sensor").isNotNull() & F.col("polarisation").isNull()), F.lit(False)).alias("optical"),
        F.array_sort(F.collect_set("processing_level")).alias("levels"), F.array_sort(F.collect_set("collection")).alias("collections"), F.min("resolution_m").alias("finest_m"),
    )


def with_capability(offers: DataFrame, sar: bool = False, optical: bool = False, level: str | None = None) -> DataFrame:
    """The providers that have all that is asked for."""
    out = offers
    for wanted, name in ((sar, "sar"), (optical, "optical")):
        if wanted:
            out = out.filter(name)
    return out.filter(F.array_contains("levels", level)) if level else out
