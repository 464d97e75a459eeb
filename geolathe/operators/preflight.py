"""Checks of scenes before they are fetched: an array of issues, measures and a verdict for each scene, all as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import BOX, coverage

ERROR, WARNING = "error", "warning"
# Names that stand for a band.
ALIASES = {"BLUE": "B02", "GREEN": "B03", "RED": "B04", "NIR": "B08", "NIR08": "B08", "RED_EDGE": "B05", "SWIR16": "B11", "SWIR22": "B12", "SWIR1": "B11", "SWIR2": "B12", "B2": "B02", "B3": "B03", "B4": "B04", "B8": "B08"}
# Ways to write a processing level.
LEVELS = {"LEVEL-1C": "L1C", "LEVEL-2A": "L2A", "S2MSI1C": "L1C", "S2MSI2A": "L2A", "LEVEL1C": "L1C", "LEVEL2A": "L2A"}


@dataclass(frozen=True)
class Rules:
    """Which checks are made, and their thresholds; None leaves a check out."""

    area: tuple[float, float, float, float] | None = None
    least_coverage: float | None = 0.9
    cloud_max: float | None = 20.0
    cloud_is_error: bool = True
    snow_max: float | None = 50.0
    bands: tuple[str, ...] = ()
    level: str | None = None
    margin_deg: float | None = 0.01
    margin_share: float = 0.5
    start: str | None = None
    end: str | None = None
    warnings_count: bool = False


def _mapped(x: Column, table: dict[str, str]) -> Column:
    up = F.upper(x)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), up), up)


def band_names(keys: Column) -> Column:
    """Asset keys by their bands' own names."""
    return F.transform(keys, lambda k: _mapped(k, ALIASES))


def matching_bands(keys: Column, wanted: Sequence[str], strict: bool = True) -> Column:
    """The asset keys that hold the wanted bands, in their order; where none does and ``strict`` is off, all keys."""
    canon = [ALIASES.get(b.upper(), b.upper()) for b in wanted]
    found = F.filter(keys, lambda k: _mapped(k, ALIASES).isin(*canon))
    return found if strict else F.when(F.size(found) > 0, found).otherwise(keys)


def level_matches(level: Column, expected: str) -> Column:
    """Unknown levels pass."""
    want = LEVELS.get(expected.upper(), expected.upper())
    return F.coalesce(_mapped(level, LEVELS) == want, F.lit(True))


def validated(scenes: DataFrame, rules: Rules) -> DataFrame:
    """``scenes`` with ``issues`` (code, severity), ``n_errors``, ``n_warnings``, ``aoi_coverage`` and ``passed``.

    Columns that a check needs and the scenes lack (snow_cover, bands) count as unknown: no snow, no bands.
    """
    have = lambda c, kind: F.col(c) if c in scenes.columns else F.lit(None).cast(kind)
    issues: list[Column] = []

    def check(bad: Column, code: str, severity: str) -> None:
        issues.append(F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))))

    foot = tuple(F.col(c) for c in BOX)
    nowhere = F.greatest(*[c.isNull().cast("int") for c in foot]) == 1
    covered = F.lit(None).cast("double")
    if rules.area:
        area = tuple(map(F.lit, rules.area))
        covered = F.when(~nowhere, coverage(foot, area))
        if rules.least_coverage is not None:
            check(nowhere, "NO_FOOTPRINT", ERROR)
            check(covered < rules.least_coverage, "LOW_AOI_COVERAGE", ERROR)
    if rules.cloud_max is not None:
        check(F.coalesce("cloud_cover", F.lit(0.0)) > rules.cloud_max, "CLOUD_COVER_EXCEEDED", ERROR if rules.cloud_is_error else WARNING)
    if rules.snow_max is not None:
        check(F.coalesce(have("snow_cover", "double"), F.lit(0.0)) > rules.snow_max, "SNOW_ICE_COVER_EXCEEDED", WARNING)
    if rules.bands:
        canon = F.array(*[F.lit(ALIASES.get(b.upper(), b.upper())) for b in rules.bands])
        check(F.size(F.array_except(canon, band_names(F.coalesce(have("bands", "array<string>"), F.array().cast("array<string>"))))) > 0, "MISSING_BANDS", ERROR)
    if rules.level:
        check(~level_matches(F.col("processing_level"), rules.level), "PROCESSING_LEVEL_MISMATCH", ERROR)
    if rules.area and rules.margin_deg is not None:
        m = rules.margin_deg
        inner = (foot[0] + m, foot[1] + m, foot[2] - m, foot[3] - m)
        check(~nowhere & (coverage(inner, tuple(map(F.lit, rules.area))) < rules.margin_share), "NODATA_MARGIN_RISK", WARNING)
    day = F.to_date("datetime")
    early = day < F.lit(rules.start).cast("date") if rules.start else F.lit(False)
    late = day > F.lit(rules.end).cast("date") if rules.end else F.lit(False)
    if rules.start or rules.end:
        check(F.coalesce(early | late, F.lit(False)), "OUT_OF_TEMPORAL_BOUNDS", ERROR)
    out = scenes.withColumn("issues", F.array_compact(F.array(*issues)) if issues else F.array().cast("array<struct<code:string,severity:string>>")).withColumn("aoi_coverage", covered)
    count = lambda s: F.size(F.filter("issues", lambda i: i.severity == s))
    out = out.withColumn("n_errors", count(ERROR)).withColumn("n_warnings", count(WARNING))
    return out.withColumn("passed", (F.col("n_errors") == 0) & (F.lit(not rules.warnings_count) | (F.col("n_warnings") == 0)))


def passing(scenes: DataFrame, rules: Rules) -> DataFrame:
    """The scenes that pass, as they came."""
    return validated(scenes, rules).filter("passed").select(*scenes.columns)


def severity(report: DataFrame, by: str) -> DataFrame:
    """(by, severity): the worst of a group's issues; ``ok`` where there is none."""
    worst = F.max(F.when(F.col("n_errors") > 0, 2).when(F.col("n_warnings") > 0, 1).otherwise(0))
    return report.groupBy(by).agg(F.element_at(F.array(F.lit("ok"), F.lit(WARNING), F.lit(ERROR)), worst + 1).alias("severity"))


def complex_faults(pixels: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Why complex data (re, im) cannot be used: not finite, no imaginary part, no variation; empty where it can."""
    finite = ~F.isnan("re") & ~F.isnan("im") & F.col("re").isNotNull() & F.col("im").isNotNull()
    a = pixels.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(finite, 1)).alias("good"), F.max(F.when(finite, F.abs("im"))).alias("im"), F.stddev_pop(F.when(finite, F.hypot("re", "im"))).alias("sd"))
    return a.select(*by, F.array_compact(F.array(F.when(F.col("good") < F.col("n"), "not finite"), F.when(F.coalesce("im", F.lit(0.0)) == 0, "no imaginary part"), F.when(F.coalesce("sd", F.lit(0.0)) == 0, "no variation"))).alias("faults"))


def coherence_faults(pixels: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """(by, n_outside): values of ``v`` outside [0, 1]."""
    return pixels.groupBy(*by).agg(F.count(F.when((F.col("v") < 0) | (F.col("v") > 1), 1)).alias("n_outside"))
