"""Orbits: states between vectors, and tables between their lines, as equality joins on ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .network import asof


def interpolated(vectors: DataFrame, targets: DataFrame, key: str, time: str, values: Sequence[str], id_: str, degree: int = 4) -> DataFrame:
    """``targets`` (id_, key, time) with ``values`` by Lagrange's formula over the ``degree`` + 1 vectors around the nearest one.

    Times are numbers. At an orbit's ends the first or last vectors are used; an orbit with fewer gives nulls.
    """
    w = W.partitionBy(key).orderBy(time)
    v = vectors.select(key, time, *values).withColumn("_i", F.row_number().over(w) - 1).withColumn("_next", F.lead(time).over(w))
    n = v.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    last = v.select(key, time, F.struct("_i", F.col(time).alias("_t"), "_next").alias("_at"))
    t = asof(targets.select(id_, key, time), last, key, time, "_at").join(n, key)
    near = F.when(F.col("_at").isNull(), 0).when(F.col("_at._next") - F.col(time) < F.col(time) - F.col("_at._t"), F.col("_at._i") + 1).otherwise(F.col("_at._i"))
    first = F.greatest(F.lit(0), F.least(near - degree // 2, F.col("_n") - degree - 1))
    t = t.select(id_, key, F.col(time).alias("_x"), F.explode(F.sequence(first, first + degree)).alias("_i"))
    around = t.join(v.withColumnRenamed(time, "_t"), [key, "_i"]).groupBy(id_, "_x").agg(F.collect_list(F.struct("_t", *values)).alias("_p"))  # degree + 1 of them

    def formula(name: str):
        def term(total, p):
            part = F.aggregate("_p", F.lit(1.0), lambda a, q: F.when(q["_t"] == p["_t"], a).otherwise(a * (F.col("_x") - q["_t"]) / (p["_t"] - q["_t"])))
            return total + p[name] * part

        return F.when(F.size("_p") == degree + 1, F.aggregate("_p", F.lit(0.0), term)).alias(name)

    return targets.join(around.select(id_, *map(formula, values)), id_, "left")


def table_values(table: DataFrame, targets: DataFrame, key: str, id_: str) -> DataFrame:
    """``targets`` (id_, key, line, pixel) with ``value``: between the entries (key, line, pixel, value) of a calibration table.

    Along a line values are linear between pixels and held beyond the first and last one; so they are between lines.
    """
    lines = table.select(key, "line").distinct().withColumn("_after", F.lead("line").over(W.partitionBy(key).orderBy("line")))
    first = lines.groupBy(key).agg(F.min("line").alias("_first"))
    t = asof(targets.select(id_, key, "line", "pixel"), lines.select(key, "line", F.struct(F.col("line").alias("_lo"), "_after").alias("_at")), key, "line", "_at").join(first, key)
    lo = F.coalesce("_at._lo", "_first")
    hi = F.coalesce("_at._after", lo)
    part = F.when(F.col("_at").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("line") - lo, hi - lo), F.lit(0.0)))
    t = t.select(id_, key, "pixel", F.explode(F.array(F.struct(lo.alias("l"), (1 - part).alias("w")), F.struct(hi.alias("l"), part.alias("w")))).alias("x")).select(id_, key, "pixel", "x.w", F.concat_ws("/", F.col(key).cast("string"), F.col("x.l").cast("string")).alias("_row"))
    w = W.partitionBy("_row").orderBy("pixel")
    entries = table.withColumn("_row", F.concat_ws("/", F.col(key).cast("string"), F.col("line").cast("string"))).select("_row", "pixel", "value")
    entries = entries.withColumn("_at", F.struct(F.col("pixel").alias("p"), F.col("value").alias("v"), F.lead("pixel").over(w).alias("q"), F.lead("value").over(w).alias("u")))
    ends = entries.groupBy("_row").agg(F.min_by("value", "pixel").alias("_v"))
    near = asof(t, entries.select("_row", "pixel", "_at"), "_row", "pixel", "_at").join(ends, "_row")
    share = F.try_divide(F.col("pixel") - F.col("_at.p"), F.col("_at.q") - F.col("_at.p"))
    value = F.when(F.col("_at").isNull(), F.col("_v")).otherwise(F.col("_at.v") + F.coalesce(share * (F.col("_at.u") - F.col("_at.v")), F.lit(0.0)))
    return targets.join(near.groupBy(id_).agg(F.sum(F.col("w") * value).alias("value")), id_, "left")
