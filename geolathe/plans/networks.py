"""Queries of acquisition networks and bursts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import network
from ..sources import tables as t
from .base import DATES, POINTS, add, r6, sr

_PAIR = f"(SELECT a.track, a.date AS d1, b.date AS d2 FROM {DATES} a JOIN {DATES} b ON a.track = b.track AND b.date > a.date AND date_diff('day', a.date, b.date) <= 3)"
_GAP = f"(SELECT *, date_diff('day', lag(date) OVER (PARTITION BY track ORDER BY date), date) AS gap FROM {DATES})"
_DEG = f"(SELECT track, d1 AS date FROM {_PAIR} UNION ALL SELECT track, d2 FROM {_PAIR})"
_PER = f"(SELECT d.track, d.date, count(e.date) AS degree FROM {DATES} d LEFT JOIN {_DEG} e ON d.track = e.track AND d.date = e.date GROUP BY ALL)"
add("network_stats", f"SELECT p.track, p.n_dates, p.n_pairs, c.n_components, p.min_degree, p.n_weak FROM (SELECT track, count(*) AS n_dates, CAST(sum(degree) / 2 AS BIGINT) AS n_pairs, min(degree) AS min_degree, count(CASE WHEN degree < 2 THEN 1 END) AS n_weak FROM {_PER} GROUP BY track) p JOIN (SELECT track, 1 + count(CASE WHEN gap > 3 THEN 1 END) AS n_components FROM {_GAP} GROUP BY track) c ON p.track = c.track")(
    lambda s, d: network.stats(t.track_dates(s, d), "track", 3)
)
_NEW = "date >= DATE '2024-01-20'"
_RANKED = f"(SELECT *, {_NEW} AS fresh, row_number() OVER (PARTITION BY track ORDER BY date) AS i FROM {DATES})"
add("incremental_pairs_new", f"SELECT DISTINCT track, least(a, b) AS d1, greatest(a, b) AS d2 FROM (SELECT x.track, x.date AS a, y.date AS b, row_number() OVER (PARTITION BY x.track, x.date ORDER BY abs(y.i - x.i), y.date) AS r FROM {_RANKED} x JOIN {_RANKED} y ON x.track = y.track AND x.i <> y.i AND abs(x.i - y.i) <= 3 WHERE x.fresh) WHERE r <= 3")(
    lambda s, d: network.incremental_pairs(t.track_dates(s, d).filter("date < '2024-01-20'"), t.track_dates(s, d).filter("date >= '2024-01-15'").filter("date >= '2024-01-20'"), "track", 3)
)
add("track_feasibility", f"SELECT track, {sr('max(n) / sum(n)')} AS share, CASE WHEN max(n) / sum(n) >= 0.8 THEN 'good' WHEN max(n) / sum(n) >= 0.3 THEN 'partial' ELSE 'poor' END AS verdict FROM (SELECT track, island, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY date) AS island FROM {_GAP}) GROUP BY ALL) GROUP BY track")(
    lambda s, d: network.feasibility(t.track_dates(s, d), "track", 2).withColumn("share", r6(F.col("share")))
)
add("master_date", f"SELECT track, arg_min(date, (far, date)) AS master FROM (SELECT *, greatest(date_diff('day', min(date) OVER (PARTITION BY track), date), date_diff('day', date, max(date) OVER (PARTITION BY track))) AS far FROM {DATES}) GROUP BY track")(lambda s, d: network.master(t.track_dates(s, d), "track"))
add("network_hash", f"SELECT track, sha256(string_agg(CAST(d1 AS VARCHAR) || '_' || CAST(d2 AS VARCHAR), ';' ORDER BY CAST(d1 AS VARCHAR) || '_' || CAST(d2 AS VARCHAR))) AS hash FROM {_PAIR} GROUP BY track")(lambda s, d: network.topology_hash(network.candidate_pairs(t.track_dates(s, d), "track", 3), "track"))
_POS = f"(SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS grp, c_custkey AS key, lat * 10 AS x, lon * 10 AS y, c_acctbal AS z FROM {POINTS})"
_BX, _LX = [f"(b.{c} - a.{c})" for c in "xyz"], [f"({g} - a.{c})" for c, g in zip("xyz", (5000.0, 100.0, 200.0))]
_dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"
add("min_max_baseline_reference", f"SELECT grp, arg_min(key, (round(worst, 9), key)) AS reference, {sr('min(worst)')} AS worst FROM (SELECT a.grp, a.key, max(sqrt(greatest(0.0, {_dot(_BX, _BX)} - {_dot(_BX, _LX)} * {_dot(_BX, _LX)} / nullif({_dot(_LX, _LX)}, 0)))) AS worst FROM {_POS} a JOIN {_POS} b ON a.grp = b.grp AND a.key <> b.key GROUP BY ALL) GROUP BY grp")(
    lambda s, d: network.reference_by_baseline(t.points(s, d).select(F.floor(F.col("c_custkey") / 8).alias("grp"), F.col("c_custkey").alias("key"), (F.col("lat") * 10).alias("x"), (F.col("lon") * 10).alias("y"), F.col("c_acctbal").alias("z")), "grp", "key", "xyz", (5000.0, 100.0, 200.0)).withColumn("worst", r6(F.col("worst")))
)


def _measured(s, d):
    """Pairs within 4 days with a baseline and a coherence of their own."""
    p = network.candidate_pairs(t.track_dates(s, d), "track", 4)
    h = F.pmod(F.col("track") * 7 + F.dayofyear("d1") * 13 + F.dayofyear("d2") * 29, F.lit(97))
    return p.withColumn("baseline", (h + 3).cast("double")).withColumn("coherence", F.pmod(h * 31, F.lit(101)) / 100)


add("sbas_network_select", None)(lambda s, d: network.select_network(_measured(s, d), "track", F.col("baseline") / F.greatest("coherence", F.lit(0.05)), F.col("coherence") >= 0.3))
add("sync_pairs_select", None)(lambda s, d: network.select_network(_measured(s, d), "track", F.abs(F.col("baseline") - 50), F.abs(F.col("baseline") - 50) < 20))
add("classify_pairs", None)(lambda s, d: network.classify_pairs(_measured(s, d), "track", F.col("coherence") >= 0.3))
add("thin_dates", None)(lambda s, d: network.thin(t.track_dates(s, d), "track", 6, thin_to=3, most=8))
_B = "(SELECT p_partkey % 40 AS swath, p_partkey AS burst, p_partkey // 40 * 2.75 AS start, 1500 + p_size AS lines FROM part)"
_END = "(start + lines * 0.002)"
_LINE = "OVER (PARTITION BY swath ORDER BY start)"
add("burst_row_ranges", f"SELECT swath, burst, CAST(coalesce(greatest(0, ceil(((lag({_END}) {_LINE} + start) / 2 - start) / 0.002 - 1e-9)), 0) AS BIGINT) AS keep_from, CAST(coalesce(least(lines, ceil(((lead(start) {_LINE} + {_END}) / 2 - start) / 0.002 - 1e-9)), lines) AS BIGINT) AS keep_to, CAST(least(lines, ceil((lead(start) {_LINE} - start) / 0.002 - 1e-9)) AS BIGINT) AS overlap_from FROM {_B}")(
    lambda s, d: network.burst_rows(t.read(s, d, "part").select((F.col("p_partkey") % 40).alias("swath"), F.col("p_partkey").alias("burst"), (F.floor(F.col("p_partkey") / 40) * F.lit(Decimal("2.75"))).alias("start"), (F.col("p_size") + 1500).alias("lines")), "swath", Decimal("0.002")).select("swath", "burst", "keep_from", "keep_to", "overlap_from")
)
_X = "(o_totalprice / 1000 - floor(o_totalprice / 1000 / 2.75) * 2.75)"
_Y = "(o_custkey / 100.0 - floor(o_custkey / 100.0 / 2.75) * 2.75)"
_OFF = f"({_X} - {_Y} + 1.375 - floor(({_X} - {_Y} + 1.375) / 2.75) * 2.75 - 1.375)"
_times = lambda s, d, c: t.read(s, d, "orders").select(F.col("o_orderkey").alias("pair"), c.alias("time"), (F.floor(c / 2.75) * 2.75).alias("start"))
add("burst_synchronisation", f"SELECT o_orderkey AS pair, {sr(_OFF)} AS \"offset\" FROM orders")(
    lambda s, d: network.burst_sync(_times(s, d, F.col("o_totalprice") / 1000), _times(s, d, F.col("o_custkey") / 100.0), 2.75).select("pair", r6(F.col("offset")).alias("offset"))
)
