"""A Merkle manifest of a table: rows hashed to leaves, trees of fanout 3 within groups and over the groups' roots.

A level is one aggregate: the nodes of a parent spread into FANOUT columns by conditional aggregates (a slot pivot), whose
concatenation is hashed to the parent. The same columns without a node's own are its siblings: going down again, each
node's path is its siblings before and after it, ahead of its parent's path. Places come from running counts over ranges,
so neither a group nor the list of groups is gathered; levels shrink by FANOUT and are staged.

Defined results: null values hash as ``-``; a null group is a group of its own and first; rows of one id take the order of
their leaves, and whole repeats follow each other (each has its place and proof); a null id comes before all others and is
not tampered with; a text of any length is hashed whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import running_before, small, stage

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The hash of a row: each value's length in UTF-8 bytes, a colon and the value."""
    tell = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return hashed(*map(tell, values))


def _slots() -> list[str]:
    return [f"slot{i}" for i in range(FANOUT)]


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def level_up(nodes: DataFrame, group: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The parents (group, place, nodes) of the ``nodes`` (group, place, nodes of the level, hash): their hashes, and the slots with the children's."""
    pivot = [F.first(F.when(F.pmod("place", F.lit(FANOUT)) == i, F.struct("hash", *carried)), ignorenulls=True).alias(c) for i, c in enumerate(_slots())]
    up = nodes.groupBy(*group, F.floor(F.col("place") / FANOUT).cast("long").alias("place")).agg(F.max("nodes").alias("nodes"), *pivot)
    up = up.withColumn("nodes", F.ceil(F.col("nodes") / FANOUT).cast("long"))
    return up.withColumn("hash", hashed(F.concat_ws("", *[f"{c}.hash" for c in _slots()])))


def level_down(parents: DataFrame, group: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The children (group, place, hash, path) of ``parents`` with their paths: a step (before, after) of siblings ahead of the parent's."""
    each = []
    for i, c in enumerate(_slots()):
        before, after = (F.concat_ws("", F.lit(""), *[f"{x}.hash" for x in names]) for names in (_slots()[:i], _slots()[i + 1 :]))
        step = F.struct(before.alias("before"), after.alias("after"))
        each.append(F.struct((F.col("place") * FANOUT + i).alias("place"), F.concat(F.array(step), F.col("path")).alias("path"), *[F.col(f"{c}.{x}").alias(x) for x in ("hash", *carried)]))
    return parents.select(*group, F.inline(F.array(*each))).filter(F.col("hash").isNotNull())


def tree(leaves: DataFrame, group: Sequence[str] = (), carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (group, place from 0, nodes in the group, hash, carried; a staged table of slim rows).

    Gives the leaves (group, place, hash, carried, path) and the roots (group, hash). A path has a step (before, after) a
    level, the siblings' hashes on either side joined; a lone leaf is a root with an empty path.
    """
    no_path = F.array().cast("array<struct<before:string,after:string>>").alias("path")
    lone = F.col("nodes") == 1
    levels: list[DataFrame] = []
    now, more = leaves, leaves.agg(F.max("nodes")).first()[0] or 0
    while more > 1:
        levels.append(stage(level_up(now.filter(~lone), group, carried if now is leaves else ()), "level"))
        now, more = levels[-1], -(-more // FANOUT)
    roots = reduce(DataFrame.unionByName, [x.filter(lone).select(*group, "hash") for x in [leaves, *levels]])
    paths = None  # of the parents on the level at hand that are no roots
    for k in range(len(levels) - 1, -1, -1):
        ended = levels[k].filter(lone).withColumn("path", no_path)
        if paths is not None:
            inner = levels[k].filter(~lone).alias("l").join(paths.alias("r"), _same("l", "r", [*group, "place"])).select("l.*", "r.path")
            ended = ended.unionByName(inner)
        paths = level_down(ended, group, carried if k == 0 else ())
        if k:
            paths = paths.drop("hash")
    alone = leaves.filter(lone).select(*group, "place", "hash", *carried, no_path)
    return (alone if paths is None else paths.unionByName(alone)), roots


def counted(nodes: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``place`` in the group by ``order`` and the group's number of ``nodes``; staged."""
    slim = stage(nodes.withColumn("one", F.lit(1).cast("long")), "nodes")
    placed = running_before(slim, "one", order, group, "place")
    if not group:
        return stage(placed.withColumn("nodes", F.lit(slim.count())).drop("one"), "leaves")
    sizes = stage(slim.groupBy(*group).agg(F.sum("one").alias("nodes")), "sizes")
    joined = placed.alias("l").join(small(sizes).alias("r"), _same("l", "r", group)).select("l.*", "r.nodes")
    return stage(joined.drop("one"), "leaves")


def proof(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, left to right."""
    return hashed(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda now, x: F.sha2(F.concat(x["before"], now, x["after"]).cast("binary"), 256))


def manifest(leaves: DataFrame, group: str, order: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """(group, hash, carried, subroot, root, path) of each of ``leaves`` (group, hash, order, carried): trees in groups, and one over the groups in ascending order, null first."""
    rows, roots = tree(counted(leaves, [group], order), [group], carried)
    subroots = counted(roots.withColumnRenamed("hash", "subroot").withColumn("hash", F.col("subroot")), [], [group])
    tops, root = tree(subroots, (), [group, "subroot"])
    tops = stage(tops.crossJoin(F.broadcast(root.select(F.col("hash").alias("root")))).select(group, "subroot", "root", F.col("path").alias("upper")), "tops")  # one root
    joined = rows.alias("l").join(small(tops).alias("r"), _same("l", "r", [group]))
    return joined.select(f"l.{group}", "l.hash", *[f"l.{c}" for c in carried], "r.subroot", "r.root", F.concat("l.path", "r.upper").alias("path"))


def op_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with a check of each row against the root after tampering with some."""
    values = [F.col(c) for c in FIELDS]
    tampered = leaf_of(*values[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaf = docs.withColumn("hash", leaf_of(*values)).select("doc_id", "source", "hash", F.when(touched, tampered).otherwise(F.col("hash")).alias("presented"), F.monotonically_increasing_id().alias("row"))
    found = manifest(leaf, "source", ["doc_id", "hash", "row"], ["doc_id", "presented"])
    found = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("presented"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
