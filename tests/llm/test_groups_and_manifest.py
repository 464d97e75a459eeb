"""Clusters by bit planes, SimHash groups and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from geolathe.llm import bitplanes, components, merkle, simhash
from geolathe.llm._tables import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# clusters


def plain_clusters(rows: list[tuple]) -> tuple[Counter, list]:
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(fine, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"2:{r[0]}"), r[1]))[: bitplanes.CLUSTERS]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(bitplanes.ROUNDS):
        own = defaultdict(list)
        for _, v in fine:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in fine]
    inertia, total = Counter(), sum(d for _, d, _ in found)
    for _, d, k in found:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], total, sha(",".join(map(str, centroids[k])))) for i, d, k in found), centroids


def vector_rows() -> list[tuple]:
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((6, 64))[rng.integers(0, 6, 150)] * 2 + rng.standard_normal((150, 64)) * 0.3).astype(np.float32).tolist()
    rows = list(enumerate(v))
    same = [1.0] * 64
    rows += [(200 + i, same) for i in range(45)]  # equal centroids: the first wins, others stay empty
    rows += [(300, None), (301, [1.0] * 63), (302, [None, *same[1:]]), (303, [float("nan"), *same[1:]]), (304, [float("-inf"), *same[1:]]), (305, [1e30, *same[1:]]), (306, []), (None, v[0]), (None, v[1])]
    return rows + [rows[0], (7, v[9]), (400, [0.0] * 64), (401, [-0.001] * 64)]


@pytest.mark.parametrize("some", [slice(None), slice(0, 5)])
def test_clusters(spark, some):
    rows = vector_rows()[some]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS id").repartition(3)
    got = bitplanes.op_cluster(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want, _ = plain_clusters([r for r in rows if r[0] != 305])
    assert Counter(map(tuple, got.collect())) == want


def test_no_vectors_to_cluster(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert bitplanes.op_cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 300, 1 << 20, (1 << 27) - 1])
def test_plane_products(size):
    rng = np.random.default_rng(size)
    x, y = (rng.integers(-size, size, (n, 64)) for n in (50, 9))
    planes = max(int(max(x.max(), y.max())), -int(min(x.min(), y.min())) - 1).bit_length() + 1
    a, b = bitplanes.pack(x, planes), bitplanes.pack(y, planes)
    assert (bitplanes.unpack(a) == x).all() and (bitplanes.products(a, b) == x @ y.T).all()
    at, d = bitplanes.nearest(a, (x * x).sum(1), y, b)
    full = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (d == full.min(1)).all() and (at == full.argmin(1)).all()


# near groups


def plain_print(text: str | None) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(prints: list[int]) -> list[int]:
    """For each distinct fingerprint the place of the first of its group."""
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdÉß", k=rng.randint(1, 6))) for _ in range(200)]
    make = lambda n: rng.choices(words, k=n)
    out: list[str | None] = [" ".join(make(rng.randint(1, 60))) for _ in range(30)]
    for _ in range(6):
        base = make(400)
        for _ in range(6):
            w = list(base)
            w[rng.randrange(400)] = "edited"
            out.append("\t".join(w))
    long = " ".join(make(3 * simhash.COUNTED // 2))
    return out + [None, "", " \n\x0b ", "one", "One", "one two", "ONE\n two", "a b c", "a b c a b c", long, long.upper(), "\xa0 x", "x" * 3_000_000] + out[:4]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 1000)
    rows = [*texts(), " ".join(str(i) for i in range(2503))]
    assert simhash.fingerprints(pa.array(rows)).tolist() == [plain_print(t) for t in rows]
    assert simhash.fingerprints(pa.array(rows).slice(40, 5)).tolist() == [plain_print(t) for t in rows[40:45]]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_near_groups(spark):
    rows = [(i * 3, t, "mine") for i, t in enumerate(texts())]
    rows += [rows[0], (1, rows[3][1], "mine"), (None, rows[3][1], None), (None, "text that nobody else has", None), (rows[4][0], rows[5][1], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _f string").selectExpr("*", "0 AS fingerprint", "text AS c", "doc_id AS id", "0 AS component_id").repartition(3)
    got = simhash.near_groups(table)
    assert sorted(got.columns) == sorted(table.columns)
    prints = {t: plain_print(t) for _, t, _ in rows}
    known = sorted(set(prints.values()))
    group = dict(zip(known, plain_groups(known)))
    lowest: dict = {}
    for i, t, _ in rows:
        g = group[prints[t]]
        lowest[g] = min(lowest.get(g, i), i) if i is not None and lowest.get(g) is not None else (i if i is not None else lowest.get(g))
    want = Counter((i, t, f"{prints[t]:016x}", lowest[group[prints[t]]], m) for i, t, m in rows)
    assert Counter((r["doc_id"], r["text"], r["fingerprint"], r["component_id"], r["_f"]) for r in got.collect()) == want
    assert len(set(lowest.values())) < len(known)
    assert simhash.near_groups(table.limit(0)).count() == 0


def planted(n: int, dense: int) -> list[int]:
    """Random fingerprints, pairs at 1 to 5 bits from them, chains, and one dense ball."""
    rng = random.Random(n)
    out = [rng.getrandbits(64) for _ in range(n)]
    for f in out[: n // 2]:
        for k in range(1, 6):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            out.append(g)
    f = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 3):
            f ^= 1 << b
        out.append(f)
    ball = rng.getrandbits(64)
    for _ in range(dense):
        g = ball
        for b in rng.sample(range(32), rng.randint(0, 4)) + rng.sample(range(32, 64), rng.randint(0, 2)):
            g ^= 1 << b
        out.append(g)
    return sorted({*out, 0, (1 << 64) - 1, 1 << 63, 7})


@pytest.mark.parametrize("sample,shard", [(100_000, 1 << 13), (300, 60), (200, 8)])
def test_links_of_trees_connect_what_all_pairs_do(spark, monkeypatch, sample, shard):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "STREAM", 50)
    prints = planted(300, 250)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = stage(spark.createDataFrame([(x,) for x in signed], "f long").repartition(4), "prints")
    links = stage(simhash.link_forest(table, sample, shard), "links")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    classes = defaultdict(set)
    for f, g in zip(signed, plain_groups(prints)):
        classes[g].add(f)
    found = defaultdict(set)
    for f in signed:
        found[got.get(f, f)].add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))
    assert links.count() < 12 * len(prints)  # no list of pairs


def test_two_members_meet_in_one_leaf_at_most():
    prints = np.array(planted(400, 0), np.uint64)
    for half in simhash.HALVES:
        root, leaves = simhash.grow(prints, half, 20)
        homes, meets = Counter(), Counter()

        def visit(leaf: int, m: np.ndarray, v: np.ndarray) -> None:
            homes.update(m.tolist())
            meets.update(tuple(sorted((a, b))) for a in v.tolist() for b in m.tolist())
            meets.update((a, b) for a in m.tolist() for b in m.tolist() if a < b)

        simhash.descend(root, prints, np.arange(len(prints)), np.zeros(0, np.int64), visit)
        assert leaves > 10 and set(homes.values()) == {1} and max(meets.values()) == 1
        d = np.bitwise_count((prints[:, None] ^ prints[None]) & np.uint64(half))
        whole = np.bitwise_count(prints[:, None] ^ prints[None])
        a, b = np.nonzero(np.triu((d <= 1) & (whole <= 3), 1))
        assert all(meets[x] for x in zip(a.tolist(), b.tolist()))
        assert len(meets) < 0.8 * len(prints) ** 2 / 2


# manifest


def plain_manifest(rows: list[tuple]) -> Counter:
    tell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha(*map(tell, r))

    def grown(leaves: list[str]) -> tuple[str, list]:
        paths: list[list] = [[] for _ in leaves]
        under = [[i] for i in range(len(leaves))]
        while len(leaves) > 1:
            up, above = [], []
            for a in range(0, len(leaves), 3):
                run = leaves[a : a + 3]
                for k in range(len(run)):
                    for i in under[a + k]:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha(*run))
                above.append([i for u in under[a : a + 3] for i in u])
            leaves, under = up, above
        return leaves[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(grown([leaf(r) for r in groups[s]]))
    root, tops = grown([t[0] for t in trees])
    out: Counter = Counter()
    for s, (sub, paths), top in zip(names, trees, tops):
        for r, path in zip(groups[s], paths):
            now = leaf((*r[:4], r[4].replace("\n", ""))) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf(r)
            for before, after in path + top:
                now = sha(before, now, after)
            out[r[0], leaf(r), sub, root, sha(*[a + b for a, b in path + top]), now, now == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows() -> list[tuple]:
    rng = random.Random(8)
    rows = [(i, ["hot", "hot", "b", "é", None, "Z"][i % 6] if i % 7 else "hot", rng.choice(["en", None, "日本"]), rng.choice([None, i, -5]), rng.choice([None, "", "a\nb", "\n", "plain", "é\r\n" * 3])) for i in range(120)]
    rows += [rows[5], rows[5], (None, "hot", None, None, None), (None, None, "x", 1, "y\nz"), (8, "hot", "en", 1, "same id\n"), (-4, "lone", "en", 2, "a\n"), (1 << 62, "pair", "en", 2, "a\n"), (3, "pair", "en", 2, "-"), (4, "", "", 0, "word\n" * 50_000)]
    return rows


@pytest.mark.parametrize("some", [slice(None), slice(0, 1), slice(0, 9), slice(-4, -3)])
def test_manifest(spark, some):
    rows = manifest_rows()[some]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS hash", "2 AS place", "3 AS nodes", "4 AS path", "5 AS root").repartition(4)
    got = merkle.op_manifest(table)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert merkle.op_manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_any_change_of_a_leaf_is_seen(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    root = {r["root"] for r in merkle.op_manifest(frame(rows)).collect()}
    for k, changed in ((0, (0, "s", "en", 1, "text 00")), (13, (13, "s", None, 1, "text 13")), (29, (29, "t", "en", 1, "text 29"))):
        assert {r["root"] for r in merkle.op_manifest(frame([*rows[:k], changed, *rows[k + 1 :]])).collect()} != root
    assert {r["root"] for r in merkle.op_manifest(frame(rows[::-1])).collect()} == root
