"""The n-gram join where many texts share shingles: no pair is lost, and forms do not meet."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from geolathe.llm import ngram_join
from geolathe.llm._tables import stage
from test_operators import _links, _same_components


def _met(sets: list[np.ndarray], shared: np.ndarray, group: np.ndarray) -> Counter:
    """Pairs of groups and how often they count, as a matrix of one bucket gives them."""
    rows = []
    for s, g in zip(sets, group):
        t, late = ngram_join._prefix(s, shared, 1, 80)
        rows += [(x & np.uint64(0xFFFFFFFF), g, len(s), len(s) - i, late) for i, x in enumerate(t)]
    t, g, z, r, c = (np.array(x, np.int64) for x in zip(*rows))
    t, g, lo, hi, rest, late = ngram_join._reduced(np.lexsort((g, t)), [t.astype(np.uint32), g], z, z, r, c)
    known = ngram_join._among(t.astype(np.uint64), shared)
    return Counter((a, b) for x in ngram_join.meet(t, g, lo, hi, rest, 80, late, known) for a, b in zip(*(y.tolist() for y in x)))


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_count_enough_whatever_is_shared(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.choice(300, rng.integers(4, 40), replace=False)) for _ in range(40)]
    sets += [np.unique(np.concatenate((rng.permutation(s)[: len(s) - rng.integers(0, 4)], rng.choice(300, rng.integers(0, 4))))) for s in sets for _ in range(3)]
    sets = [s.astype(np.uint64) for s in sets if len(s) >= 3]
    shared = np.sort(rng.choice(300, (0, 20, 100, 200, 290, 300)[seed], replace=False)).astype(np.uint64)
    group = rng.integers(0, 70, len(sets))
    met = _met(sets, shared, group)
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if group[i] != group[j] and 100 * both >= 80 * (len(a) + len(b) - both):
                linked += 1
                assert met[tuple(sorted((int(group[i]), int(group[j]))))] >= ngram_join.MATCHES
    assert linked > 20


@pytest.mark.parametrize("form", [11, 12, 20])
def test_forms_do_not_meet(form):
    """Texts with a form's words in common, too few to link: a constant number of words of their own, put before the form's."""
    own, n = max(3, form // 6), 1500
    common = np.arange(form - 4, dtype=np.uint64)
    sets = [np.concatenate((common, np.arange(own + 4, dtype=np.uint64) + np.uint64(1000 + 50 * i))) for i in range(n)]
    assert not _met(sets, common, np.arange(n))


def _rows_met(spark, texts: list[str]) -> int:
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "forms")
    members = stage(docs.selectExpr("doc_id AS doc", "doc_id AS g", "10L AS size"), "members")
    sets, suspects = ngram_join.survey(docs)
    shared = np.unique(ngram_join._keys(ngram_join._told(suspects.groupBy("shingle").sum("n").toDF("shingle", "n"), ngram_join.SHARED), 16))
    return ngram_join.matrix(docs, members, shared, 16).filter("kind = 1").count()


def test_form_letters_meet_in_proportion(spark):
    form = "we thank you for your order and send it to you soon"
    make = lambda n: [f"{form} q{i}a q{i}b q{i}c" for i in range(n)]
    few, many = (_rows_met(spark, make(n)) for n in (1000, 2000))
    assert few <= 100 and many <= 200  # all pairs: 499,500 and 1,999,000
    _same_components(spark, dict(enumerate(make(60) + [f"{form} q3a q3b q3c q3d", f"{form} q3a q3b"])))


@pytest.mark.parametrize("shared,crowd", [(4, 3), (64, 512), (2, 6)])
def test_texts_of_common_passages(spark, monkeypatch, shared, crowd):
    monkeypatch.setattr(ngram_join, "SHARED", shared)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 200)
    rng = random.Random(shared)
    passages = [[f"p{k}w{j}" for j in range(25)] for k in range(6)]
    texts = {}
    for i in range(140):
        w = sum(rng.sample(passages, rng.randint(1, 3)), [])
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        texts[i] = " ".join(w + [f"own{i}"] * rng.choice((0, 1, 4)))
    assert len({c for _, c in _links(list(texts.items())).values()}) > 5
    _same_components(spark, texts)
