"""Quality rules whose thresholds adapt to each language and source.

Every text gets a few measures. Their distribution per (language, source) goes into a quantile sketch of
relative-error buckets: sketches are rows of counts, so they merge by addition, in any order and from any
number of tasks, up to the language and the whole corpus. Every group's sketch has that of its language merged in,
scaled to PRIOR texts, and so has the language's that of the corpus: small groups lean on them, large ones do not.
A document is rejected if the logarithm of a measure lies beyond the far fence of its group, which the group's own
quartiles set alone.

Defined results: null or empty texts have all counts 0 and fail the base rules; a null language or source is
a group of its own; an empty table gives an empty result; other columns stay with the operator ``apply_rules``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import small, stage
from ._words import chunks, hash_spans, spans, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
#: Each measure is one count for each of another; True where too few are out as well as too many.
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words", False),
    "capitals_per_char": ("n_capitals", "word_chars", False),
    "shouts_per_word": ("n_shouts", "n_words", False),
    "repeat_share": ("n_repeat_words", "n_words", False),
    "dup_line_share": ("n_dup_lines", "n_lines", False),
    "chars_per_word": ("word_chars", "n_words", True),
}
#: Distance of the far fences from the quartiles, in distances between these.
FENCE = 3.0
#: A group's sketch counts beside so many texts of its language, and a language's beside so many of the corpus.
PRIOR, MILLION = 100, 1_000_000
#: Width of a bucket of the sketch, in logarithms: a quantile is off by about a hundredth of itself at most.
WIDTH = 0.02

_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_SYM = np.zeros(256, bool)
_SYM[list(b"#*$%&|<>")] = True
_CAP = np.zeros(256, bool)
_CAP[65:91] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(owner: np.ndarray, h: np.ndarray, first: bool) -> np.ndarray:
    """Which (owner, hash) items occur twice or more; without ``first`` the earliest of each is left out."""
    order = np.lexsort((h, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def text_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text."""
    n = len(off) - 1
    starts, ends, owner = spans(data, off)
    h = hash_spans(data, starts, ends)
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.bincount(owner, minlength=n)
    solid = np.zeros(len(data) + 1, np.int8)
    solid[starts] += 1
    solid[ends] -= 1
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    # adjoining words of two texts leave a zero step, which keeps the sum at 1
    out[:, 1] = _per_text(inside & ~_CONT[data], off)
    out[:, 2] = _per_text(_SYM[data], off)
    # lines with a word, as hashes of all their bytes
    breaks = np.flatnonzero(data == 10)
    a = np.unique(np.concatenate((off[:-1][off[1:] > off[:-1]], breaks + 1)))
    a = a[a < len(data)]
    of = np.searchsorted(off, a, "right") - 1
    b = np.concatenate((a[1:], [len(data)])) if len(a) else a
    b = np.minimum(b, off[of + 1])
    b = np.where((b > a) & (data[np.maximum(b - 1, 0)] == 10), b - 1, b) if len(a) else b
    worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, of = a[worded], b[worded], of[worded]
    out[:, 5] = np.bincount(of, minlength=n)
    out[:, 3] = np.bincount(of[_repeats(of, hash_spans(data, a, b), False)], minlength=n)
    if len(h) >= 5:
        same = owner[:-4] == owner[4:]
        at = np.flatnonzero(same)
        again = at[_repeats(owner[at], windows(h, 5)[at], True)]
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + 5, -1)
        out[:, 4] = np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=n)
    out[:, 6] = _per_text(_CAP[data], off)
    out[:, 7] = _per_text(_SHOUT[data], off)
    return out


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with COUNTS; columns of those names are replaced."""
    keep = [c for c in (keep or docs.columns) if c not in COUNTS]
    wanted = docs.select(*keep, *([] if text in keep else [text]))
    places = [wanted.columns.index(c) for c in keep]
    at = wanted.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_counts(data, off) for _, data, off in chunks(batch.column(at))]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + [pa.array(counts[:, i]) for i in range(len(COUNTS))], names=[*keep, *COUNTS])

    fields = wanted.select(*keep).schema
    for c in COUNTS:
        fields = fields.add(c, "long")
    return wanted.mapInArrow(run, fields)


def measures() -> dict[str, Column]:
    """The logarithm of each measure's share; one more on both sides keeps what never occurs finite, and short texts apart from long ones."""
    return {k: F.log((F.col(a) + 1) / (F.col(b) + 1)) for k, (a, b, _) in MEASURES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketch(counted: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, measure, bucket, n). Sketches merge by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.floor(v / WIDTH).cast("int").alias("bucket")) for k, v in measures().items()])).alias("m")
    return counted.select(*by, pairs).groupBy(*by, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    on = F.col(f"{a}.measure") == F.col(f"{b}.measure")
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def backed(own: DataFrame, by: list[str], wider: DataFrame, wide_by: list[str]) -> DataFrame:
    """The sketches ``own`` with those of the level above merged in, scaled to PRIOR texts; n in millionths of a text.

    ``wider`` has a row for each bucket of each of its groups, whose number the widths of the buckets bound.
    """
    total = wider.groupBy(*wide_by, "measure").agg(F.sum("n").alias("all"))
    share = wider.alias("w").join(F.broadcast(total).alias("t"), _same("w", "t", wide_by)).select("w.*", F.floor(F.col("w.n").cast("double") * (PRIOR * MILLION) / F.col("t.all")).cast("long").alias("part"))
    share = stage(share, "prior")
    groups = own.select(*by, "measure").distinct()
    lent = groups.alias("g").join(small(share).alias("s"), _same("g", "s", wide_by)).select(*[F.col(f"g.{c}").alias(c) for c in by], "g.measure", "s.bucket", F.col("s.part").alias("n"))
    both = own.select(*by, "measure", "bucket", (F.col("n") * MILLION).alias("n")).unionByName(lent)
    return both.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, q25, q75) of sketches."""
    key = W.partitionBy(*by, "measure")
    run = sketches.withColumn("seen", F.sum("n").over(key.orderBy("bucket"))).withColumn("all", F.sum("n").over(key))
    at = lambda q: (F.min(F.when(100 * F.col("seen") >= q * F.col("all"), F.col("bucket"))) + 0.5) * WIDTH
    return run.groupBy(*by, "measure").agg(at(25).alias("q25"), at(75).alias("q75"))


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): fences of every group that occurs, in logarithms."""
    own = stage(sketch(counted, [lang, source]), "sketch")
    merged = lambda by: own.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    languages = stage(backed(merged([lang]), [lang], stage(merged([]), "sketch"), []), "sketch")
    q = quartiles(backed(own, [lang, source], languages, [lang]), [lang, source])
    spread = FENCE * (F.col("q75") - F.col("q25"))
    out = []
    for k, (_, _, both) in MEASURES.items():
        mine = F.col("measure") == k
        out.append(F.max(F.when(mine, F.col("q75") + spread)).alias(f"{k}_high"))
        if both:
            out.append(F.min(F.when(mine, F.col("q25") - spread)).alias(f"{k}_low"))
    return q.groupBy(lang, source).agg(*out)


def _within() -> Column:
    good = F.lit(True)
    for k, v in measures().items():
        good = good & F.coalesce(v <= F.col(f"{k}_high"), F.lit(True))
        if MEASURES[k][2]:
            good = good & F.coalesce(v >= F.col(f"{k}_low"), F.lit(True))
    return good


def judged(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` (a staged table with COUNTS) with base_failed, kept and the fences used."""
    fences = stage(thresholds(counted.filter(~base_failed()), lang, source), "fences")
    limits = [c for c in fences.columns if c not in (lang, source)]
    on = F.col(f"d.{lang}").eqNullSafe(F.col(f"t.{lang}")) & F.col(f"d.{source}").eqNullSafe(F.col(f"t.{source}"))
    j = counted.alias("d").join(small(fences).alias("t"), on, "left").select("d.*", *[f"t.{c}" for c in limits])
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & _within())


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The counts are staged without the texts to set the fences; the texts are then counted again beside the
    fences, which costs less than to shuffle them.
    """
    slim = stage(with_counts(docs, text, [c for c in dict.fromkeys((lang, source))]), "counts")
    fences = stage(thresholds(slim.filter(~base_failed()), lang, source), "fences")
    counted = with_counts(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns]), f"d_{text}")
    on = F.col(f"d_{lang}").eqNullSafe(F.col(lang)) & F.col(f"d_{source}").eqNullSafe(F.col(source))
    j = counted.join(small(fences), on, "left")
    return j.filter(~base_failed() & _within()).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
