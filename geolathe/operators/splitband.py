"""Dispersive signal of a pair of complex images: the interferogram of the upper third of the band against that of the lower third."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stencil as st

PARTS = ("ref_re", "ref_im", "sec_re", "sec_im")


def _bands(z: np.ndarray, rate: float, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) thirds of lines (line, sample), where they are in the band."""
    f = np.fft.fftfreq(z.shape[1], 1 / rate)
    spectrum = np.fft.fft(z, axis=1)
    return tuple(np.fft.ifft(spectrum * (np.abs(f - at) <= bandwidth / 6), axis=1) for at in (-bandwidth / 3, bandwidth / 3))


def double_differences(pixels: DataFrame, rate: float, bandwidth: float, together: int = 1 << 18) -> DataFrame:
    """(scene_id, row, col, re, im, weight): the upper third's interferogram times the conjugate of the lower third's, and the product of their magnitudes.

    ``pixels``: (scene_id, row, col, ref_re, ref_im, sec_re, sec_im), both images on one grid, sampled in range at ``rate`` with a
    chirp of ``bandwidth`` hertz. A line is filtered as a whole, from its first sample to its last; samples that are missing
    or unknown count as 0 there and have null results. Of a sample given twice one counts.
    """
    p = pixels.select("scene_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(c).cast("double").alias(c) for c in PARTS])
    key = ["scene_id", "row"]
    dealt = p.repartition(*key).sortWithinPartitions(*key, "col")

    def compute(t: pa.Table) -> pa.RecordBatch:
        start = st._starts(t, key)
        n = np.diff(np.append(start, len(t)))
        col = t.column("col").to_numpy()
        ref_re, ref_im, sec_re, sec_im = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in PARTS)
        ref, sec = ref_re + 1j * ref_im, sec_re + 1j * sec_im
        known = np.isfinite(ref) & np.isfinite(sec)
        width = col[start + n - 1] - col[start] + 1
        out, weight = np.full(len(t), np.nan + 0j), np.full(len(t), np.nan)
        for w in np.unique(width):
            lines = np.flatnonzero(width == w)
            step = max(1, together // int(w))
            for k in range(0, len(lines), step):
                some = lines[k : k + step]
                rows = np.repeat(start[some], n[some]) + st._ranges(n[some])
                y, x = np.repeat(np.arange(len(some)), n[some]), col[rows] - np.repeat(col[start[some]], n[some])
                band = []
                for z in (ref, sec):
                    a = np.zeros((len(some), int(w)), complex)
                    a[y, x] = np.where(known[rows], z[rows], 0)
                    band.append(_bands(a, rate, bandwidth))
                low, high = (band[0][i] * np.conj(band[1][i]) for i in (0, 1))
                out[rows], weight[rows] = (high * np.conj(low))[y, x], (np.abs(high) * np.abs(low))[y, x]
        out[~known], weight[~known] = np.nan, np.nan
        columns = [t.column(c).combine_chunks() for c in ("scene_id", "row", "col")]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(v, from_pandas=True) for v in (out.real, out.imag, weight)]], names=["scene_id", "row", "col", "re", "im", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < together:
                continue
            t = pa.Table.from_batches(held)
            last = int(st._starts(t, key)[-1])  # the last line may go on
            if last:
                yield compute(t.slice(0, last))
                t = t.slice(last)
                held, size = t.to_batches(), len(t)
        if size:
            yield compute(pa.Table.from_batches(held))

    kind = p.schema["scene_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"scene_id {kind}, row long, col long, re double, im double, weight double")


def dispersive(pixels: DataFrame, rate: float, bandwidth: float, window: int = 5) -> DataFrame:
    """(scene_id, row, col, phase, coherence): the double difference's angle and how steady it is in a window, mirrored at the border.

    The coherence tells order from noise only; it is no estimate of the pair's own.
    """

    def steady(x: dict) -> dict:
        top = np.hypot(st.box_mean(x["re"], window), st.box_mean(x["im"], window))
        return {"coherence": top / np.maximum(st.box_mean(x["weight"], window), 1e-10)}

    d = st.stencil(double_differences(pixels, rate, bandwidth), window // 2, steady, ["coherence"], ["re", "im", "weight"])
    return d.select("scene_id", "row", "col", F.atan2("im", "re").alias("phase"), F.when(F.col("re").isNotNull(), F.col("coherence")).alias("coherence"), "re", "im")


def summary(found: DataFrame) -> DataFrame:
    """(scene_id, mean_magnitude, mean_coherence) over the known pixels."""
    return found.groupBy("scene_id").agg(F.avg(F.abs("phase")).alias("mean_magnitude"), F.avg("coherence").alias("mean_coherence"))
