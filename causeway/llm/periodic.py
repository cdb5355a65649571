"""Periodic runs of words: stretches that repeat a period of q words at least four times.

A run of period q and length L has L - q words in common with itself moved by q. The
least such overlap of any run gives k: within a run every k words in a row come again in
the document, so words outside repeated k-grams join no run. Only the stretches that
survive this mask are searched, by Main and Lorentz's division: a run that crosses the
middle of its stretch, or of a half of it, and so on, has two whole periods on one side
of that middle. All middles and periods of one depth are tried together by comparing
hashes of two neighbouring periods; those that agree are extended to both sides.

Texts stay where they are read: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks, releasing, texts_of
from .kernels import Words, covered, gathered, mix, prefix_hash, ramp, runs, span_hash, window_starts

U64 = np.uint64
RUNS = "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def least_overlap(least: int, times: int) -> int:
    """Fewest words that a run has in common with itself moved by its period, over all periods."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def masked(value: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches in which every k words in a row come again in their document.

    value: a hash a word; counts: words of each document. A stretch of one k-gram is none.
    """
    at = window_starts(counts, k)
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    gram = span_hash(prefix_hash(value, 1), at, at + k, 1)
    order = np.lexsort((gram, doc))
    same = (gram[order][1:] == gram[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    place = np.zeros(len(value) + 1, dtype=bool)
    place[at[again]] = True
    # Windows of two documents never are neighbours, as a document's last k - 1 words begin none.
    begin, end = runs(place)
    return begin[end - begin > 1], (end + k - 1)[end - begin > 1]


class Extent:
    """How far equal words go on from two places of a hashed sequence, within their stretch."""

    def __init__(self, value: np.ndarray):
        self.prefix = prefix_hash(value, 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, a, a + n, 1) == span_hash(self.prefix, b, b + n, 1)

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest n <= most for which the n words from a and b on, or before them, are equal; by bisection."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low = np.where(open_ & ok, mid, low)
            high = np.where(open_ & ~ok, mid - 1, high)
        return low


def periodic_runs(value: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run within the stretches [begin, end) of a sequence, sorted.

    Middles of one depth are tried together, about `most` pairs of a middle and a period at a time.
    """
    extent = Extent(value)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def try_middles(lo: np.ndarray, hi: np.ndarray, b: np.ndarray, e: np.ndarray) -> None:
        mid, n = (lo + hi) // 2, (hi - lo) // times
        which, p = np.repeat(np.arange(len(lo)), n), ramp(n) + 1
        m = mid[which]
        for sign in (0, 1):  # two periods after the middle, or before it
            a = m - 2 * p * sign
            inside = (a >= b[which]) & (a + 2 * p <= e[which])
            ok = np.flatnonzero(inside)
            ok = ok[extent.equal(a[ok], a[ok] + p[ok], p[ok])]
            x, y, q = a[ok], a[ok] + p[ok], p[ok]
            left = extent.reach(x, y, x - b[which[ok]], True)
            right = extent.reach(y + q, x + q, e[which[ok]] - y - q, False)
            s, t = x - left, y + q + right
            run = t - s >= np.maximum(least, times * q)
            found.append((s[run], t[run], q[run]))

    lo, hi, b, e = begin, end, begin, end
    while len(lo):
        size = np.cumsum((hi - lo) // times)
        cut = 0
        while cut < len(lo):
            stop = max(cut + 1, int(np.searchsorted(size, (size[cut - 1] if cut else 0) + most, side="right")))
            try_middles(lo[cut:stop], hi[cut:stop], b[cut:stop], e[cut:stop])
            cut = stop
        mid = (lo + hi) // 2
        lo, hi, b, e = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(b, 2), np.tile(e, 2)
        keep = hi - lo >= least
        lo, hi, b, e = lo[keep], hi[keep], b[keep], e[keep]
    s, t, q = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    order = np.lexsort((q, t, s))
    s, t, q = s[order], t[order], q[order]
    # A run is also found by multiples of its period.
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s[first], t[first], q[first]


def spoilt(ids: list[int | None], counts: np.ndarray, one_in: int = 10) -> np.ndarray:
    """For each word the word of its document that stands there, where a share of documents repeat a period to their end."""
    source = ramp(counts)
    first = np.cumsum(counts) - counts
    for d in range(len(counts)):
        n = int(counts[d])
        h = zlib.crc32(("" if ids[d] is None else str(ids[d])).encode())
        if n and h % one_in == 0:
            g = h // one_in
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[d] + a : first[d] + n] = a + np.arange(n - a) % p
    return source


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, one_in: int | None = None) -> DataFrame:
    """RUNS of every row: starts, lengths and periods of its runs, and its words without the later periods, joined by one space.

    A run is a stretch of words with smallest period q and at least max(least, times * q)
    words that no neighbouring word continues; times is at least 4. Null, empty and
    white-space texts have no words and no runs; very long texts are searched whole;
    rows given twice are two rows; an empty table gives an empty one; other columns are
    not read. With one_in, documents whose crc32 it divides are first made periodic from
    some word on, as a test of the search.
    """
    if times < 4 or least < times:
        raise ValueError("runs of fewer than four periods may leave the mask of repeated grams")
    k = least_overlap(least, times)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids = batch.column(0).to_pylist()
            words = Words(texts_of(batch.column(1)))
            counts, value = words.counts, mix(words.hashes())
            first = np.cumsum(counts) - counts
            doc = words.doc()
            source = np.arange(len(value))
            if one_in is not None:
                source = spoilt(ids, counts, one_in) + first[doc]
                value = value[source]
            s, t, q = periodic_runs(value, *masked(value, counts, k), least, times)
            keep = ~covered(len(value), s + q, t)
            at = np.searchsorted(np.cumsum(counts), s, side="right")
            cuts = np.searchsorted(at, np.arange(len(counts) + 1))
            offsets = pa.array(cuts, pa.int32())
            left = np.flatnonzero(keep)
            begins, sizes = words.starts[source[left]], (words.ends - words.starts)[source[left]] + 1
            flat = gathered(words.raw, begins, sizes)  # every word with the white space after it
            flat[np.cumsum(sizes) - 1] = 0x20
            edges = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(left, np.append(first, len(keep)))].tolist()
            raw = flat.tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (s - first[at], t - s, q)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "starts", "lengths", "periods", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(releasing(search), RUNS)


def summary(found: DataFrame) -> DataFrame:
    """A row a document of RUNS: how many runs, the longest one (ties: smallest start, then period), and digests of all runs and of the kept words."""
    each = F.arrays_zip("starts", "lengths", "periods")
    lines = F.array_join(F.transform(each, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n"))), "")
    best = F.array_min(F.transform(each, lambda r: F.struct((-r["lengths"]).alias("less"), r["starts"].alias("start"), r["periods"].alias("period"))))
    out = found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
