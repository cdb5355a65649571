"""Spelling variants of a corpus's words, by a rare-first prefix filter on positional bigrams.

Words are counted where the texts are read. The bigrams of all different words are
then put in one global order, the rarest first. One edited code point spoils at most
two of a word's bigrams, so of the three rarest of each of two near words at least one
is untouched in both, at places that differ by one at most; words meet at their three
rarest bigrams only.

Where an untouched bigram splits two near words, one side is equal and the other holds
the edit. Half of the other side is equal as well, counted from its outer or its inner
end. That is the limit on positions: a word posts each of its three bigrams with an equal
side and an equal half, for its own length and for that of a word with a code point
less. Groups are so small that each is compared in its task; a group that is not is cut
into tiles, and each pair of tiles is one task's. Candidates are verified by their common
beginnings and ends.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks, durable, releasing, texts_of
from .kernels import BYTE_CODES, LOWER, gathered, mix, prefix_hash, ramp, span_hash
from .tiles import candidate_pairs, grouped, tiled

U64 = np.uint64
#: Postings of one group that one task compares; a larger group is cut into tiles.
TILE = 20_000


@functools.cache
def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def crc32_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start : start + size] for all spans, continued from the checksums begun."""
    table, out = crc_table(), np.empty(len(starts), dtype=np.uint32)
    long = np.flatnonzero(sizes > 64)
    for i in long.tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]].tobytes(), int(begun[i]))
    short = np.flatnonzero(sizes <= 64)
    short = short[np.argsort(-sizes[short], kind="stable")]
    size, at = sizes[short], starts[short]
    c = ~begun[short]
    for j in range(int(size.max(initial=0))):
        k = int(np.searchsorted(-size, -j, side="left"))
        c[:k] = table[(c[:k] ^ raw[at[:k] + j]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    out[short] = ~c
    return out


class Runs:
    """The letter runs of some texts with at least `least` code points, as code points of one byte each."""

    def __init__(self, ids: list[str], texts: list[bytes], least: int):
        raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        low = (raw >= 0x80) & (raw < 0xC0)
        lead = np.zeros(len(raw), dtype=bool)
        lead[:-1] = (raw[:-1] == 0xC3) & low[1:]
        second = np.zeros(len(raw), dtype=bool)
        second[1:] = lead[:-1]
        letter = ((raw >= 97) & (raw <= 122)) | lead | second
        edges = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        place = np.concatenate([[0], np.cumsum(~lead)])
        begin, size = place[starts], place[stops] - place[starts]
        keep = size >= least
        starts, stops, begin, size = starts[keep], stops[keep], begin[keep], size[keep]
        begun = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), dtype=np.uint32, count=len(ids))
        self.h = crc32_spans(raw, starts, stops - starts, begun[np.searchsorted(ends, starts, side="right")])
        codes = np.where(second, raw + np.uint8(0x40), raw)[~lead]
        self.codes, self.sizes = gathered(codes, begin, size), size

    def lessened(self, one_in: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and sizes of the runs, without a code point of those whose checksum one_in divides."""
        hit = self.h % np.uint32(one_in) == 0
        firsts = np.cumsum(self.sizes) - self.sizes
        gone = firsts[hit] + self.h[hit] % self.sizes[hit]
        return np.delete(self.codes, gone), self.sizes - hit


def counted(codes: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Different words of codes, and how often each comes; equal ones are told by a 64-bit hash and their length."""
    ends = np.cumsum(sizes)
    h = span_hash(prefix_hash(BYTE_CODES[codes], 0), ends - sizes, ends, 0) ^ mix(sizes.astype(U64))
    _, at, n = np.unique(h, return_index=True, return_counts=True)
    return [codes[e - k : e].tobytes().decode("latin-1") for e, k in zip(ends[at].tolist(), sizes[at].tolist(), strict=True)], n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, one_in: int = 31) -> DataFrame:
    """(word, n) of all runs of letters, lower-cased, lessened by a code point where one_in divides a run's checksum.

    Null texts have no words; a null id is the empty string in the checksum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            codes, sizes = Runs([x or "" for x in batch.column(0).to_pylist()], texts_of(batch.column(1)), least).lessened(one_in)
            keep = sizes >= least
            words, n = counted(codes[np.repeat(keep, sizes)], sizes[keep])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(releasing(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_order(words: DataFrame) -> np.ndarray:
    """Rank of each bigram of one-byte code points, the rarest first, ties by the bigram.

    There are 90 code points, so at most 8,100 bigrams reach the driver.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    found = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    rank = np.zeros(1 << 16, dtype=np.int32)
    for k, r in enumerate(sorted(found, key=lambda r: (r["count"], r["gram"]))):
        a, b = r["gram"].encode("latin-1")
        rank[a << 8 | b] = k
    return rank


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' code points, a byte each, and where each word begins and ends."""
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = raw[offsets[0] : offsets[-1]]
    lead = raw == 0xC3
    codes = raw + np.uint8(0x40) * np.concatenate([[False], lead[:-1]])
    edges = np.concatenate([[0], np.cumsum(~lead)])[offsets - offsets[0]]
    return codes[~lead], edges[:-1], edges[1:]


def postings(words: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of every group that a word enters: its three rarest bigrams, each with an equal side and an equal half.

    Halves are those of an edited side of s code points, where s is the word's own or,
    as the word may be the longer one, one less. Most of the latter are the same, and posted once.
    """
    codes, firsts, ends = codes_of(words)
    size = ends - firsts
    word = np.repeat(np.arange(len(size)), size - 1)
    pos = ramp(size - 1)
    at = firsts[word] + pos
    gram = codes[at].astype(np.int64) << 8 | codes[at + 1]
    by = np.lexsort((pos, rank[gram], word))
    rare = by[ramp(size - 1) < 3]
    word, pos, gram = word[rare], pos[rare], gram[rare]
    prefix = prefix_hash(BYTE_CODES[codes], 0)
    begin, end = firsts[word], ends[word]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for side in (0, 1):  # the edit is before the bigram, or after it
        left = (begin, begin + pos), (begin + pos + 2, end)
        (e0, e1), (x0, x1) = left if side == 0 else left[::-1]
        fixed = span_hash(prefix, x0, x1, 0) ^ mix((gram * 2 + side).astype(U64))
        n = e1 - e0
        for inner in (0, 1):
            half = (n + inner) // 2  # of the outer end the smaller half, of the inner end the larger
            less = np.maximum(n - 1 + inner, 0) // 2
            for h, ok in ((half, n >= inner), (less, (n >= 1 + inner) & (less != half))):  # of an empty side one half says all
                k = np.flatnonzero(ok)
                a, b = (e0, e0 + h) if inner == 0 else (e1 - h, e1)
                key = mix(fixed[k] + mix(span_hash(prefix, a[k], b[k], 0) + (h[k] * 2 + inner).astype(U64)))
                out.append((word[k], key))
    return np.concatenate([w for w, _ in out]), np.concatenate([k for _, k in out])


def near(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs i, j of words differ by exactly one inserted, deleted or replaced code point."""
    xn, yn = (end - begin)[i], (end - begin)[j]
    most, same = np.minimum(xn, yn), []
    for way, x, y in ((1, begin[i], begin[j]), (-1, end[i] - 1, end[j] - 1)):
        n, active = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        while len(active):
            active = active[n[active] < most[active]]
            active = active[codes[x[active] + way * n[active]] == codes[y[active] + way * n[active]]]
            n[active] += 1
        same.append(n)
    equal = (xn == yn) & (same[0] == xn)
    return (np.abs(xn - yn) <= 1) & ~equal & (same[0] + same[1] >= np.maximum(xn, yn) - 1)


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b, n_a, n_b) of every near pair of (word, n), a before b; each once."""
    rank = bigram_order(words)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                which, key = postings(part.column(0), rank)
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(at), part.column(1).take(at)], ["key", "word", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number, place in grouped(batches):
            word, n = table.column("word"), table.column("n")
            codes, begin, end = codes_of(word)
            size = end - begin
            for i, j in candidate_pairs(number, place):
                fit = np.abs(size[i] - size[j]) <= 1
                i, j = i[fit], j[fit]
                met = near(codes, begin, end, i, j)
                i, j = pa.array(i[met]), pa.array(j[met])
                yield pa.RecordBatch.from_arrays([word.take(i), word.take(j), n.take(i), n.take(j)], ["a", "b", "n_a", "n_b"])

    posted = words.select("word", "n").mapInArrow(post, "key long, word string, n long")
    # A word of seven code points and more enters at most 24 groups.
    found = tiled(posted, "key", F.xxhash64("word"), tile, 24 * words.count()).mapInArrow(releasing(verify), "a string, b string, n_a long, n_b long")
    swap = F.col("a") > F.col("b")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.when(swap, F.col("n_b")).otherwise(F.col("n_a"))).alias("n_a"), F.max(F.when(swap, F.col("n_a")).otherwise(F.col("n_b"))).alias("n_b"))


def last_form(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead in the end.

    A form comes ten times as often as its word, so a chain has at most some twenty words,
    and each round halves what is left of it.
    """
    up = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = durable(up.join(higher, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("word", "root")
        up = up.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2, times: int = 10, one_in: int = 31, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with at least `least` code points that comes least_n times.

    A word's form is its near word of largest n, the first by code points of several, if
    that comes `times` as often as the word; its root is where the forms lead. Null and
    empty texts have no words, rows given twice count twice, very long texts and runs
    are counted whole. An empty table gives an empty one; other columns are not read.
    """
    if least < 4:
        raise ValueError("shorter near words may share none of their three rarest bigrams")
    words = durable(count_words(docs, id_col, text_col, least, one_in).filter(F.col("n") >= least_n))
    sides = F.array(F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("less"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("less"), F.col("a").alias("other")))
    by = near_pairs(words, tile).select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    all_words = durable(words.join(by, "word", "left"))
    formed = -F.col("best.less") >= times * F.col("n")
    all_words = all_words.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    roots = last_form(all_words.filter(F.col("form").isNotNull()))
    return all_words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
