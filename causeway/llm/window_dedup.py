"""Removal of word windows that occur more than once in a corpus.

Rabin-Karp hashes of every window of `window` consecutive words are counted in
Spark (see exchange.py); the words of all repeated windows, merged into maximal
intervals, are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Packed, bits_of, repeated, send
from .frames import texts_of, with_blocks
from .kernels import Words, covered, prefix_hash, span_hash, window_starts

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, text string"


class _Block:
    """The documents of one block, in an order that does not depend on how they came, each equal row once."""

    def __init__(self, table: pa.Table, window: int):
        table = table.combine_chunks()
        ids, keys = table.column("doc_id").to_pylist(), table.column("row_key").to_pylist()
        texts = texts_of(table.column("text").combine_chunks())
        place: dict[tuple, list[int]] = {}
        for i, x in enumerate(zip(keys, texts, strict=True)):
            place.setdefault(x, []).append(i)
        self.rows = [place[x] for x in sorted(place)]
        self.ids, self.texts = ids, texts
        self.words = Words([texts[r[0]] for r in self.rows])
        self.times = np.array([len(r) for r in self.rows])
        self.at = window_starts(self.words.counts, window)
        self.window = window

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        word = self.words.hashes()
        return tuple(span_hash(prefix_hash(word, k), self.at, self.at + self.window, k) for k in (1, 2))

    def doubled(self) -> np.ndarray:
        """Windows of rows that are there more than once."""
        return (self.times > 1)[self.words.doc()][self.at]




def dedup_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Remove each word covered by a window of words that also starts anywhere else.

    docs: any columns; id_col and text_col are read. Words are [^\\x20\\x09-\\x0D]+.
    Returns one row per input row: doc_id, n_words, n_removed, spans (maximal
    runs of removed words, as word indexes), text (kept words joined by one
    space). Windows are judged on the input, not on what is left.

    Null or empty texts, and texts of fewer words than a window, keep all they
    have. Null ids are carried along. A row that is there twice (same id and
    text) repeats all of its windows. Very long texts are whole: a text longer
    than block_bytes makes a block by itself. An empty table gives an empty one.
    """
    blocked, _, size = with_blocks(docs, id_col, text_col, block_bytes)
    n_buckets = max(1, -(-size // bucket_bytes))

    def emit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block = _Block(table, window)
        value, spread = block.hashes()
        again = np.flatnonzero(block.doubled())
        return np.concatenate([value, value[again]]), np.concatenate([spread, spread[again]])

    def strip(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        block = _Block(table, window)
        value, spread = block.hashes()
        again = np.flatnonzero(block.doubled())
        packed = Packed(np.concatenate([value, value[again]]), np.concatenate([spread, spread[again]]), n_buckets)
        hit = block.at[packed.answered(bits_of(back))[: len(value)]]
        words = block.words
        gone = covered(len(words.starts), hit, hit + window)
        begins, ends = runs_by_doc(gone, words.first)
        lost = np.concatenate([[0], np.cumsum(gone)])[words.first]
        span_at = np.searchsorted(begins, words.first)
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "text": []}
        for d, rows in enumerate(block.rows):
            a, b = int(words.first[d]), int(words.first[d + 1])
            n_lost = int(lost[d + 1] - lost[d])
            spans = [{"begin": int(begins[k]) - a, "end": int(ends[k]) - a} for k in range(span_at[d], span_at[d + 1])]
            parts = block.texts[rows[0]].translate(_TO_SPACE).split(b" ")
            parts = [x for x in parts if x]
            if n_lost:
                keep = np.flatnonzero(~gone[a:b])
                parts = [parts[i] for i in keep.tolist()]
            text = b" ".join(parts).decode("utf-8", "surrogatepass")
            for r in rows:
                out["doc_id"].append(block.ids[r])
                out["n_words"].append(b - a)
                out["n_removed"].append(n_lost)
                out["spans"].append(spans)
                out["text"].append(text)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), _TYPES, strict=True)})

    sent = send(blocked, emit, n_buckets)
    return blocked.groupBy("block").cogroup(repeated(sent).groupBy("block")).applyInArrow(strip, OUT)


_TO_SPACE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string())


def runs_by_doc(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross from one document into the next."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    heads = first[:-1][first[:-1] < first[1:]]
    begin[heads] = mask[heads]
    end[heads[heads > 0] - 1] = mask[heads[heads > 0] - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1
