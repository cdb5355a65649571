"""Removal of long byte strings that occur earlier in a corpus, by suffix sorting.

Every window of `length` bytes picks the smallest of its hashed grams as its
anchor, so equal windows pick equal anchors at equal places. Anchors whose gram
occurs once are counted out first (exchange.py). The suffixes at the others are
sorted, by gram bucket: to the right of the anchor, and to the left of it read
backwards, each by deep-shallow sorting. Windows with one anchor offset o are
equal exactly if their suffixes share length - o bytes to the right and o to the
left; both are ranges of the suffix arrays, found from the common prefixes of
neighbours. All but the first of equal windows are removed.

A gram with many different contexts (a license line between different texts) would
bring them all to one group. Its windows are counted one by one, and only those that
occur twice go on, each one alone and by its own hash to a bucket; equal ones
of a block go once. So no group grows with the contexts of one gram.

Deep-shallow sorting: multikey quicksort, eight bytes a key character and all
groups parted in three at once, runs to a shallow depth; groups that are still
together have long common prefixes and are ordered by blind tries. The same sort
finds the equal contexts of a block, of which only the first goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import COUNTED, SENT, Packed, bits_of, repeated, send
from .frames import texts_of, with_blocks
from .kernels import BYTE_CODES, covered, gathered, mix, powers, prefix_hash, ramp, runs, sliding_min
from .window_dedup import runs_by_doc

U64 = np.uint64
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
PLACE_BITS = U64(24)
PLACES = (U64(1) << PLACE_BITS) - U64(1)
_FOLD = np.random.default_rng(77).integers(1, 2**62, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


# --- suffix sorting -----------------------------------------------------------


def key_chars(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
    """The eight bytes at a depth of each suffix as one big-endian number, zero beyond its length."""
    at = starts + depth
    word = np.zeros(len(starts), dtype=U64)
    for k in range(8):
        byte = padded[np.minimum(at + k, len(padded) - 1)].astype(U64)
        word |= np.where(depth + k < lengths, byte, U64(0)) << U64(8 * (7 - k))
    return word


def multikey_quicksort(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their first `shallow` bytes, and for each place the number of its group of equals.

    Eight bytes are a character. Every step parts all groups at once in three about
    their pivots, each the median of three characters: below and above it groups go
    on at the same depth, and those equal to it one character deeper.
    """
    order, first_of_group = np.arange(len(starts)), np.zeros(len(starts), dtype=bool)
    at, begin = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)  # places that are not done, where their group begins
    depth, char = np.zeros(len(starts), dtype=np.int64), key_chars(padded, starts, lengths, 0)
    first_of_group[:1] = True
    while len(at):
        head = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]]))
        size = np.diff(np.append(head, len(at)))
        low, middle, high = char[head], char[head + size // 2], char[head + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high)), size)
        place, shift = np.empty(len(at), dtype=np.int64), np.zeros(len(head), dtype=np.int64)
        part_begin, part_size = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        for side in (char < pivot, char == pivot, char > pivot):
            number = np.add.reduceat(side.astype(np.int64), head)
            before = np.cumsum(side) - side
            place[side] = (before - np.repeat(before[head], size) + np.repeat(head + shift, size))[side]
            part_begin[side] = np.repeat(at[head] + shift, size)[side]
            part_size[side] = np.repeat(number, size)[side]
            shift += number
        depth += 8 * (char == pivot)
        deeper = (char == pivot) & (part_size > 1) & (depth < shallow)
        char[deeper] = key_chars(padded, starts[order[at[deeper]]], lengths[order[at[deeper]]], depth[deeper])
        first_of_group[part_begin] = True
        by = np.empty(len(at), dtype=np.int64)
        by[place] = np.arange(len(at))
        order[at] = order[at[by]]
        go_on = ((part_size > 1) & (depth < shallow))[by]
        at, begin, depth, char = at[go_on], part_begin[by][go_on], depth[by][go_on], char[by][go_on]
    return order, np.cumsum(first_of_group) - 1


class BlindTrie:
    """Strings under the characters at which they branch; the characters between are not kept."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):  # blindly: unseen characters are not compared
            child = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            node = next(iter(node[1].values())) if child is None else child
        t = self.strings[node]
        m = min(len(s), len(t))
        differ = int.from_bytes(s[:m], "big") ^ int.from_bytes(t[:m], "big")
        common = m - (differ.bit_length() + 7) // 8
        mine, other = (x[common] if common < len(x) else -1 for x in (s, t))
        parent, edge, node = None, None, self.root
        while not isinstance(node, int) and node[0] < common:
            parent, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        if not isinstance(node, int) and node[0] == common:
            node[1][mine] = i
        else:
            fresh = [common, {other: node, mine: i}]
            if parent is None:
                self.root = fresh
            else:
                parent[1][edge] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int = 16, deepest: int = 104) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the suffixes padded[start:start+length], and what each shares with the one before it."""
    n = len(starts)
    order, group = multikey_quicksort(padded, starts, lengths, shallow)
    size = np.bincount(group, minlength=1)
    deep = np.flatnonzero(size[group] > 1)
    if len(deep):
        at = order[deep]
        fold = lengths[at].astype(U64)
        for d, f in zip(range(0, deepest, 8), _FOLD, strict=False):
            fold = mix(fold ^ (key_chars(padded, starts[at], lengths[at], d) * f))
        # Equal suffixes of a group are one string of its trie.
        of, what = group[deep], fold
        by = np.lexsort((what, of))
        order[deep] = order[deep][by]
        of, what = of[by], what[by]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (what[1:] != what[:-1])])
        first, string = np.flatnonzero(new), np.cumsum(new) - 1
        string_rank = np.zeros(len(first), dtype=np.int64)
        begins = np.flatnonzero(np.concatenate([[True], np.diff(of[first]) != 0]))
        ends = np.append(begins[1:], len(first))
        raw = padded.tobytes()
        for a, b in zip(begins[ends - begins > 1], ends[ends - begins > 1], strict=True):
            at = order[deep[first[a:b]]]
            strings = [raw[s : s + k] for s, k in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            string_rank[a + np.array(BlindTrie(strings).order())] = np.arange(b - a)
        by = np.lexsort((string_rank[string], of))
        order[deep] = order[deep][by]
    common = np.zeros(n, dtype=np.int64)
    same = np.arange(1, n)
    for d in range(0, deepest, 8):
        if not len(same):
            break
        here, before = order[same], order[same - 1]
        differ = key_chars(padded, starts[here], lengths[here], d) ^ key_chars(padded, starts[before], lengths[before], d)
        out = differ != 0
        # Leading equal bytes of the first differing eight.
        bits = np.frexp((differ[out] >> U64(11)).astype(np.float64))[1] + 11
        bits = np.where(differ[out] >> U64(11) == 0, np.frexp((differ[out] & U64(0x7FF)).astype(np.float64))[1], bits)
        common[same[out]] = d + (64 - bits) // 8
        same = same[~out]
    common[same] = deepest
    if n > 1:
        common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, common


# --- anchors ------------------------------------------------------------------


class _Block:
    """The documents of one block in the corpus order: by id (null first), then key; each equal row once."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        table = table.combine_chunks()
        ids, keys = table.column("doc_id").to_pylist(), table.column("row_key").to_pylist()
        texts = texts_of(table.column("text").combine_chunks())
        place: dict[tuple, list[int]] = {}
        for i, x in enumerate(zip([i if i is not None else NULL_ID for i in ids], keys, texts, strict=True)):
            place.setdefault(x, []).append(i)
        found = sorted(place)
        self.rows = [place[x] for x in found]
        self.ids = ids
        self.id = np.array([x[0] for x in found], dtype=np.int64)
        self.key = np.array([x[1] for x in found], dtype=np.int64)
        self.texts = [x[2] for x in found]
        self.length, self.gram = length, gram

    def slices(self, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Documents a few at a time, long ones in overlapping parts that share no window."""
        docs, begins, parts, held = [], [], [], 0
        for d, t in enumerate(self.texts):
            for a in range(0, max(1, len(t) - self.length + 1), most):
                part = t[a : a + most + self.length - 1]
                if held and held + len(part) > most + self.length:
                    yield np.array(docs), np.array(begins), parts
                    docs, begins, parts, held = [], [], [], 0
                docs.append(d)
                begins.append(a)
                parts.append(part)
                held += len(part)
        if parts:
            yield np.array(docs), np.array(begins), parts

    def anchors(self) -> Iterator[dict]:
        """Runs of windows with one anchor: doc, lo, hi (window starts), anchor, all within raw; gram hashes."""
        span = self.length - self.gram + 1
        for docs, begins, parts in self.slices():
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
            if len(raw) < self.length:
                continue
            sums = prefix_hash(BYTE_CODES[raw], 0)
            g = mix((sums[self.gram :] - sums[: -self.gram]) * powers(0, len(raw) - self.gram + 1, True))
            least = sliding_min((g & ~PLACES) | np.arange(len(g), dtype=U64), span)
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            starts = np.cumsum(sizes) - sizes
            windows = np.maximum(sizes - self.length + 1, 0)
            s = np.repeat(starts, windows) + ramp(windows)
            if not len(s):
                continue
            of = np.repeat(np.arange(len(parts)), windows)
            a = (least[s] & PLACES).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (of[1:] != of[:-1])]))
            last = np.append(new[1:], len(s)) - 1
            a, lo, hi, of = a[new], s[new], s[last], of[new]
            grams = np.ascontiguousarray(raw[a[:, None] + np.arange(self.gram)])
            spread = np.zeros(len(a), dtype=U64)
            for k in range(0, self.gram - self.gram % 4, 4):
                spread = mix(spread + grams[:, k : k + 4].copy().view(np.uint32).ravel().astype(U64) * _FOLD[k])
            yield {"raw": raw, "sums": sums, "doc": docs[of], "shift": begins[of] - starts[of], "lo": lo, "hi": hi, "anchor": a, "gram": g[a], "spread": spread}

    def gram_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(x["gram"], x["spread"], _hashes(x, x["lo"], x["hi"] + self.length, x["anchor"])) for x in self.anchors()]
        return tuple(np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, dtype=U64),) * 3

    def windows(self, x: dict, use: np.ndarray) -> dict:
        """The windows of some of the runs, each as a run of its own."""
        number = x["hi"][use] - x["lo"][use] + 1
        y = {k: np.repeat(x[k][use], number) for k in ("doc", "shift", "anchor", "spread")}
        y["lo"] = y["hi"] = np.repeat(x["lo"][use], number) + ramp(number)
        y["hash"] = _hashes(x, y["lo"], y["lo"] + self.length, y["anchor"])
        y["route"] = mix(y["spread"] + y["hash"] * _FOLD[3])
        return y


def _hashes(x: dict, lo: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hashes of contexts lo .. end and of the anchors' places in them."""
    return mix((x["sums"][end] - x["sums"][lo]) * powers(0, len(x["raw"]), True)[lo] + (end - lo).astype(U64) * _FOLD[1] + (anchor - lo).astype(U64) * _FOLD[2])


def _occurs_earlier(hashes: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which of a block's contexts, in corpus order, occur earlier in the block?"""
    order = np.lexsort((spread, hashes))
    h, s = hashes[order], spread[order]
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    return again


def _again(hashes: np.ndarray, spread: np.ndarray, left: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of a block's contexts, in corpus order, equal an earlier one? Those whose hash repeats are sorted."""
    order = np.lexsort((spread, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (spread[order][1:] == spread[order][:-1])
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    at = np.flatnonzero(out)
    if len(at):
        out[:] = False
        begins = (np.cumsum(size) - size)[at]
        sizes, left = size[at], left[at]
        by, common = deep_shallow(np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), begins, sizes, deepest=168)
        new = np.ones(len(by), dtype=bool)
        new[1:] = (common[1:] < sizes[by[1:]]) | (sizes[by[1:]] != sizes[by[:-1]])
        string = np.empty(len(by), dtype=np.int64)
        string[by] = np.cumsum(new)
        _, first = np.unique(string * 256 + left, return_index=True)
        out[at] = True
        out[at[first]] = False
    return out


NULL_ID = -(2**63)
_ARRAYS = {"doc": np.int32, "id": np.int64, "key": np.int64, "lo": np.int64, "left": np.uint8, "size": np.uint8}
CONTEXTS = "bucket int, block int, " + ", ".join(f"{k} binary" for k in _ARRAYS) + ", bytes binary, gone binary"
GONE = "block int, gone binary"


def _spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (doc, begin, end) with overlapping neighbours of a document merged."""
    if not len(doc):
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # Within a document ends grow with begins: ranges cover whole windows, and no two have a window in common.
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return np.column_stack([doc[at], begin[at], np.maximum.reduceat(end, at)]).astype(np.int64)


def _windows_gone(bucket: dict[str, np.ndarray], length: int) -> np.ndarray:
    """For each context (in corpus order) and each of its windows: does the window's string occur earlier?"""
    left, size = bucket["left"].astype(np.int64), bucket["size"].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    raw = bucket["bytes"]
    pad = np.zeros(8, dtype=np.uint8)
    right = deep_shallow(np.concatenate([raw, pad]), begins + left, size - left)
    back = deep_shallow(np.concatenate([raw[::-1], pad]), len(raw) - (begins + left), left)
    n_windows = size - length + 1
    gone = np.zeros((len(size), int(n_windows.max(initial=0)) + 1), dtype=bool)
    for o in range(int(left.max(initial=0)) + 1):
        at = np.flatnonzero((o <= left) & (left - o < n_windows))
        if not len(at):
            continue
        of = []
        for (order, common), need in ((right, length - o), (back, o)):
            number = np.empty(len(size), dtype=np.int64)
            number[order] = np.cumsum(common < need)
            of.append(number[at])
        _, first = np.unique((of[0] << 32) | of[1], return_index=True)
        again = np.ones(len(at), dtype=bool)
        again[first] = False
        gone[at[again], left[at[again]] - o] = True
    return gone


def dedup_substrings(docs: DataFrame, length: int = 100, gram: int = 36, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, most_contexts: int = 16384) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts earlier.

    Texts are taken as UTF-8; earlier means a smaller id, or the same document
    and an earlier start. Matches never cross documents, overlapping ones count,
    and strings are judged on the input. Returns one row per input row: doc_id,
    n_bytes, n_removed, spans (maximal removed runs), kept (remaining bytes).

    Null and empty texts, and texts shorter than length, keep all they have. A
    null id comes before all others. Rows of one id with different texts come in
    the order of a hash of their text; a row given twice (same id and text) is
    one document and is given back twice. Very long texts are whole; a text over
    block_bytes makes a block by itself. An empty table gives an empty one. Other
    columns are not read. length is at most 104, and gram a multiple of 4 below it.
    Grams with more than most_contexts different contexts are taken window by window.
    """
    blocked, decide, strip, sent = _contexts(docs, length, gram, id_col, text_col, block_bytes, bucket_bytes, most_contexts)
    decided = sent.groupBy("bucket").applyInArrow(decide, GONE)
    return blocked.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(strip, OUT)


def _contexts(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int, most_contexts: int) -> tuple:
    """The blocked rows, the functions of a bucket and of a block, and the CONTEXTS rows."""
    if not (length <= 104 and 4 <= gram < length and gram % 4 == 0 and 2 * length - gram < 256):
        raise ValueError("length must be at most 104 and gram a multiple of 4 below it")
    blocked, _, total = with_blocks(docs, id_col, text_col, block_bytes)
    n_buckets = max(1, -(-total // bucket_bytes))

    def count(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _Block(table, length, gram).gram_hashes()

    def answered(found: list[dict], grams: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each run: does its gram occur twice, and has it many contexts?"""
        packed = Packed(np.concatenate([x["gram"] for x in found]), np.concatenate([x["spread"] for x in found]), n_buckets)
        cuts = np.cumsum([len(x["lo"]) for x in found])[:-1]
        return list(zip(*(np.split(packed.answered(bits_of(grams, k)), cuts) for k in ("bits", "many")), strict=True))

    def count_windows(key: tuple, table: pa.Table, grams: pa.Table) -> pa.Table:
        value = spread = np.zeros(0, dtype=U64)
        if any(any(x) for x in grams.column("many").to_pylist()):
            block = _Block(table, length, gram)
            found = list(block.anchors())
            hot = [block.windows(x, many) for x, (_, many) in zip(found, answered(found, grams), strict=True)]
            value, spread = (np.concatenate([y[k] for y in hot]) for k in ("hash", "route"))
        return Packed(value, spread, n_buckets).rows(key[0].as_py())

    def contexts(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        block = _Block(table, length, gram)
        found = list(block.anchors())
        out: dict[str, list] = {"bucket": [], "block": [], **{k: [] for k in _ARRAYS}, "bytes": [], "gone": []}
        if found:
            is_gram = np.array(back.column("many").is_valid(), dtype=bool)
            use = answered(found, back.filter(pa.array(is_gram)))
            windows = [block.windows(x, many) for x, (_, many) in zip(found, use, strict=True)]
            packed = Packed(np.concatenate([y["hash"] for y in windows]), np.concatenate([y["route"] for y in windows]), n_buckets)
            twice = np.split(packed.answered(bits_of(back.filter(pa.array(~is_gram)))), np.cumsum([len(y["lo"]) for y in windows])[:-1])
            cut, gone = [], []
            for x, (again, many), y, again_y in zip(found, use, windows, twice, strict=True):
                once = again & ~many
                z = {k: x[k][once] for k in ("doc", "shift", "lo", "hi", "anchor", "spread")}
                z["hash"] = _hashes(x, z["lo"], z["hi"] + length, z["anchor"])
                z["route"] = z["spread"]
                y = {k: v[again_y] for k, v in y.items()}
                again_y = _occurs_earlier(y["hash"], y["spread"])  # before their bytes are taken: there are a hundred a window
                gone.append(_spans(y["doc"][again_y], (y["lo"] + y["shift"])[again_y], (y["lo"] + y["shift"])[again_y] + length))
                y = {k: np.concatenate([z[k], v[~again_y]]) for k, v in y.items()}
                size = y["hi"] + length - y["lo"]
                y["size"], y["left"] = size, y["anchor"] - y["lo"]
                y["bytes"] = gathered(x["raw"], y["lo"], size)
                y["lo"] = y["lo"] + y["shift"]
                cut.append(y)
            every = {k: np.concatenate([y[k] for y in cut]) for k in ("doc", "lo", "size", "left", "hash", "spread", "route", "bytes")}
            # Of equal contexts of the block the first one goes on, the others are surely gone.
            again = _again(every["hash"], every["spread"], every["left"], every["bytes"], every["size"])
            gone = np.concatenate([*gone, _spans(every["doc"][again], every["lo"][again], every["lo"][again] + every["size"][again])])
            bucket = (every["route"] % U64(n_buckets)).astype(np.int64)
            ends = np.cumsum(every["size"])
            firsts = np.flatnonzero(~again)
            firsts = firsts[np.argsort(bucket[firsts], kind="stable")]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[firsts])) + 1, [len(firsts)]]) if len(firsts) else np.zeros(1, dtype=np.int64)
            values = {"doc": every["doc"], "id": block.id[every["doc"]], "key": block.key[every["doc"]], "lo": every["lo"], "left": every["left"], "size": every["size"]}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = firsts[a:b]
                out["bucket"].append(int(bucket[at[0]]))
                for k, kind in _ARRAYS.items():
                    out[k].append(values[k][at].astype(kind).tobytes())
                out["bytes"].append(gathered(every["bytes"], ends[at] - every["size"][at], every["size"][at]).tobytes())
                out["gone"].append(gone.tobytes() if a == 0 else b"")
            out["block"] = [key[0].as_py()] * len(out["bucket"])
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})

    def decide(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = {k: [np.frombuffer(r[k], dtype=kind) for r in rows] for k, kind in _ARRAYS.items()}
        number = np.array([len(x) for x in parts["lo"]])
        every = {k: np.concatenate(v) for k, v in parts.items()}
        raw = np.frombuffer(b"".join(r.pop("bytes") for r in rows), dtype=np.uint8)
        of = np.repeat(np.arange(len(rows)), number)
        order = np.lexsort((every["lo"], every["key"], every["id"]))
        size = every["size"].astype(np.int64)
        begins = np.cumsum(size) - size
        sorted_size = size[order]
        bucket = {"left": every["left"][order], "size": every["size"][order], "bytes": gathered(raw, begins[order], sorted_size)}
        del raw
        gone = _windows_gone(bucket, length)
        begin, end = runs(gone.ravel())
        width = gone.shape[1]
        which = order[begin // width]
        start = every["lo"][which] + begin % width
        stop = every["lo"][which] + (end - 1) % width + length
        out_gone = []
        doc, row = every["doc"][which], of[which]
        by = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[by], np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            at = by[cuts[i] : cuts[i + 1]]
            out_gone.append(_spans(doc[at], start[at], stop[at]).tobytes() + r["gone"])
        return pa.table({"block": table.column("block"), "gone": pa.array(out_gone, pa.binary())})

    def strip(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        block = _Block(table, length, gram)
        spans = np.concatenate([np.zeros((0, 3), dtype=np.int64), *(np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in back.column("gone").to_pylist())])
        sizes = np.array([len(t) for t in block.texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        gone = covered(int(first[-1]), first[spans[:, 0]] + spans[:, 1], first[spans[:, 0]] + spans[:, 2])
        begins, ends = runs_by_doc(gone, first)
        raw = np.frombuffer(b"".join(block.texts), dtype=np.uint8)
        lost = np.concatenate([[0], np.cumsum(gone)])[first]
        span_at = np.searchsorted(begins, first)
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for d, rows in enumerate(block.rows):
            a, b = int(first[d]), int(first[d + 1])
            n_lost = int(lost[d + 1] - lost[d])
            cuts = [{"begin": int(begins[k]) - a, "end": int(ends[k]) - a} for k in range(span_at[d], span_at[d + 1])]
            kept = raw[a:b][~gone[a:b]].tobytes() if n_lost else block.texts[d]
            for r in rows:
                for k, v in zip(out, (block.ids[r], b - a, n_lost, cuts, kept), strict=True):
                    out[k].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    grams = repeated(send(blocked, count, n_buckets, COUNTED), most_contexts)
    windows = repeated(blocked.groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(count_windows, SENT))
    back = grams.unionByName(windows.withColumn("many", F.lit(None).cast("binary")))
    return blocked, decide, strip, blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(contexts, CONTEXTS)
