"""Self-join of documents on the Jaccard similarity of their word shingles, by adaptive multi-match prefixes.

1. Documents with equal shingle sets become one class. A sketch of fixed size
   counts all shingles, so rare ones can come first in every set.
2. A set of n shingles that is to share t of them with another must share l of
   its first n - t + l with the other's prefix. Each class picks the l whose
   postings and expected verifications cost least; the more its shingles are
   shared, the longer its prefix and the more matches it asks for.
3. Postings are packed by bucket; shingles that one class alone has vanish there.
   First every posting list proposes pairs with a few of its members only, those
   with the fewest shingles of their own, and what these pairs link is merged into
   components. Lists within one component end there. Then the matches of all pairs
   whose members are not in one component are counted, in packed arrays, and pairs
   with enough are verified too. So a group of near copies verifies a number of
   pairs in proportion to its members, and yet no link between components is missed.
   Only components are returned; links within one are not listed.
4. Pairs are verified by family, that is, what the pairs to verify connect. A set is
   sent once to its family's bin; only families larger than a bin are cut into tiles.

A pair's prefixes bound its intersection from above: what they share, and what lies
beyond the prefix that ends first. The matches asked of a pair follow from that and
from both sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import chunks, durable, release, releasing, texts_of, tidy
from .kernels import Words, mix, prefix_hash, span_hash, window_starts

U64 = np.uint64
#: Sketch: so many rows of so many counters, in pieces. Its size does not depend on the corpus.
SKETCH_ROWS, SKETCH_BITS, PIECE = 2, 19, 1 << 17
#: Of a shingle's other sets, how many are expected where the sketch shows none.
UNSEEN = 0.25
HUBS = 3
MOST_MARKS = 1 << 27
#: Shingles that a bin of sets to verify holds, and pairs that a part to sum holds, about.
BIN, PART = 1 << 20, 1 << 22


def shingle_sets(texts: list[bytes], words: int = 5, most: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none.

    About `most` bytes are worked on at a time.
    """
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            out += _shingle_sets(texts[begin:i], words)
            begin, held = i, 0
        held += len(t)
    return out + _shingle_sets(texts[begin:], words)


def _shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    w = Words(texts, lower=True)
    hashes = w.hashes()
    at = window_starts(w.counts, words)
    grams = span_hash(prefix_hash(hashes, 1), at, at + words, 1)
    first = np.searchsorted(at, w.first)
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))
    whole = mix(span_hash(prefix_hash(hashes, 2), w.first[few], w.first[few + 1], 2) + w.counts[few].astype(U64))
    out = [np.unique(grams[first[i] : first[i + 1]]) for i in range(len(texts))]
    for i, h in zip(few, whole, strict=True):
        out[i] = np.array([h], dtype=U64)
    return out


def _class_of(s: np.ndarray) -> tuple[int, int]:
    one, two = mix(s ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64), mix(s + U64(0x632BE59BD9B4E019)).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _counter_of(s: np.ndarray, row: int) -> np.ndarray:
    return ((s >> U64(row * 20)) & U64((1 << SKETCH_BITS) - 1)).astype(np.int64) + (row << SKETCH_BITS)


def _digests(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n, c1, c2 of every row, and the pieces of each task's sketch."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_ROWS << SKETCH_BITS, dtype=np.int32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])
        for batch in chunks(batches, "text", 4 << 20):
            sets = shingle_sets(texts_of(batch.column(1)), words)
            keys = [_class_of(s) for s in sets]
            different = list({k: s for k, s in zip(keys, sets, strict=True) if len(s)}.values())
            if different:
                every = np.concatenate(different)
                for r in range(SKETCH_ROWS):
                    counts += np.bincount(_counter_of(every, r), minlength=len(counts)).astype(np.int32)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema
            )
        pieces = len(counts) // PIECE
        if counts.any():
            packed = [zlib.compress(counts[i * PIECE : (i + 1) * PIECE].tobytes(), 1) for i in range(pieces)]
            nothing = [pa.nulls(pieces, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(pieces), pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return rows.mapInArrow(releasing(digest), "doc_id long, n long, c1 long, c2 long, piece int, counts binary")


def _frequencies(digests: DataFrame) -> np.ndarray:
    """For every counter, twice the logarithm (base 2) of its count above the mean, as one byte."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), dtype=np.int32)
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = digests.filter("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    counts = np.zeros(SKETCH_ROWS << SKETCH_BITS, dtype=np.int64)
    for r in sums:
        counts[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counts"], dtype=np.int64)
    rows = counts.reshape(SKETCH_ROWS, -1)
    mean = rows.mean(axis=1, keepdims=True)
    above = np.maximum(rows - mean - 3 * np.sqrt(mean), 1)
    return np.minimum(2 * np.log2(above), 255).astype(np.uint8).ravel()


def overlap_wanted(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any set as similar as that."""
    return -(-n * percent // 100)


def prefix(s: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles a set is posted under, rare ones first, and how many of them a partner must share."""
    code = np.minimum.reduce([frequency[_counter_of(s, r)] for r in range(SKETCH_ROWS)])
    order = np.lexsort((s, code))
    s, code = s[order], code[order]
    n, t = len(s), int(overlap_wanted(len(s), percent))
    shared = np.cumsum(np.exp2(code / 2) - 1 + UNSEEN)
    steps = np.unique(np.minimum(2 ** np.arange(t.bit_length() + 1), t))
    length = n - t + steps
    # Matches asked of a pair of this size, and with them the candidates to verify.
    asked = np.maximum(steps, union_bound(n, n, percent) - (n - length))
    k = int(np.argmin(length + (1 + n / 4) * shared[length - 1] / asked))
    return s[: length[k]], int(steps[k])


def union_bound(a, b, percent: int):
    """Shingles that sets of a and b must share to be similar enough."""
    return -(-percent * (a + b) // (100 + percent))


POSTED = "bucket int, tokens binary, owner binary, c1 binary, n binary, need binary, posted binary"


def _post(rows: DataFrame, words: int, percent: int, frequency, n_buckets: int) -> DataFrame:
    """Packed postings of every chunk of documents, each class once a chunk."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        for batch in chunks(batches, "text", 4 << 20):
            sets = {_class_of(s): s for s in shingle_sets(texts_of(batch.column(1)), words) if len(s)}
            if not sets:
                continue
            c1 = np.array([k[0] for k in sets], dtype=np.int64)
            n = np.array([len(s) for s in sets.values()], dtype=np.int32)
            found = [prefix(s, table, percent) for s in sets.values()]
            need = np.array([m for _, m in found], dtype=np.int32)
            posted = np.array([len(p) for p, _ in found], dtype=np.int32)
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(p) for p, _ in found])
            token = np.concatenate([p for p, _ in found])
            bucket = (token % U64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, token, owner = bucket[order], (token[order] >> U64(32)).astype(np.uint32), owner[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            out: dict[str, list] = {k: [] for k in ("bucket", "tokens", "owner", "c1", "n", "need", "posted")}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, at = np.unique(owner[a:b], return_inverse=True)
                for k, v in zip(out, (int(bucket[a]), token[a:b].tobytes(), at.astype(np.uint32).tobytes(), c1[own].tobytes(), n[own].tobytes(), need[own].tobytes(), posted[own].tobytes()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()], list(out))

    return rows.mapInArrow(releasing(post), POSTED)


LISTS = "bucket int, lists binary, owner binary, c1 binary, n binary, need binary, posted binary, own binary"


def _gather(table: pa.Table) -> pa.Table:
    """The bucket's posting lists of two classes or more. own: the postings that a class has alone."""
    release()
    parts = {k: table.column(k).to_pylist() for k in ("tokens", "owner", "c1", "n", "need", "posted")}
    c1s = [np.frombuffer(x, dtype=np.int64) for x in parts["c1"]]
    shift = np.cumsum([0, *map(len, c1s)])
    c1 = np.concatenate(c1s)
    n, need, posted = (np.concatenate([np.frombuffer(x, dtype=np.int32) for x in parts[k]]) for k in ("n", "need", "posted"))
    token = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in parts["tokens"]])
    owner = np.concatenate([np.frombuffer(x, dtype=np.uint32).astype(np.int64) + s for x, s in zip(parts["owner"], shift, strict=False)])
    c1, first, number = np.unique(c1, return_index=True, return_inverse=True)
    n, need, posted, owner = n[first], need[first], posted[first], number[owner]
    both = np.unique((token.astype(U64) << U64(32)) | owner.astype(U64))
    token, owner = (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], token[1:] != token[:-1]])
    of = np.cumsum(new) - 1
    several = (np.bincount(of) > 1)[of]
    own = np.bincount(owner[~several], minlength=len(c1)).astype(np.int32)
    owner, of = owner[several], np.cumsum(new[several]) - 1
    used, owner = np.unique(owner, return_inverse=True)
    packed = {"lists": of.astype(np.uint32), "owner": owner.astype(np.uint32), "c1": c1[used], "n": n[used], "need": need[used], "posted": posted[used], "own": own[used]}
    return pa.table({"bucket": table.column("bucket").slice(0, 1)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()})


PAIRS = "a long, b long"
COUNTED = "part int, a binary, b binary, matches binary, need binary"


class _Lists:
    def __init__(self, row: dict):
        self.of, self.owner = (np.frombuffer(row[k], dtype=np.uint32).astype(np.int64) for k in ("lists", "owner"))
        self.c1 = np.frombuffer(row["c1"], dtype=np.int64)
        self.n, self.need, self.posted, self.own = (np.frombuffer(row[k], dtype=np.int32).astype(np.int64) for k in ("n", "need", "posted", "own"))
        self.starts = np.searchsorted(self.of, np.arange(self.of[-1] + 1 if len(self.of) else 0))
        self.sizes = np.diff(np.append(self.starts, len(self.of)))

    def similar_sizes(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        return 100 * np.minimum(self.n[a], self.n[b]) >= percent * np.maximum(self.n[a], self.n[b])

    def asked(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Matches without which a pair cannot be similar enough."""
        beyond = np.maximum(self.n[a] - self.posted[a], self.n[b] - self.posted[b])
        return np.maximum(np.minimum(self.need[a], self.need[b]), union_bound(self.n[a], self.n[b], percent) - beyond)

    def packed(self, keys: np.ndarray, counts: np.ndarray, percent: int, parts: int) -> pa.Table:
        """COUNTED rows: pairs of classes (as numbers within the bucket) by their hash."""
        a, b = keys // len(self.c1), keys % len(self.c1)
        low, high = np.minimum(self.c1[a], self.c1[b]), np.maximum(self.c1[a], self.c1[b])
        part = (mix(low.view(U64) ^ mix(high.view(U64))) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        asked = self.asked(a, b, percent)
        columns = [x[order].astype(k) for x, k in ((low, np.int64), (high, np.int64), (counts, np.int32), (asked, np.int32))]
        at = part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else np.zeros(1, dtype=np.int64)
        rows = list(zip(cuts[:-1], cuts[1:], strict=True))
        out = {"part": pa.array(at[cuts[:-1]] if rows else [], pa.int32())}
        return pa.table(out | {k: pa.array([x[i:j].tobytes() for i, j in rows], pa.binary()) for k, x in zip(("a", "b", "matches", "need"), columns, strict=True)})


def _summed(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)


def _enough(table: pa.Table) -> pa.Table:
    """Pairs of one hash class whose matches, summed over all buckets, are as many as asked."""
    a, b, matches, need = (np.concatenate([np.frombuffer(x, dtype=k) for x in table.column(c).to_pylist()]) for c, k in (("a", np.int64), ("b", np.int64), ("matches", np.int32), ("need", np.int32)))
    order = np.lexsort((b, a))
    a, b, matches, need = a[order], b[order], matches[order], need[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    good = new[np.add.reduceat(matches, new) >= need[new]] if len(new) else new
    return pa.table({"a": a[good], "b": b[good]})


def _star_pairs(percent: int, parts: int):
    """Every list's members with a few of them, the same ones wherever they stand."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Lists(batch.slice(i, 1).to_pylist()[0])
                if not len(x.of):
                    continue
                made = []
                for salt in range(HUBS):
                    order = np.lexsort((mix(x.c1.view(U64) ^ U64(salt)), x.own // (1 + salt)))
                    rank = np.empty(len(order), dtype=np.int64)
                    rank[order] = np.arange(len(order))
                    hub = order[np.minimum.reduceat(rank[x.owner], x.starts)][x.of]
                    ok = (hub != x.owner) & x.similar_sizes(hub, x.owner, percent)
                    made.append(_summed(np.minimum(hub, x.owner)[ok] * len(x.c1) + np.maximum(hub, x.owner)[ok]))
                # A pair that is proposed through several hubs counts once a list.
                keys = np.unique(np.concatenate([k for k, _ in made]))
                counts = np.zeros(len(keys), dtype=np.int64)
                for k, c in made:
                    at = np.searchsorted(keys, k)
                    counts[at] = np.maximum(counts[at], c)
                # Lists in which another hub stood before are missing, so a third of the matches is enough here.
                yield from x.packed(keys, 3 * counts, percent, parts).to_batches()

    return star


def _split_classes(parts: int):
    """(part, bucket, c1) of every bucket's classes, by their hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c1 = np.frombuffer(packed, dtype=np.int64)
                part = c1 % parts
                for p in np.unique(part):
                    yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([bucket], pa.int32()), pa.array([c1[part == p].tobytes()], pa.binary())], ["part", "bucket", "c1"])

    return split


def _label(key: tuple, classes: pa.Table, labels: pa.Table) -> pa.Table:
    """(bucket, c1, label) of the classes that have a label."""
    known = labels.column("c1").to_numpy()
    order = np.argsort(known)
    known, label = known[order], labels.column("label").to_numpy()[order]
    out: dict[str, list] = {"bucket": [], "c1": [], "label": []}
    for bucket, packed in zip(classes.column("bucket").to_pylist(), classes.column("c1").to_pylist(), strict=True):
        c1 = np.frombuffer(packed, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, c1), max(len(known) - 1, 0))
        hit = known[at] == c1 if len(known) else np.zeros(len(c1), dtype=bool)
        out["bucket"].append(bucket)
        out["c1"].append(c1[hit].tobytes())
        out["label"].append(label[at[hit]].tobytes())
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "c1": pa.array(out["c1"], pa.binary()), "label": pa.array(out["label"], pa.binary())})


PREPARED = LISTS + ", label binary, slices int, pairs long"
#: Lists with more members are counted as products of 0/1 matrices, TILE members by TILE, DENSE lists at a time.
LONG, TILE, DENSE = 48, 1024, 1 << 13


def _prepare(key: tuple, lists: pa.Table, labels: pa.Table) -> pa.Table:
    """The bucket's lists whose members are in more than one component, with a number for each member's component.

    pairs: what is left to count; slices: into how many tasks its matrix products go.
    """
    release()
    row = lists.to_pylist()[0]
    x = _Lists(row)
    known = [np.frombuffer(c, dtype=np.int64) for c in labels.column("c1").to_pylist()]
    named = [np.frombuffer(c, dtype=np.int64) for c in labels.column("label").to_pylist()]
    label = np.full(len(x.c1), -1, dtype=np.int64)
    if known:
        label[np.searchsorted(x.c1, np.concatenate(known))] = np.unique(np.concatenate(named), return_inverse=True)[1]
    apart = np.flatnonzero(label < 0)  # has no component: differs from all
    label[apart] = label.max(initial=-1) + 1 + np.arange(len(apart))
    pairs, slices = 0, 1
    if len(x.of):
        of_member = label[x.owner]
        mixed = (np.minimum.reduceat(of_member, x.starts) != np.maximum.reduceat(of_member, x.starts))[x.of]
        of, owner = np.unique(x.of[mixed], return_inverse=True)[1], x.owner[mixed]
        used, owner = np.unique(owner, return_inverse=True)
        label = label[used]
        sizes = np.bincount(of)
        alike = np.unique(of * (len(used) + 1) + np.unique(label, return_inverse=True)[1][owner], return_counts=True)[1]
        pairs = int((sizes**2).sum() - (alike**2).sum()) // 2
        members, long_lists = len(np.unique(owner[sizes[of] > LONG])), int((sizes > LONG).sum())
        tiles = -(-members // TILE)
        slices = 1 + tiles * (tiles + 1) // 2 * -(-long_lists // DENSE) // 64
        row |= {"lists": of.astype(np.uint32).tobytes(), "owner": owner.astype(np.uint32).tobytes()}
        row |= {"c1": x.c1[used].tobytes()} | {k: getattr(x, k)[used].astype(np.int32).tobytes() for k in ("n", "need", "posted", "own")}
    row |= {"label": label.astype(np.int64).tobytes(), "slices": slices, "pairs": pairs}
    kinds = {"bucket": pa.int32(), "slices": pa.int32(), "pairs": pa.int64()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def _cross_pairs(percent: int, parts: int, step: int = 2_000_000):
    """All pairs of every list whose members are in different components, with their matches.

    Rows are PREPARED with the number of one of the bucket's slices. Slice 0
    enumerates lists of few members. Long ones, which near copies and common
    passages make, are counted together as products of 0/1 matrices, a tile at a
    time, and every slice takes some of the tiles. Members lie by component, so
    tiles within one are left out.
    """

    def short(x: _Lists, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, held, waiting = len(x.c1), [], 0
        for size in np.unique(x.sizes[x.sizes <= LONG]):
            starts = x.starts[x.sizes == size]
            rows = max(1, step // int(size * size))
            for i in range(0, len(starts), rows):
                members = x.owner[starts[i : i + rows][:, None] + np.arange(size)]
                for j in range(1, int(size)):
                    a, b = members[:, :-j].ravel(), members[:, j:].ravel()
                    ok = (label[a] != label[b]) & x.similar_sizes(a, b, percent)
                    held.append(np.minimum(a, b)[ok] * c + np.maximum(a, b)[ok])
                    waiting += len(held[-1])
                    if waiting > step:
                        yield _summed(np.concatenate(held))
                        held, waiting = [], 0
        if waiting:
            yield _summed(np.concatenate(held))

    def tiles(x: _Lists, label: np.ndarray, number: int, slices: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c = len(x.c1)
        at_long = np.flatnonzero(x.sizes[x.of] > LONG) if len(x.of) else np.zeros(0, dtype=np.int64)
        if not len(at_long):
            return
        members = np.unique(x.owner[at_long])
        members = members[np.argsort(label[members], kind="stable")]
        place = np.zeros(c, dtype=np.int64)
        place[members] = np.arange(len(members))
        who, of = place[x.owner[at_long]], np.unique(x.of[at_long], return_inverse=True)[1]
        by_list = np.argsort(of, kind="stable")
        who, of = who[by_list], of[by_list]
        n_lists, m = int(of.max()) + 1, len(members)
        turn = -1
        for i in range(0, m, TILE):
            for j in range(i, m, TILE):
                turn += 1
                if turn % slices != number or label[members[i]] == label[members[min(m, j + TILE) - 1]]:
                    continue
                counts = np.zeros((min(TILE, m - i), min(TILE, m - j)), dtype=np.float32)
                for k in range(0, n_lists, DENSE):
                    lo, hi = np.searchsorted(of, [k, k + DENSE])
                    w, f = who[lo:hi], of[lo:hi] - k
                    left, right = (w >= i) & (w < i + TILE), (w >= j) & (w < j + TILE)
                    both = np.intersect1d(f[left], f[right])
                    if not len(both):
                        continue
                    sides = []
                    for pick, base, height in ((left, i, counts.shape[0]), (right, j, counts.shape[1])):
                        spot = np.minimum(np.searchsorted(both, f[pick]), len(both) - 1)
                        hit = both[spot] == f[pick]
                        side = np.zeros((height, len(both)), dtype=np.float32)
                        side[w[pick][hit] - base, spot[hit]] = 1
                        sides.append(side)
                    counts += sides[0] @ sides[1].T
                a, b = np.nonzero(counts)
                n = counts[a, b].astype(np.int64)
                a, b = members[a + i], members[b + j]
                ok = (place[a] < place[b]) & (label[a] != label[b]) & x.similar_sizes(a, b, percent)
                if ok.any():
                    yield np.minimum(a, b)[ok] * c + np.maximum(a, b)[ok], n[ok]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, label = _Lists(row), np.frombuffer(row["label"], dtype=np.int64)
                for keys, counts in short(x, label) if row["slice"] == 0 else ():
                    yield from x.packed(keys, counts, percent, parts).to_batches()
                for keys, counts in tiles(x, label, row["slice"], row["slices"]):
                    yield from x.packed(keys, counts, percent, parts).to_batches()

    return cross


def _places(column: str, bits: int) -> list:
    """Two places of a value in a bitmap."""
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(bits)) for k in (1, 2)]


def _marks(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap with both places of every value set; at most MOST_MARKS bits."""
    places = ids.select(F.explode(F.array(*_places(column, bits))).alias("s")).select((F.col("s") + 1).alias("s"))
    rows = places.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(-(-bits // 32768) * 4096, dtype=np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sets_of(docs: DataFrame, marks, bits: int, words: int) -> DataFrame:
    """(c1, c2, n, shingles) of the rows whose id is marked (or happens to share both marks)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = marks.value
        for batch in batches:
            hit = np.ones(batch.num_rows, dtype=bool)
            for column in (2, 3):
                place = batch.column(column).to_numpy()
                hit &= (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            for part in chunks(iter([batch.filter(pa.array(hit))]), "text"):
                sets = [s for s in shingle_sets(texts_of(part.column(1)), words) if len(s)]
                if not sets:
                    continue
                keys = [_class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([len(s) for s in sets], pa.int64()), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], ["c1", "c2", "n", "shingles"]
                )

    one, two = _places("doc_id", bits)
    return docs.withColumn("one", one).withColumn("two", two).mapInArrow(releasing(read), "c1 long, c2 long, n long, shingles array<long>")


def _orient(pairs: DataFrame) -> DataFrame:
    """The pairs with a class that very many of them share as b.

    Such classes stand in more than one of 500 pairs, so there are at most 1000, whatever the pairs.
    """
    total = pairs.count()
    seen = pairs.select(F.explode(F.array("a", "b")).alias("hot")).groupBy("hot").count()
    hot = F.broadcast(seen.filter(F.col("count") > total / 500).select("hot"))
    out = pairs.join(hot, F.col("a") == F.col("hot"), "left")
    return out.select(F.when(F.col("hot").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("hot").isNull(), F.col("b")).otherwise(F.col("a")).alias("b"))


def _binned(pairs: DataFrame, info: DataFrame, bins: int) -> DataFrame:
    """(bin, a, b): pairs of one family together; a family with more than BIN shingles is cut into tiles of pairs.

    So a set goes to one bin, or, in a large family, to as many as the family has times BIN shingles.
    """
    cuts = info.groupBy("family").agg(F.sum("n").alias("held")).filter(F.col("held") > BIN).select("family", F.ceil(F.col("held") / BIN).alias("cuts"))
    located = pairs.join(info.select(F.col("c1").alias("a"), "family").distinct(), "a").join(cuts, "family", "left")
    at = [F.pmod(F.xxhash64(c), F.coalesce("cuts", F.lit(1))) for c in ("a", "b")]
    return located.select(F.pmod(F.xxhash64("family", F.least(*at), F.greatest(*at)), F.lit(bins)).alias("bin"), "a", "b")


def _verify(percent: int):
    """(node, node) of a bin's pairs whose sets are similar enough, by their whole intersections."""

    def verify(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        release()
        column = sets.column("shingles").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
        found: dict[int, dict[int, np.ndarray]] = {}
        for i, (c1, node) in enumerate(zip(sets.column("c1").to_pylist(), sets.column("node").to_pylist(), strict=True)):
            found.setdefault(c1, {})[node] = flat[ends[i] - ends[0] : ends[i + 1] - ends[0]]
        us, vs = [], []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            for u, x in found.get(a, {}).items():
                for v, y in found.get(b, {}).items():
                    few, many = (x, y) if len(x) < len(y) else (y, x)
                    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    common = int((many[at] == few).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        us.append(u)
                        vs.append(v)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return verify


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts are lower-cased (A-Z) and cut into words [^\\x20\\x09-\\x0D]+; a set is the
    distinct runs of `words` words, the whole sequence for shorter texts, nothing
    for texts without words. Rows link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach from the row, itself
    included.

    Rows without words, or without text, link with nothing. Rows with one id are
    one node of the graph. Rows without an id link like others; if no row they
    reach has an id, their component is null. A row given twice is given back
    twice. Very long texts are one set each. An empty table gives an empty one.
    Other columns are not read.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    digests = durable(_digests(rows, words))
    found = digests.filter("piece is null").select("doc_id", "n", "c1", "c2")
    total = found.agg(F.sum("n")).first()[0] or 0
    frequency = context.broadcast(_frequencies(digests))
    classes = found.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"))

    n_buckets = max(1, int(total // 4_000_000))
    lists = durable(_post(rows, words, percent, frequency, n_buckets).groupBy("bucket").applyInArrow(_gather, LISTS))

    def enough(counted: DataFrame) -> DataFrame:
        return durable(counted.groupBy("part").applyInArrow(_enough, PAIRS))

    def verified(pairs: DataFrame) -> DataFrame:
        """(node, node) of the pairs that are similar enough. Sets are read again, for these classes only."""
        family = connected_components(pairs)
        info = durable(classes.join(family.select(F.col("node").alias("c1"), F.col("component").alias("family")), "c1").select("c1", "c2", "n", F.coalesce("rep", "c1").alias("node"), "rep", "family"))
        number, held = info.agg(F.count(F.lit(1)), F.sum("n")).first()
        bins = max(1, -(-int(held or 0) // BIN))
        located = durable(_binned(_orient(pairs), info, bins))
        places = located.select(F.explode(F.array("a", "b")).alias("c1"), "bin").groupBy("c1").agg(F.collect_set("bin").alias("bins"))
        bits = min(MOST_MARKS, max(1 << 16, 64 * number))
        marks = context.broadcast(_marks(info, "rep", bits))
        sets = _sets_of(rows, marks, bits, words).join(info.join(places, "c1").select("c1", "c2", "n", "node", "bins"), ["c1", "c2", "n"])
        sets = sets.select(F.explode("bins").alias("bin"), "c1", "node", "shingles")
        return durable(located.groupBy("bin").cogroup(sets.groupBy("bin")).applyInArrow(_verify(percent), "u long, v long").distinct())

    first = verified(enough(lists.mapInArrow(releasing(_star_pairs(percent, n_buckets)), COUNTED)))
    merged = connected_components(first)
    tidy(spark)
    # A class hash that two classes share stands for neither.
    single = classes.groupBy("c1").agg(F.count(F.lit(1)).alias("k"), F.first(F.coalesce("rep", "c1")).alias("node")).filter("k = 1")
    labels = single.join(merged, "node").select(F.pmod("c1", F.lit(n_buckets)).cast("int").alias("of_part"), "c1", F.col("component").alias("label"))
    split = lists.select("bucket", "c1").mapInArrow(_split_classes(n_buckets), "part int, bucket int, c1 binary")
    labelled = split.groupBy("part").cogroup(labels.groupBy("of_part")).applyInArrow(_label, "bucket int, c1 binary, label binary")
    left = durable(lists.groupBy("bucket").cogroup(labelled.groupBy("bucket")).applyInArrow(_prepare, PREPARED))
    to_count = left.agg(F.sum("pairs")).first()[0] or 0
    if to_count:
        sliced = left.filter("pairs > 0").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).repartition("bucket", "slice")
        rest = enough(sliced.mapInArrow(releasing(_cross_pairs(percent, max(n_buckets, to_count // PART))), COUNTED))
        if rest.limit(1).count():
            more = verified(rest)
            if more.limit(1).count():
                merged = connected_components(merged.union(more))

    reps = classes.select(F.coalesce("rep", "c1").alias("node"), "rep")
    named = merged.join(reps, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = merged.join(named, "component").select("node", "component_id")
    of_class = classes.withColumn("node", F.coalesce("rep", "c1")).join(linked, "node", "left").select("c1", "c2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    some = found.filter("n > 0").join(of_class, ["c1", "c2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(found.filter("n = 0").select("doc_id", "n", "doc_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, one document of each component: the one with the smallest id.

    Rows without an id stay only where no row that they reach has one. Rows without
    words, or without text, all stay; of rows with the id that stays, each one does.
    Very long texts are whole, and an empty table gives an empty one.
    """
    kept = near_duplicates(docs, words, percent, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(kept, F.col(f"row.`{id_col}`").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
