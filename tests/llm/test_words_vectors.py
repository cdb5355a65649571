"""Spelling variants, periodic runs and near vectors against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import kernels, periodic, spelling, tiles, vector_dedup

DOCS = "doc_id long, text string, word string, key long, n int"


def words_of(rows):
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = words_of(rows)
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randrange(7, 12))) for _ in range(12)] + ["aaaaaaaa", "abababab"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 3, 40, 900])
        for _ in range(8):
            k = rng.randrange(len(w) + 1)
            edited = rng.choice([w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k + 1 :]])
            words += [edited.upper() if edited.isascii() else edited] * rng.choice([1, 2, 5])
    words += ["mnopqrstu"] * 2 + ["mnopqrst"] * 40 + ["mnopqrs"] * 600
    rng.shuffle(words)
    rows = [(d, " ".join(words[i : i + 40])) for d, i in enumerate(range(0, len(words), 40))]
    return [*rows, (700, None), (701, ""), (702, " \t 1234567 "), (703, "z" * 3000 + " " + "z" * 3000), (None, "abcdefgh abcdefgh"), (704, rows[0][1]), (704, rows[0][1]), (705, "ĀbcdefghŁ cafécafé cafécafé")]


@pytest.mark.parametrize("tile", [20_000, 5])
def test_spelling_against_brute_force(spark, texts, tile):
    docs = spark.createDataFrame([(d, t, "x", 7, 1) for d, t in texts], DOCS).repartition(3)
    got = [tuple(r) for r in spelling.group_variants(docs, tile=tile).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == variants(texts)
    assert any(r[3] for r in got) and any(r[3] and r[5] != r[3] for r in got)


def test_spelling_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None, "x", 1, 1)], DOCS)).count() == 0


def test_three_rarest_bigrams_and_their_sides_miss_no_near_word():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(400)})
    rank = np.zeros(1 << 16, dtype=np.int32)
    for k, g in enumerate(rng.sample(["aa", "ab", "ba", "bb"], 4)):
        rank[ord(g[0]) << 8 | ord(g[1])] = k
    word, key = spelling.postings(pa.array(words), rank)
    groups = collections.defaultdict(set)
    for w, k in zip(word.tolist(), key.tolist(), strict=True):
        groups[k].add(words[w])
    met = {(a, b) for g in groups.values() for a in g for b in g}
    pairs = [(a, b) for a in words for b in words if is_near(a, b)]
    assert len(pairs) > 500 and all(p in met for p in pairs)
    some = [*words, "éÿ×", "éÿ", "éa×", "aéÿ×"]
    i, j = (np.array([rng.randrange(len(some)) for _ in range(3000)] + [len(some) - 4] * 3 + [0]) for _ in "ab")
    j[-4:] = [len(some) - 3, len(some) - 2, len(some) - 1, 0]
    assert spelling.near(*spelling.codes_of(pa.array(["x", *some]).slice(1)), i, j).tolist() == [is_near(some[a], some[b]) for a, b in zip(i, j, strict=True)]


def test_tiles_meet_once(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else 0, k) for k in range(300)] + [(0, k) for k in range(300, 400)] + [(9, 500)], "key long, member long")

    def pairs(batches):
        for batch, number, tile in tiles.grouped(batches, rows=10):
            for i, j in tiles.candidate_pairs(number, tile, most=50):
                m, k = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(np.minimum(m[i], m[j])), pa.array(np.maximum(m[i], m[j]))], ["key", "a", "b"])

    import pyspark.sql.functions as F

    got = [tuple(r) for r in tiles.tiled(rows, "key", F.xxhash64("member"), 20, 401).mapInArrow(pairs, "key long, a long, b long").collect()]
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.key].append(r.member)
    assert sorted(got) == sorted((k, a, b) for k, ms in by.items() for a in ms for b in ms if a < b)


def plain_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc is None else str(doc)).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc, len(found), s, length, q, None if s is None else 1000 * length // q, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randrange(8)):
            u = [rng.choice(["a", "b", "cé", "dd"][: rng.choice([2, 4])]) for _ in range(rng.randrange(1, 9))]
            w += (u * 12)[: rng.randrange(7 * len(u))]
        rows.append((d, rng.choice([" ", "  ", "\n\t"]).join(w)))
    rows += [(900, None), (901, ""), (902, "\n \t"), (903, "a " * 30_000), (904, "x y " * 7), (905, "a a a a a"), (906, "a a a a a a"), (None, "q " * 9), (907, rows[3][1]), (907, rows[3][1])]
    docs = spark.createDataFrame([(d, t, "x", 7, 1) for d, t in rows], DOCS).repartition(3)
    got = sorted(map(repr, (tuple(r) for r in periodic.summary(periodic.find_runs(docs, one_in=10)).collect())))
    assert got == sorted(map(repr, (plain_row(*r) for r in rows)))
    assert periodic.summary(periodic.find_runs(spark.createDataFrame([], DOCS))).count() == 0


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            w = []
            for _ in range(rng.randrange(5)):
                u = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 9))]
                w += (u * 12)[: rng.randrange(7 * len(u))]
            docs.append(w)
        least, times = rng.choice([(6, 4), (8, 5), (4, 4)])
        counts = np.array([len(w) for w in docs])
        value = kernels.mix(np.array(sum(docs, []), dtype=np.uint64) + np.uint64(9))
        s, t, q = periodic.periodic_runs(value, *periodic.masked(value, counts, periodic.least_overlap(least, times)), least, times, most=rng.choice([3, 1 << 20]))
        first = np.cumsum(counts) - counts
        want = sorted((int(f) + a, n, p) for f, w in zip(first, docs, strict=True) for a, n, p in plain_runs(w, least, times))
        assert list(zip(s.tolist(), (t - s).tolist(), q.tolist(), strict=True)) == want
    with pytest.raises(ValueError):
        periodic.find_runs(None, times=3)


VECTORS = "vec_id long, embedding array<float>, label int, rep long, n int, vector string"


def plain_near(rows, least=0.93):
    able = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = collections.Counter(), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(len(able)):
        for b in range(a):
            (i, x, p), (j, y, q) = able[a], able[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    count = {able[k][0]: n for k, n in links.items()}
    return sorted((i, count.get(i, 0), i if i is None else find(i), i is None or find(i) == i) for i, _, _ in rows)


@pytest.mark.parametrize(("tile", "pivots"), [(2048, None), (40, None), (2048, 300)])
def test_vectors_against_brute_force(spark, tile, pivots):
    rng = np.random.default_rng(13)
    rows = [(k, rng.standard_normal(16).tolist(), int(rng.integers(3))) for k in range(500)]
    centre = rng.standard_normal(16)
    rows += [(1000 + k, (centre + 0.16 * rng.standard_normal(16)).tolist(), 1) for k in range(300)]  # some near each other, some not
    for k in range(60):
        x = np.array(rows[k][1])
        rows.append((2000 + k, (x * rng.uniform(0.5, 3) + 0.3 * rng.standard_normal(16)).tolist(), rows[k][2]))
    rows += [(3000 + k, rows[5][1], rows[5][2]) for k in range(90)]  # copies
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [1.0, None], 1), (4003, [float("nan")] * 16, 1), (4004, [float("inf")] * 16, 1), (4005, rows[5][1], None), (4006, [], 1), (4007, [3.0, 4.0], 1), (4008, [6.0, 8.1], 1), (4009, [1e-30, 1e30], 2), (4010, [0.0, 1e30], 2)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, v, lab, 5, 6, "x") for i, v, lab in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(frame, tile=tile, most_pivots=pivots).collect())
    want = plain_near(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and all_links > 10_000
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.98 * all_links
    assert sum(g[2:] == w[2:] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_recall_in_a_large_cluster(spark):
    """Members of one cluster agree on its single pivot, so they meet, however many they are."""
    rng = np.random.default_rng(14)
    rows = [(k, rng.standard_normal(32).tolist(), 0) for k in range(6000)]
    centre = rng.standard_normal(32)
    rows += [(10_000 + k, (centre + 0.1 * rng.standard_normal(32)).tolist(), 0) for k in range(3000)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).filter("vec_id >= 10000").collect()
    assert sum(r.n_links for r in got) >= 0.99 * 3000 * 2999
    assert {r.component_id for r in got} == {10_000}


def test_vectors_rows_given_twice_and_none(spark):
    rows = [(1, [1.0, 2.0], 1, 1, 1, "x")] * 2 + [(None, [1.0, 2.0], 1, 1, 1, "x")]
    got = sorted(map(tuple, vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
