"""The operators on texts, against brute force on small tables with every awkward case."""

import bisect
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import exact_dedup, kernels, language_id, mixing, ngram_join, packing, quality, suffix_dedup, window_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, slot int, h string, label int, block int"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def make_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [None, "", "   ", "\n\t", "a", "A b", "one two three four", "ONE two Three four", "z" * 900, "la " * 700]
    texts += [prose(rng.randint(1, 200)) for _ in range(30)]
    texts += [prose(30) + " " + passage + " " + prose(20) for _ in range(5)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 4 + [prose(9000)] + [" ".join(base).replace(" ", "\n  ")]
    rows = [(i, t, "xx", rng.choice(["b", "a", None, "é"]), len(t or ""), "x", 1, "y", 0, 5) for i, t in enumerate(texts)]
    rows.append(rows[15])  # a row given twice
    rows.append((None, "no id here at all, only words", *[None] * 8))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def as_bytes(text):
    return (text or "").encode()


def test_windows_against_brute_force(docs, rows, nothing):
    width = 35
    seen = Counter(tuple(w[i : i + width]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - width + 1))
    want = Counter()
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        want[doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    for block, bucket in ((1000, 3000), (4 << 20, 8 << 20)):
        out = window_dedup.dedup_windows(docs, width, block_bytes=block, bucket_bytes=bucket).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == want
        assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in out)
    assert any(k[2] for k in want)
    assert window_dedup.dedup_windows(nothing).count() == 0


def test_substrings_against_brute_force(docs, rows, nothing):
    length = 100
    seen, want = set(), {}
    for doc, text in sorted({(-1 if r[0] is None else r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        b = as_bytes(text)
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        want[None if doc == -1 else doc] = (len(b), int(gone.sum()), bytes(np.frombuffer(b, dtype=np.uint8)[~gone]))
    for block, bucket in ((1500, 4000), (4 << 20, 16 << 20)):
        out = suffix_dedup.dedup_substrings(docs, length, block_bytes=block, bucket_bytes=bucket).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id], r.doc_id
            assert sum(s.end - s.begin for s in r.spans) == r.n_removed
            assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))
    assert suffix_dedup.dedup_substrings(nothing).count() == 0


def test_substrings_split_a_gram_with_many_contexts(spark):
    rng = np.random.default_rng(8)
    line = "Licensed under terms that stand in every one of these files; see the file of that name beside it for all of them. " * 2
    texts = [bytes(rng.integers(97, 123, 160).astype(np.uint8)).decode() for _ in range(300)]
    rows = [(i, t[:80] + line + t[80:]) for i, t in enumerate(texts + texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup.dedup_substrings(docs, block_bytes=20_000, bucket_bytes=8000, most_contexts=50).collect()
    seen = set()
    for r in sorted(out, key=lambda r: r.doc_id):
        b = as_bytes(rows[r.doc_id][1])
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        assert bytes(r.kept) == bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
    assert len(out) == len(rows)

    def longest(most):
        """The most bytes that contexts of one gram bring to one group."""
        sent = suffix_dedup._contexts(docs, 100, 36, "doc_id", "text", 20_000, 8000, most)[3]
        found = Counter()
        for r in sent.select("bucket", "left", "size", "bytes").collect():
            at = 0
            for left, size in zip(r.left, r.size):
                found[r.bucket, bytes(r.bytes[at + left : at + left + 36])] += size
                at += size
        return max(found.values())

    split, whole = longest(50), longest(10**9)
    assert 4 * split < whole


@pytest.mark.parametrize("alphabet", [2, 30])
def test_multikey_quicksort_groups_by_the_shallow_bytes(alphabet):
    rng = np.random.default_rng(alphabet)
    raw = rng.integers(97, 97 + alphabet, 900).astype(np.uint8)
    raw[300:500] = raw[500:700]
    starts = rng.permutation(800)
    lengths = rng.integers(1, 90, len(starts))
    order, group = suffix_dedup.multikey_quicksort(np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), starts, lengths, 16)
    heads = [raw[s : s + min(n, 16)].tobytes().ljust(16, b"\0") for s, n in zip(starts, lengths)]
    ordered = [heads[i] for i in order]
    assert ordered == sorted(heads) and sorted(order.tolist()) == list(range(len(starts)))
    assert [a == b for a, b in zip(group, group[1:])] == [a == b for a, b in zip(ordered, ordered[1:])]
    assert len(suffix_dedup.multikey_quicksort(raw, starts[:0], lengths[:0], 16)[0]) == 0


def test_equal_contexts_are_told_by_their_bytes():
    strings = [b"abcdefgh" * 14, b"x" * 120, b"abcdefgh" * 14, b"x" * 120, b"abcdefgh" * 14 + b"i", b"x" * 120]
    left = np.array([9, 5, 9, 6, 9, 5])
    size = np.array([len(x) for x in strings])
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    alike = np.zeros(len(strings), dtype=np.uint64)  # hashes that do not tell them apart
    assert suffix_dedup._again(alike, alike, left, raw, size).tolist() == [False, False, True, False, False, True]


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(4)
    raw = np.frombuffer(b"".join([b"abab" * 30, bytes(rng.integers(97, 99, 400).astype(np.uint8)), b"x\0\0\0y" * 20]), dtype=np.uint8)
    starts = rng.permutation(len(raw) - 1)[:300]
    lengths = np.minimum(rng.integers(1, 100, len(starts)), len(raw) - starts)
    order, common = suffix_dedup.deep_shallow(np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), starts, lengths)
    strings = [raw[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    ordered = [strings[i] for i in order]
    assert [s.ljust(100, b"\0") for s in ordered] == sorted(s.ljust(100, b"\0") for s in strings)
    for i in range(1, len(ordered)):
        a, b = ordered[i - 1], ordered[i]
        assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_near_duplicates_against_brute_force(docs, rows, nothing):
    sets = []
    for doc, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.append((doc, s))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)].append(doc)
    want = Counter((doc, len(s), doc if not s else min(least[find(i)], default=None)) for i, (doc, s) in enumerate(sets))
    out = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert any(k[0] != k[2] for k in want)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: n for k, n in want.items() if k[0] == k[2]})
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(2)
    frequency = rng.integers(0, 30, ngram_join.SKETCH_ROWS << ngram_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 80 * (len(a) + len(b) - common):
            (pa, ka), (pb, kb) = (ngram_join.prefix(x, frequency, 80) for x in (a, b))
            shared = len(np.intersect1d(pa, pb))
            assert shared >= min(ka, kb)
            assert shared >= ngram_join.union_bound(len(a), len(b), 80) - max(len(a) - len(pa), len(b) - len(pb))


def test_exact_duplicates(docs, rows, nothing):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    out = exact_dedup.annotate_duplicates(docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(min((i for i in ids if i is not None), default=-1) for ids in groups.values())
    assert exact_dedup.annotate_duplicates(nothing).count() == exact_dedup.drop_duplicates(nothing).count() == 0


def test_exact_dedup_lets_single_rows_pass(spark):
    number = F.when(F.col("id") < 600, F.lit("same")).when(F.col("id") < 4000, (F.col("id") % 1700).cast("string")).otherwise(F.col("id").cast("string"))
    table = spark.range(20_000).select(F.col("id").alias("doc.id"), F.concat(F.lit("text "), number).alias("text"), F.lit(1).alias("h"))
    out = exact_dedup.annotate_duplicates(table, "doc.id").cache()
    assert out.count() == 20_000
    repeated = out.filter("group_size > 1")
    assert repeated.filter("not maybe_twice").count() == 0
    assert repeated.count() == 4000 and out.filter("maybe_twice").count() <= 1.2 * repeated.count()
    assert out.filter("group_size = 600").select("keep_id").distinct().collect() == [(0,)]
    assert exact_dedup.drop_duplicates(table, "doc.id").count() == out.filter("kept").count()


def test_mixture_comes_near_its_targets(spark, docs, rows, nothing):
    table = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 37)), None, "abcde"[min(4, int(math.log2(i + 1)) // 2)], 0, "", 0, "", 0, 0) for i in range(4000)], SCHEMA)
    mix = mixing.plan_mix(table, shard_words=5000)
    taken = mix.taken().collect()
    assert len(taken) == 4000 and all(r.taken <= 2 * r.size for r in taken)
    sums, size, target = Counter(), {}, {}
    for r in taken:
        sums[r.source] += r.taken
        size[r.source], target[r.source] = r.source_size, r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in sums:
        assert abs(sums[s] - target[s]) <= 37 and target[s] <= 2 * size[s] + 1e-6
    drawn = mix.rows().collect()
    again = mixing.plan_mix(table.repartition(5), shard_words=5000)
    assert Counter((r.doc_id, r.mix_shard, r.mix_copy) for r in drawn) == Counter((r.doc_id, r.mix_shard, r.mix_copy) for r in again.rows().collect())
    assert Counter(r.doc_id for r in drawn) == Counter({r.doc_id: r.copies for r in taken if r.copies})
    assert max(Counter((r.doc_id, r.mix_copy) for r in drawn).values()) == 1
    by_shard = Counter(r.mix_shard for r in drawn)
    assert len(by_shard) > 10
    assert mixing.plan_mix(docs).taken().count() == len(rows)
    assert mixing.plan_mix(docs).rows(keep=False).columns == docs.columns
    assert mixing.plan_mix(nothing).taken().count() == mixing.plan_mix(nothing).rows().count() == 0


def test_targets_share_the_excess():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mixing.targets({}) == {}


def test_splitting_tree_keeps_quotas():
    quotas = np.array([70, 0, 5, 200])
    leaves = np.zeros((7, 4), dtype=int)
    for shard, sources, draws in mixing.split_quotas(np.arange(4), quotas, 7, np.random.default_rng(1)):
        assert (draws > 0).all()
        leaves[shard, sources] = draws
    assert (leaves.sum(axis=0) == quotas).all()
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 2


def test_tree_decides_what_is_taken(spark):
    table = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 37)), "ab"[i % 7 > 3]) for i in range(3000)], "doc_id long, text string, source string")
    table = table.withColumn("mix_copy", F.lit("own"))
    few, many = ({r.doc_id: r for r in mixing.plan_mix(table, shard_words=n).taken().collect()} for n in (10**9, 3000))
    assert {s for r in few.values() for s in r.shards} == {0} and len({s for r in many.values() for s in r.shards}) > 10
    assert all(len(r.shards) == r.copies for r in many.values())
    assert sum(few[i].taken != many[i].taken for i in few) > 100
    assert mixing.plan_mix(table).rows().columns == ["doc_id", "text", "source", "mix_shard", "mix_copy"]


def test_many_sources(spark):
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 10_000).alias("source"))
    taken = mixing.plan_mix(table, shard_words=3000).taken()
    assert taken.count() == 30_000 and taken.filter("taken > 2 * size").count() == 0
    assert taken.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 90_000, rel=0.05)


def test_packing_is_exact(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    capacity = 256
    out = packing.pack(docs, capacity).collect()
    pieces = Counter()
    for doc, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            pieces[doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
            assert n <= capacity and (k == 0 or n == capacity)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.01 * plain_best_fit([r.length for r in out], capacity) + 1
    assert packing.pack(nothing).count() == 0


def test_both_encoders_agree():
    encoder = packing.Encoder(packing.vocabulary())
    if encoder.fast is None:
        pytest.skip("one encoder only")
    for text in ["", " ", "a  b\n\n c", "it's we'll I'M", "１２ab", " x　", "<|endoftext|> x", "éé́ 😀😀", "\r\n\t x", "a" * 3000, "## $$ %%%"]:
        assert list(encoder(text)) == encoder.slow.encode(text, add_special_tokens=False).ids


def test_both_encoders_agree_on_a_whole_table(spark):
    folder = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no table of documents")
    encoder = packing.Encoder(packing.vocabulary())
    for r in spark.read.parquet(folder).select("text").collect():
        assert list(encoder(r.text or "")) == encoder.slow.encode(r.text or "", add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    """Sequences that best fit takes, the longest item first, each into the smallest gap that holds it."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "none fits beside", "one"])
def test_best_fit_against_a_plain_one(spark, kind, monkeypatch):
    rng = np.random.default_rng(8)
    lengths = {
        "mixed": np.concatenate([rng.integers(1, 101, 3000), np.full(500, 7), np.full(90, 100)]),
        "equal": np.full(700, 34),
        "tiny": np.full(3000, 1),
        "none fits beside": np.full(400, 51),
        "one": np.array([100]),
    }[kind]
    items = spark.createDataFrame(list(enumerate(lengths.tolist())), "key long, length long").repartition(3)
    out = packing.best_fit(items, 100, task_rows=300).collect()
    assert sorted(r.key for r in out) == list(range(len(lengths)))
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, int(lengths[r.key])))
    for placed in used.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends
            ends += length
        assert ends <= 100
    assert len(used) <= 1.01 * plain_best_fit(lengths.tolist(), 100) + 1


def test_sweeps_of_tasks_meet_like_one_sweep():
    rng = np.random.default_rng(3)
    sizes = sorted(((int(rng.integers(1, 30)), int(rng.integers(0, 2)), k) for k in range(400)), key=lambda e: (-e[0], e[1], e[2]))

    def swept(task, events):
        batch = pa.RecordBatch.from_pylist([{"task": task, "size": s, "piece": bool(p), "key": k, "slot": 1} for s, p, k in events])
        return [r for b in packing.sweep(iter([batch])) for r in b.to_pylist()]

    want = {(r["key"], r["sequence_id"]) for r in swept(0, sizes) if r["key"] is not None}
    cuts = [0, 90, 91, 200, 330, 400]
    rows = [r for t, (a, b) in enumerate(zip(cuts, cuts[1:])) for r in swept(t, sizes[a:b])]
    got = {(r["key"], r["sequence_id"]) for r in rows if r["rank"] is None}
    pieces = {(r["task"], r["rank"]): r["key"] for r in rows if r["rank"] is not None and r["key"] is not None}
    slots = {(r["task"], r["rank"]): r["sequence_id"] for r in rows if r["rank"] is not None and r["key"] is None}
    counts = [(t, sum(k[0] == t for k in pieces), sum(k[0] == t for k in slots)) for t in range(5)]
    for task, first, other, last, n, _ in packing.meetings(counts).tolist():
        got |= {(pieces.pop((task, first + i)), slots[other, last - i]) for i in range(n)}
    assert got | {(k, None) for k in pieces.values()} == want


def test_language_of_many_copies_is_trained_on(spark, monkeypatch):
    rows = [("aa", f"alpha beta gamma {i}") for i in range(9)] * 400 + [("bb", f"delta {i} " + "omega psi chi " * 6000 + "the end") for i in range(3)]
    seen = []
    monkeypatch.setattr(language_id, "train", lambda windows, label, languages: seen.append((windows, label, languages)))
    language_id.fit_language(spark.createDataFrame(rows, "lang string, text string").repartition(3), most_texts=5)
    windows, label, languages = seen[0]
    assert languages == ["aa", "bb"] and np.bincount(label).tolist() == [5, 18]  # a quarter of 18 is 5
    assert len({w.tobytes() for w, k in zip(windows, label) if k == 0}) == 5


def test_language_is_learned_and_held_out(spark, docs, nothing):
    rng = random.Random(1)
    syllables = {"aa": ["the", "ing", "ou", "th"], "bb": ["der", "sch", "ung", "ei"], "cc": ["ción", "ñ", "que", "los"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 200))), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit_language(table.filter("doc_id < 200"))
    found = {r.doc_id: r for r in language_id.identify_language(table, net).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang in rows if i >= 200) >= 97
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs, net).filter("doc_id < 5").collect()}
    assert all(odd[i] == "und" for i in range(4)) and odd[4] != "und"
    assert language_id.identify_language(docs, net).count() == docs.count()
    empty = language_id.fit_language(nothing)
    assert {r.lang_pred for r in language_id.identify_language(docs, empty).collect()} == {"und"}
    assert language_id.identify_language(nothing, net).count() == 0


def test_quality_is_learned_and_held_out(spark, docs, nothing):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(120)) + "."
    bad = lambda: rng.choice([lambda: good().upper() + "!!", lambda: "spam " * 90, lambda: re.sub(" ", "$$$ ", good())])()
    labels = [(i, int(rng.random() < 0.6)) for i in range(400)]
    table = spark.createDataFrame([(i, good() if q else bad()) for i, q in labels], "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:250], (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(table.withColumn("label", F.lit(7)), marks)
    found = {r.doc_id: r.score for r in quality.score_quality(table, model).collect()}
    assert sum((found[i] >= 0.5) == bool(q) for i, q in labels[250:]) >= 145
    kept = quality.filter_quality(docs, model)
    assert kept.schema == docs.schema
    scores = quality.score_quality(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert kept.count() == sum(r.score >= 0.5 for r in scores)
    assert quality.score_quality(docs, quality.fit_quality(nothing, marks)).first().score == pytest.approx(0.5)
    assert quality.score_quality(nothing, model).count() == 0


def test_flat_trees_follow_their_cuts():
    trees = quality.Trees(np.array([[0, 1, 1]]), np.array([[0.5, 2.0, 3.0]]), np.array([[1.0, 2.0, 3.0, 4.0]]), 0.0)
    x = np.array([[0, 0], [0, 9], [1, 0], [1, 9.0]])
    assert np.allclose(np.log(trees.score(x) / (1 - trees.score(x))), [1, 2, 3, 4])


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 203)
    for width in (1, 2, 7, 65, 203, 300):
        assert list(kernels.sliding_min(x, width)) == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_packing_encodes_long_white_space(spark):
    from causeway.llm.packing import encoder_of, vocabulary

    encoder = encoder_of(vocabulary())
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + "\t" * 800_000 + "b", "a  b \n"):
        assert encoder(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids
