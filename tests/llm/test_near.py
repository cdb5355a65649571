"""Near duplicates where a passage makes long posting lists and one large family."""

import random

import pytest

from causeway.llm import ngram_join


def components(rows, percent=80):
    sets = {}
    for doc, text in rows:
        w = text.split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    # Own words from 4 to 24: some are similar to many, some to few, some to none.
    texts = [" ".join(passage + [word() for _ in range(4 + i % 21)]) for i in range(150)]
    family = [word() for _ in range(80)]
    texts += [" ".join(family[:k] + [word()] + family[k + 1 :]) for k in range(70)]
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hold", [1 << 20, 2000])
def test_hot_posting_lists_against_brute_force(spark, rows, monkeypatch, hold):
    monkeypatch.setattr(ngram_join, "BIN", hold)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == components(rows)
    assert len(set(got.values())) < len(got) - 70


def test_large_families_are_cut_and_hubs_are_turned(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BIN", 1000)
    pairs = spark.createDataFrame([(1, k) for k in range(2, 600)] + [(700, 701)], "a long, b long")
    turned = ngram_join._orient(pairs)
    assert turned.filter("a = 1").count() == 0 and turned.filter("b = 1").count() == 598
    info = spark.createDataFrame([(k, 1, 100) for k in range(1, 600)] + [(700, 700, 50), (701, 700, 50)], "c1 long, family long, n long")
    binned = ngram_join._binned(turned, info, 60).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in binned} == {(1, k) for k in range(2, 600)} | {(700, 701)}
    by = {}
    for r in binned:
        by.setdefault(r.bin, []).append(r)
    assert len(by) > 20 and max(map(len, by.values())) < 100


def test_components_with_hubs_and_long_paths(spark):
    from causeway.llm.components import connected_components

    links = [(5000, k) for k in range(5001, 7500)] + [(k, 4999) for k in range(8000, 10000)] + [(5000, 9999)] + [(k + 1, k) for k in range(20000, 20040)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 4999 for x in {4999, *range(5000, 7500), *range(8000, 10000)}} | {x: 20000 for x in range(20000, 20041)}
