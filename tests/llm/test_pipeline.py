"""The corpus pipeline against a plain version of each stage, each on its own input."""

import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from causeway.llm import mixing, packing, quality  # noqa: E402
from causeway.llm.frames import written  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF)))
    return tables


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.score_quality(stages[0], quality.fit_quality(stages[0], labels))
    good = {r.doc_id for r in scores.collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
    assert rows(stages[1]) == Counter({r: n for r, n in rows(stages[0]).items() if r[0] in good})
    marked = {r.doc_id: r.quality for r in labels.collect()}
    right = sum((i in good) == bool(q) for i, q in marked.items())
    assert right >= 0.95 * len(marked)


def test_exact(stages):
    least = {}
    for r in stages[1].collect():
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    kept = set(least.values())
    assert rows(stages[2]) == Counter({r: n for r, n in rows(stages[1]).items() if r[0] in kept})


def test_near(stages):
    sets = {}
    for r in stages[2].collect():
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (r.text or "").encode().lower()) if x]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            if (group[i], group[j]) != (low, low):
                group[i] = group[j] = low
                changed = True
    assert {r.doc_id for r in stages[3].collect()} == {i for i in sets if group[i] == i}


def test_mixture(stages):
    size = {r.doc_id: (len(re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode())), r.source) for r in stages[3].collect()}
    whole = defaultdict(int)
    for n, s in size.values():
        whole[s] += n
    want = mixing.targets(dict(whole))
    got, times = defaultdict(int), Counter()
    for r in stages[4].collect():
        got[r.source] += size[r.doc_id][0]
        times[r.doc_id] += 1
    longest = {s: max(n for n, t in size.values() if t == s) for s in whole}
    assert max(times.values()) <= 2
    assert all(abs(got[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in whole)


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for r in stages[4].collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        for k, (s, m) in enumerate(packing.cut(n, 2048)):
            want[r.doc_id, k, s, m] += 1
    out = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:])) and sum(placed[-1]) <= 2048
    assert len(by) <= 1.03 * sum(r.length for r in out) / 2048 + 1


def test_run_gives_the_last_stage(spark, stages):
    assert Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.piece, r.length) for r in stages[5].collect())
