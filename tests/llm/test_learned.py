"""Language and quality against plain versions, and the pipeline on awkward rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import exact_dedup, language_id, mixing, ngram_join, packing, quality


def test_pair_tables_against_plain_convolution():
    net = language_id.train(np.zeros((0, 0)), np.zeros(0), ["a", "b", "c"], seed=3)
    texts = [bytes(np.random.default_rng(k).integers(0, 256, n).astype(np.uint8)) for k, n in enumerate((1, 40, 256, 257, 900))]
    windows, of, _ = language_id.cut_windows(texts)
    want = np.zeros((len(windows), sum(len(b) for b in net.bias)))
    for i, window in enumerate(windows):
        column = 0
        for width, kernel, bias in zip(language_id.WIDTHS, net.filters, net.bias):
            for f in range(len(bias)):
                outputs = [bias[f] + sum(float(net.embedding[window[at + j]] @ kernel[j, :, f]) for j in range(width)) for at in range(language_id.WINDOW)]
                want[i, column] = max(0.0, max(outputs))
                column += 1
    assert np.allclose(net.pooled(windows, net.tables()), want, atol=1e-4)
    assert of.tolist() == [0, 1, 2, 3, 3, 4, 4, 4, 4]


def test_language_of_copied_and_very_long_texts(spark):
    rng = random.Random(4)
    one = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [("aa", one("abcdefg", 30)) for _ in range(1000)] + [("bb", one("uvwxyz", 60))] * 12_000
    table = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id()).withColumn("score", F.lit("own"))
    net = language_id.fit_language(table)
    found = language_id.identify_language(table, net).join(table.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() == len(rows)
    long = spark.createDataFrame([(1, one("abcdefg", 400_000)), (2, one("uvwxyz", 400_000))], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify_language(long, net).orderBy("doc_id").collect()] == ["aa", "bb"]


def test_statistics_against_plain_ones():
    rng = random.Random(9)
    texts = ["", "a", "One two, two!\n\nthree 3.", "éé | x\tAAAA  b"] + [" ".join(rng.choice(["the", "The", "x1", "stop.", "a,b", "!!", "\n"]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    got = quality.statistics([t.encode() for t in texts])
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for text, row in zip(texts, got):
        raw = text.encode()
        found = dict(zip(quality.STATISTICS, row))
        words = raw.split()
        lower = [w.lower() for w in words]
        n, m = max(1, len(raw)), max(1, len(words))
        counts = Counter(raw)
        want = {
            "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / m, "longest_word": max(map(len, words), default=0),
            "upper": sum(65 <= c < 91 for c in raw) / n, "letters": sum(chr(c).isalpha() and c < 128 for c in raw) / n, "digits": sum(48 <= c < 58 for c in raw) / n, "beyond_ascii": sum(c > 127 for c in raw) / n,
            "stops": sum(c in b".!?" for c in raw) / n, "commas": sum(c in b",;:" for c in raw) / n, "bars": raw.count(b"|") / m, "distinct_words": len(set(lower)) / m,
            "top_word": max(Counter(lower).values(), default=0) / m, "repeats_in_a_row": sum(a == b for a, b in zip(lower, lower[1:])) / m, "words_a_line": len(words) / (raw.count(b"\n") + 1),
            "entropy": -sum(c / n * math.log2(c / n) for c in counts.values()),
        }
        for k, v in want.items():
            assert found[k] == pytest.approx(v, abs=1e-9), (k, text)


def test_quality_of_copies_and_very_long_texts(spark):
    rng = random.Random(3)
    good = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."
    rows = [(i, good(80) if i % 2 else "spam $$$ " * 40) for i in range(200)] + [(7, good(90))] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(7, 1)] * 50, "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scores = quality.score_quality(docs, model)
    assert scores.count() == 500 and scores.filter((F.col("score") >= 0.5) != (F.col("doc_id") % 2 == 1)).count() == 0
    long = spark.createDataFrame([(1, good(300_000)), (2, "spam $$$ " * 300_000), (3, None)], "doc_id long, text string")
    assert quality.score_quality(long, model).count() == 3


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, block int, mix_shard string, label int, score double"


def make(spark, rows):
    rest = (None, 1, "r", 5, 6, "s", 7, 0.5)
    return spark.createDataFrame([(i, t, "xx", s, *rest[1:]) for i, t, s in rows], COLUMNS)


def awkward():
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    base = prose(120)
    rows = [(i, prose(rng.randint(5, 80)), "ab"[i % 2]) for i in range(60)] + [(100 + i, base, None) for i in range(20)] + [(200 + i, f"{base} {i}", "c") for i in range(10)]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n ", "b"), (303, prose(30_000), "b"), (None, "no id here", "a"), (5, rows[5][1], "b"), (304, None, None)]
    return rows + [rows[3], rows[3]]


def stage_functions():
    labels = lambda spark: spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(60)], "doc_id long, quality int")
    return {
        "quality": lambda spark, docs: quality.filter_quality(docs, quality.fit_quality(docs, labels(spark))),
        "exact": lambda spark, docs: exact_dedup.drop_duplicates(docs),
        "near": lambda spark, docs: ngram_join.drop_near_duplicates(docs),
        "mixing": lambda spark, docs: mixing.plan_mix(docs).rows(keep=False),
    }


@pytest.mark.parametrize("stage", stage_functions())
def test_stages_keep_columns_of_awkward_rows(spark, stage):
    rows = awkward()
    docs = make(spark, rows).repartition(3)
    out = stage_functions()[stage](spark, docs)
    assert out.schema.fieldNames() == docs.schema.fieldNames()
    got, have = Counter((r.doc_id, r.text, r.source) for r in out.collect()), Counter(rows)
    assert got and set(got) <= set(have)
    if stage == "quality":
        assert all(n == have[k] for k, n in got.items())
    if stage == "exact":
        assert len({" ".join((t or "x").split()) for _, t, _ in got}) == len({" ".join((t or "x").split()) for _, t, _ in have})
    if stage == "near":
        assert {300, 301, 302, 304} <= {i for i, *_ in got} and sum(100 <= (i or 0) < 300 for i, *_ in got) == 1
    if stage == "mixing":
        assert all(n <= 2 * have[k] for k, n in got.items())
    assert stage_functions()[stage](spark, docs.limit(0)).count() == 0


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("some", awkward()), ("none", [])):
        folder = tmp_path / name
        make(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        pieces = out.collect()
        assert bool(pieces) == bool(rows) and {r.doc_id for r in pieces} <= {i for i, *_ in rows}
        assert packing.pack(make(spark, rows)).count() >= len(rows)
