"""The numbered queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, language_id, mixing, ngram_join, packing, periodic, quality, spelling, suffix_dedup, topk, vector_dedup, window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    aside = quality.held_out(F.col("doc_id"), 2, 4)
    net = language_id.fit_language(docs.filter(~aside))
    found = language_id.identify_language(docs, net)
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_dedup.dedup_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate_duplicates(_table(spark, sf_dir, "documents")).drop("maybe_twice")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    aside = quality.held_out(F.col("doc_id"), 1, 3)
    model = quality.fit_quality(docs, labels.filter(~aside))
    scores = quality.score_quality(docs, model)
    return scores.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.find_runs(_table(spark, sf_dir, "documents"), one_in=10))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


_OP2 = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM texts),
strings AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 198 <= len(h) THEN md5(substr(h, 2 * i - 1, 200)) END AS m FROM places),
earlier AS (SELECT doc_id, i, byte, CASE WHEN m IS NOT NULL AND row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM strings),
marked AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM earlier),
edges AS (SELECT *, gone - coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS up FROM marked),
sums AS (SELECT doc_id, sum(gone) AS n, count(*) FILTER (up = 1) AS k, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN sums USING (doc_id)
"""

_OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 80 * (nx + ny - k)),
sides AS (SELECT x AS p, y AS q FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT c AS p, c AS q FROM classes UNION SELECT reach.p, sides.q FROM reach JOIN sides ON reach.q = sides.p),
least AS (SELECT p AS c, min(q) AS component_id FROM reach GROUP BY p)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN least ON least.c = classes.c
"""

_OP4 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1)::BIGINT)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM twice),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(coalesce(ks, []::BIGINT[]), z[2])), lambda z: z[1]), ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

_OP8 = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP9 = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
kept AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN kept USING (t)
"""


# CRC-32 over a list of bytes; the table comes from its polynomial.
_CRC = """
crc_steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps)"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform({}, lambda x: x::UBIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::UBIGINT)"

_OP11 = (
    "WITH RECURSIVE"
    + _CRC
    + r""",
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, list_concat(list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda x: unicode(x)),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))) AS b
  FROM each),
hashed AS (SELECT run, n, """
    + _CRC_OF.format("b")
    + r""" AS h FROM bytes, crc_steps),
lessened AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM lessened WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
shorter AS (SELECT DISTINCT holes.word AS a, holes.n AS na, words.word AS b, words.n AS nb FROM holes JOIN words ON words.word = head || tail),
replaced AS (SELECT x.word AS a, x.n AS na, y.word AS b, y.n AS nb FROM holes x JOIN holes y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word),
near AS (SELECT a, b, nb FROM shorter UNION ALL SELECT b, a, na FROM shorter UNION ALL SELECT a, b, nb FROM replaced),
best AS (SELECT a AS word, count(*) AS n_near, min({'less': -nb, 'other': b}) AS best FROM near GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS up, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.up = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(up, k) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)
"""
)

_OP12 = (
    "WITH"
    + _CRC
    + r""",
split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
hashed AS (SELECT doc_id, w, len(w) AS n, """
    + _CRC_OF.format("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x))")
    + r"""::BIGINT AS h FROM split, crc_steps),
begun AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n END AS a FROM hashed),
texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w
  FROM begun),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal),
found AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
sums AS (
  SELECT doc_id, count(*) AS n_runs, min({'less': -l, 's': s, 'q': q}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list({'b': s + q, 'e': s + l}) AS gone
  FROM runs GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS "start", (-best.less)::BIGINT AS length, best.q::BIGINT AS period, ((-1000 * best.less) // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(n)), lambda z: len(list_filter(gone, lambda r: r.b <= z[2] AND z[2] < r.e)) = 0), lambda z: z[1]) END, ' ')) AS collapsed_sha256
FROM texts LEFT JOIN sums USING (doc_id)
"""
)

_OP13 = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sides AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) >= 0.93 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
counts AS (SELECT p, count(*) AS n FROM sides GROUP BY p),
reach AS (SELECT p, p AS q FROM counts UNION SELECT reach.p, sides.q FROM reach JOIN sides ON reach.q = sides.p),
least AS (SELECT p, min(q) AS m FROM reach GROUP BY p)
SELECT vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.p = vec_id LEFT JOIN least ON least.p = vec_id
"""


def queries() -> dict:
    names = (op1_language_id, op2_suffix_array_dedup, op3_ngram_jaccard_join, op4_substring_dedup, op5_source_mixing, op6_html_extraction, op7_best_fit_packing, op8_exact_top_k, op9_exact_dedup, op10_quality_classifier, op11_spelling_variants, op12_periodic_runs, op13_embedding_near_dedup)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": _OP2, "op3_ngram_jaccard_join": _OP3, "op4_substring_dedup": _OP4, "op8_exact_top_k": _OP8, "op9_exact_dedup": _OP9, "op11_spelling_variants": _OP11, "op12_periodic_runs": _OP12, "op13_embedding_near_dedup": _OP13}
