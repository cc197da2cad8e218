"""Search: vectors, BM25, fusion, recall, set selection, alignment of sequences."""

from pyspark.sql import functions as F

from ...operators import alignment, evaluation, evidence, graph, ranking, segments, selection
from .. import retrieval
from .base import CHUNKS, MATRIX, POOLS, TOKENS, indexed, matrix, pools, questions, table


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "pos")


def dense_topk(spark, sf):
    """The ten nearest vectors of every twentieth one."""
    v = _vectors(spark, sf)
    asked = v.where("pos % 20 = 0").select(F.col("pos").alias("qid"), "embedding")
    return ranking.dense_top_k(v, asked, 10).select("qid", "pos", F.round("score", 4).alias("score"))


def knn_per_label(spark, sf):
    """Of every twentieth vector the three nearest others of its label."""
    v = _vectors(spark, sf)
    v = v.withColumnRenamed("embedding", "vector")
    asked = v.where("pos % 20 = 0").withColumnRenamed("pos", "qid")
    return ranking.nearest_in_group(asked, v, "label", 3).select("qid", "pos", "score", F.col("rank").cast("long").alias("rank"))


def pair_cosine_diag(spark, sf):
    d = graph.set_diagnostics(pools(spark, sf))
    return d.select("qid", "units", "modalities", F.round("redundancy", 6).alias("redundancy"))


def bm25_topk(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    best = ranking.Bm25(indexed(spark, sf)).top_k(asked, 10)
    return best.select("qid", "pos", F.round("score", 4).alias("score"))


def rrf_hybrid(spark, sf):
    """Hybrid retrieval of every benchmark passage: exact vectors and BM25, fused, the best eight."""
    words = indexed(spark, sf)
    units = words.select("pos", "id").join(ranking.hash_bag(words), "pos")
    q = questions(spark, sf)
    s = retrieval.Settings()
    corpus = retrieval.Corpus.__new__(retrieval.Corpus)  # ids are distinct by construction: no pass to check them
    corpus.units, corpus.links, corpus.bm25 = units, None, ranking.Bm25(words)
    return corpus.hybrid(q, s, s.top_k).select("qid", "pos", "id", F.round("score", 6).alias("score"), F.col("nth").cast("long").alias("rank"))


def recall_at_k(spark, sf):
    """Recall of BM25's eight best, with the documents that hold a passage word for word as gold."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = ranking.Bm25(indexed(spark, sf)).top_k(items.select(F.col("item_id").alias("qid"), "text"), 8)
    hits = found.select("qid", F.floor(F.col("pos") / (1 << 20)).cast("string").alias("id")).distinct()
    gold = evidence.quoted_spans(docs, items, exact=True).select(F.col("item_id").alias("qid"), F.col("doc_id").cast("string").alias("id"))
    scored = evaluation.recall_precision(hits, gold)
    return scored.where(~F.isnan("recall")).select("qid", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def rerank_none(spark, sf):
    return selection.by_score(pools(spark, sf), 8)


def rerank_mmr(spark, sf):
    return selection.select(pools(spark, sf), 8, "mmr")


def rerank_complementarity(spark, sf):
    p = pools(spark, sf)
    near = p.select("qid", F.col("id").alias("a"), F.col("nth").alias("x")).join(p.select("qid", F.col("id").alias("b"), F.col("nth").alias("y")), "qid").where("abs(x - y) = 1").select("qid", "a", "b")
    return selection.select(p, 8, "complementarity", near, gate=True)


def modality_gate(spark, sf):
    c = selection.concentration(pools(spark, sf))
    return c.select("qid", F.round("share", 6).alias("share"), F.round("margin", 6).alias("margin"), "dominant", "concentrated")


def align_naive(spark, sf):
    return alignment.naive(matrix(spark, sf))


def align_monotonic(spark, sf):
    return alignment.monotone(matrix(spark, sf))


def align_objective(spark, sf):
    o = alignment.objective(alignment.naive(matrix(spark, sf)))
    return o.select("pair", F.round("value", 6).alias("value"), F.round("mean", 6).alias("mean"), "back_jumps", "slides_used")


def abstain(spark, sf):
    m = matrix(spark, sf)
    return alignment.abstained(alignment.naive(m), m, 0.25)


def row_margin(spark, sf):
    m = alignment.margin(matrix(spark, sf))
    return m.select("pair", "i", "best", F.round("margin", 6).alias("margin"))


def permutation_gate(spark, sf):
    return alignment.related(matrix(spark, sf))


def minmax_fusion(spark, sf):
    m = matrix(spark, sf)
    other = m.withColumn("s", F.round(F.col("s") * F.col("s"), 6))
    return ranking.fused(m, other, ["pair"]).select("pair", "i", "j", F.round("s", 6).alias("s"))


def near_dup_keep(spark, sf):
    p = pools(spark, sf).select("qid", "nth", "id", "embedding")
    return segments.without_repeats(p, "qid", "nth", "embedding", 0.2).select("qid", "id", "kept")


def group_columns(spark, sf):
    m = matrix(spark, sf)
    groups = m.select("pair", "j").distinct().withColumn("g", F.floor(F.col("j") / 3))
    return alignment.grouped_columns(m, groups)


_OKAPI = f"""
{CHUNKS},
tokenised AS (SELECT pos, {TOKENS.format('content')} AS t FROM units),
postings AS (SELECT pos, len, term, count(*) AS tf FROM (SELECT pos, len(t) AS len, unnest(t) AS term FROM tokenised) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tokenised),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, size GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
matched AS (
  SELECT qid, pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN postings USING (term), size GROUP BY qid, pos),
bm25 AS (
  SELECT q.qid, u.pos, coalesce(m.score, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(m.score, 0) DESC, u.pos) AS rank
  FROM (SELECT item_id AS qid FROM benchmark) q CROSS JOIN units u LEFT JOIN matched m ON m.qid = q.qid AND m.pos = u.pos)
"""


def _bag(source: str, key: str, name: str) -> str:
    return f"""
{name}_raw AS (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS i, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({TOKENS.format('content')}) AS term FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, i, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_raw)
"""


QUERIES = {
    "dense_topk": (dense_topk, """
SELECT qid, pos, round(score, 4) AS score FROM (
  SELECT q.vec_id AS qid, v.vec_id AS pos, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""),
    "knn_per_label": (knn_per_label, """
SELECT * FROM (
  SELECT q.vec_id AS qid, v.vec_id AS pos, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 3"""),
    "pair_cosine_diag": (pair_cosine_diag, f"""
WITH {POOLS}, pairs AS (
  SELECT a.qid, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS c
  FROM pools a JOIN pools b ON a.qid = b.qid AND a.modality = b.modality AND a.id < b.id)
SELECT p.qid, count(*) AS units, count(DISTINCT modality) AS modalities, round(coalesce((SELECT avg(c) FROM pairs x WHERE x.qid = p.qid), 0), 6) AS redundancy FROM pools p GROUP BY p.qid"""),
    "bm25_topk": (bm25_topk, f"WITH {_OKAPI} SELECT qid, pos, round(score, 4) AS score FROM bm25 WHERE rank <= 10"),
    "rrf_hybrid": (rrf_hybrid, f"""
WITH {_OKAPI}, contents AS (SELECT item_id AS qid, text AS content FROM benchmark), {_bag('units', 'pos', 'ubag')}, {_bag('contents', 'qid', 'qbag')},
dense AS (
  SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY round(sum(q.w * u.w), 6) DESC, pos) AS rank FROM qbag q JOIN ubag u USING (i) GROUP BY qid, pos),
fused AS (
  SELECT qid, pos, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, pos, rank FROM bm25 WHERE rank <= 50 UNION ALL SELECT qid, pos, rank FROM dense WHERE rank <= 50) GROUP BY qid, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM fused)
SELECT qid, pos, id, round(score, 6) AS score, rank FROM ranked JOIN units USING (pos) WHERE rank <= 8"""),
    "recall_at_k": (recall_at_k, f"""
WITH {_OKAPI}, hits AS (SELECT DISTINCT qid, (pos // 1048576)::VARCHAR AS id FROM bm25 WHERE rank <= 8),
gold AS (SELECT item_id AS qid, doc_id::VARCHAR AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT g.qid, round(count(h.id) / count(*), 6) AS recall, round(count(h.id) / any_value(n.n), 6) AS precision
FROM gold g LEFT JOIN hits h ON h.qid = g.qid AND h.id = g.id JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY qid) n ON n.qid = g.qid GROUP BY g.qid"""),
    "rerank_none": (rerank_none, f"WITH {POOLS} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pools QUALIFY rank <= 8"),
    "rerank_mmr": (rerank_mmr, None),
    "rerank_complementarity": (rerank_complementarity, None),
    "modality_gate": (modality_gate, f"""
WITH {POOLS}, top AS (SELECT * FROM pools WHERE nth < 8),
kinds AS (SELECT qid, modality, count(*) AS n, max(score) AS best, min(nth) AS first FROM top GROUP BY ALL),
lead AS (SELECT qid, modality, n, best, sum(n) OVER (PARTITION BY qid) AS total, max(best) OVER (PARTITION BY qid) AS most, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS r FROM kinds),
chosen AS (SELECT l.*, coalesce((SELECT max(best) FROM kinds k WHERE k.qid = l.qid AND k.modality <> l.modality), 0) AS other FROM lead l WHERE r = 1)
SELECT qid, round(n / total, 6) AS share, round(CASE WHEN most > 0 THEN (greatest(best, 0) - other) / most ELSE 1 END, 6) AS margin, modality AS dominant,
       n / total >= 0.75 OR CASE WHEN most > 0 THEN (greatest(best, 0) - other) / most ELSE 1 END >= 0.5 AS concentrated FROM chosen"""),
    "align_naive": (align_naive, f"WITH {MATRIX} SELECT pair, i, j, s FROM matrix QUALIFY row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) = 1"),
    "align_monotonic": (align_monotonic, None),
    "align_objective": (align_objective, f"""
WITH {MATRIX}, path AS (SELECT pair, i, j, s FROM matrix QUALIFY row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) = 1),
steps AS (SELECT *, j - lag(j) OVER (PARTITION BY pair ORDER BY i) AS d FROM path)
SELECT pair, round((sum(s) - sum(CASE WHEN d > 1 THEN 0.05 * d + 0.02 * (d - 1) WHEN d < 0 THEN -0.15 * d ELSE 0 END)) / count(*), 6) AS value, round(avg(s), 6) AS mean,
       count(*) FILTER (WHERE d < 0) AS back_jumps, count(DISTINCT j) AS slides_used FROM steps GROUP BY pair"""),
    "abstain": (abstain, f"""
WITH {MATRIX} SELECT pair, i, CASE WHEN max(s) OVER (PARTITION BY pair, i) < 0.25 THEN -1 ELSE j END AS j, s FROM matrix QUALIFY row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) = 1"""),
    "row_margin": (row_margin, f"WITH {MATRIX}, r AS (SELECT pair, i, list(s ORDER BY s DESC) AS l FROM matrix GROUP BY ALL) SELECT pair, i, l[1] AS best, round(l[1] - l[2], 6) AS margin FROM r"),
    "permutation_gate": (permutation_gate, None),
    "minmax_fusion": (minmax_fusion, f"""
WITH {MATRIX}, two AS (SELECT pair, i, j, s AS x, round(s * s, 6) AS y FROM matrix)
SELECT pair, i, j, round(0.5 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) + 0.5 * (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 6) AS s FROM two WINDOW w AS (PARTITION BY pair)"""),
    "near_dup_keep": (near_dup_keep, None),
    "group_columns": (group_columns, f"WITH {MATRIX} SELECT pair, i, j // 3 AS j, max(s) AS s FROM matrix GROUP BY pair, i, j // 3"),
}
