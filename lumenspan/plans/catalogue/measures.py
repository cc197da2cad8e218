"""Measures: agreement, intervals of shares, scores of predictions, resampling, choice of thresholds, report tables."""

from pyspark.sql import functions as F

from ...functions import stats as S
from ...functions import text as T
from ...operators import evaluation, evidence, sampling
from .base import IN_TURN, in_turn, table


def _judges(spark, sf):
    """Two judges of every labelled document: its quality, and whether it isn't toxic."""
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("a"), (1 - F.col("toxic")).cast("int").alias("b"))


def kappa(spark, sf):
    k = S.kappa(_judges(spark, sf).withColumn("part", F.col("doc_id") % 4), "a", "b", ("part",))
    return k.select("part", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def confusion(spark, sf):
    return S.confusion(_judges(spark, sf), "a", "b")


def majority_vote(spark, sf):
    """Three votes on every order: by status, by priority, by price."""
    o = table(spark, sf, "orders")
    v = F.array(F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no"), F.when(F.col("o_orderpriority") < "3", "yes").otherwise("no"), F.when(F.col("o_totalprice") > 150000, "yes").otherwise("no"))
    return o.select("o_orderkey", S.majority(v, "yes").alias("passed"))


def wilson_ci(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    return rows.select("l_returnflag", "l_linestatus", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def _predictions(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", ((F.col("event_id") * 7) % 6 - 1).alias("truth"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * 7) % 6 - 1).otherwise(F.col("event_id") % 8 - 1).alias("pred"))


_PREDICTIONS = "predictions AS (SELECT user_id, (event_id * 7) % 6 - 1 AS truth, CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 6 - 1 ELSE event_id % 8 - 1 END AS pred FROM events)"


def micro_f1_labelset(spark, sf):
    return evaluation.micro_f1(_predictions(spark, sf), ["user_id"]).select("user_id", F.round("f1", 6).alias("f1"))


def answered_metrics(spark, sf):
    a = evaluation.answered(_predictions(spark, sf), ["user_id"])
    return a.select("user_id", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


def macro_prf(spark, sf):
    p = _predictions(spark, sf).withColumn("pred", F.when(F.col("pred") >= 0, F.col("pred")))
    m = evaluation.macro_prf(p)
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "p", "r", "f1")))


def token_f1(spark, sf):
    """Benchmark passages in turn as answers, the documents as references."""
    rows = in_turn(spark, sf).select("doc_id", "item_id", T.ascii_tokens(F.col("passage")).alias("p"), T.ascii_tokens(F.col("text")).alias("r"))
    s = S.set_prf(F.col("p"), F.col("r"))
    return rows.select("doc_id", "item_id", *(F.round(s[c], 6).alias(c) for c in ("p", "r", "f1")))


def ngram_bleu(spark, sf):
    """BLEU of every benchmark passage against its successor with the passage's first half."""
    items = table(spark, sf, "benchmark").select("item_id", T.ascii_tokens(F.col("text")).alias("t"))
    rows = items.withColumn("r", F.concat(F.slice("t", 1, F.greatest((F.size("t") / 2).cast("int"), F.lit(1))), F.array(F.lit("zzz"))))
    return rows.select("item_id", F.round(S.bleu4(F.col("t"), F.col("r")), 6).alias("bleu"))


def cluster_bootstrap(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return evaluation.cluster_bootstrap(rows, "source", "quality", "lang", draws=2000)


def stratified_positions(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "doc_id")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"))
    return counted.select("lang", "n", F.posexplode(sampling.stratum_edges(F.col("n"), 7)).alias("k", "edge")).select("lang", "n", F.col("k").cast("long").alias("k"), "edge")


def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 0.1, 3, "audit").select("source", "doc_id")


def far_threshold(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.round(F.col("embedding")[0].cast("double") * 5 + F.col("label") / 5, 4).alias("z"), (F.col("label") >= 5).alias("related"))
    t = evaluation.false_accept_threshold(rows)
    return t.select("threshold", F.round("accepts", 6).alias("accepts"), F.round("rejects", 6).alias("rejects"))


def _grid(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.groupBy(F.concat(F.lit("s"), F.col("l_linenumber")).alias("lecture"), F.col("l_discount").alias("setting")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))


def leave_one_out(spark, sf):
    return evaluation.leave_one_out(_grid(spark, sf))


def constrained_argmax(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_discount").alias("setting")).agg(F.round(F.avg("l_tax"), 9).alias("precision"), F.round(F.avg((F.col("l_quantity") > 10).cast("double")), 9).alias("coverage"))
    return evaluation.constrained_best(g, 0.5)


def mode_matrix_mean_std(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("value"))
    m = evaluation.mean_of_runs(cells, ["l_returnflag", "l_linestatus"])
    return m.select("l_returnflag", "l_linestatus", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "runs")


def group_sets_report(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    g = rows.groupingSets([("lang", "source"), ("lang",), ()], "lang", "source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))
    return g.select("lang", "source", "n", "good")


def rollup_overall(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


def pivot_cells(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).na.fill(0)


def change_ratio(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 4 - 1).alias("v"))
    c = evaluation.change_rate(e, ["user_id"], "event_id", "v")
    return c.select("user_id", F.round("changes", 6).alias("changes"), F.round("absent", 6).alias("absent"))


def run_agreement(spark, sf):
    e = table(spark, sf, "events")
    runs = e.select(F.col("event_type").alias("run"), F.col("user_id").alias("qid"), F.lit("u").alias("unit"), (F.col("value") > 50).cast("int").alias("v")).groupBy("run", "qid", "unit").agg(F.max("v").alias("verdict"))
    return evaluation.agreement_of_runs(runs).select("a", "b", "n", F.round("agreement", 6).alias("agreement"))


def rank_correlation(spark, sf):
    r = evaluation.spearman(table(spark, sf, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice")
    return r.select(F.round("rho", 6).alias("rho"))


def claim_support(spark, sf):
    """Claims cut from documents, checked against the documents that they cite."""
    docs = table(spark, sf, "documents")
    claims = docs.select(F.col("doc_id").alias("qid"), F.substring("text", 1, 80).alias("claim"), (F.col("doc_id") - F.col("doc_id") % 3).alias("cited"))
    judged = claims.join(docs.select(F.col("doc_id").alias("cited"), "text"), "cited")
    verdict = F.when(F.col("qid") % 5 == 0, "weak").when(evidence.quotable(F.col("claim"), F.col("text")), "supported").otherwise("unsupported")
    report = evidence.answer_report(judged.select((F.col("qid") % 20).alias("qid"), verdict.alias("verdict")))
    return report.select("qid", "claims", "supported", "weak", "unsupported", F.round("rate", 6).alias("rate"))


def mock_answer(spark, sf):
    """Answers to all benchmark passages, each quoted from all documents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    a = evidence.quoted_from_all(docs, asked)
    return a.select("qid", F.col("nth").cast("long").alias("nth"), F.md5("text").alias("text_md5"), "id")


def citation_correctness(spark, sf):
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id"))
    gold = cited.where("id % 2 = 0")
    return evidence.citation_correctness(cited, gold).select("qid", "correct", "cited", F.round("share", 6).alias("share"))


QUERIES = {
    "kappa": (kappa, """
WITH j AS (SELECT doc_id % 4 AS part, quality::INT AS a, (1 - toxic)::INT AS b FROM labels),
s AS (SELECT part, count(*) AS n, avg((a = b)::INT) AS agreement, sum(a) AS ya, sum(b) AS yb FROM j GROUP BY part),
c AS (SELECT *, (ya * yb + (n - ya) * (n - yb)) / (n * n)::DOUBLE AS chance FROM s)
SELECT part, n, round(agreement, 6) AS agreement, round(CASE WHEN chance >= 1 THEN 1 ELSE (agreement - chance) / (1 - chance) END, 6) AS kappa FROM c"""),
    "confusion": (confusion, "SELECT quality::INT AS a, (1 - toxic)::INT AS b, count(*) AS n FROM labels GROUP BY ALL"),
    "majority_vote": (majority_vote, "SELECT o_orderkey, 2 * ((o_orderstatus = 'F')::INT + (o_orderpriority < '3')::INT + (o_totalprice > 150000)::INT) > 3 AS passed FROM orders"),
    "wilson_ci": (wilson_ci, """
WITH r AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS k FROM lineitem GROUP BY ALL),
x AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM r)
SELECT l_returnflag, l_linestatus, n, k,
  round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS low,
  round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS high FROM x"""),
    "micro_f1_labelset": (micro_f1_labelset, f"""
WITH {_PREDICTIONS}, l AS (SELECT user_id, list(DISTINCT truth) AS known FROM predictions GROUP BY user_id),
c AS (SELECT p.user_id, count(*) FILTER (WHERE truth = pred) AS tp, count(*) FILTER (WHERE truth <> pred AND list_contains(known, pred)) AS fp, count(*) FILTER (WHERE truth <> pred) AS fn
  FROM predictions p JOIN l USING (user_id) WHERE truth <> -1 GROUP BY p.user_id)
SELECT user_id, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""),
    "answered_metrics": (answered_metrics, f"""
WITH {_PREDICTIONS} SELECT user_id, round(avg((truth = pred)::INT) FILTER (WHERE pred <> -1), 6) AS precision, round(avg((pred <> -1)::INT), 6) AS coverage FROM predictions WHERE truth <> -1 GROUP BY user_id"""),
    "macro_prf": (macro_prf, f"""
WITH {_PREDICTIONS}, p AS (SELECT truth, CASE WHEN pred >= 0 THEN pred END AS pred FROM predictions),
labels_ AS (SELECT truth AS label FROM p UNION SELECT pred FROM p WHERE pred IS NOT NULL),
c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label) AS t, (SELECT count(*) FROM p WHERE pred = label) AS g, (SELECT count(*) FROM p WHERE truth = label AND pred = label) AS tp FROM labels_)
SELECT sum(t)::BIGINT AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN g > 0 THEN tp / g ELSE 0 END), 6) AS p, round(avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END), 6) AS r,
  round(avg(CASE WHEN tp > 0 THEN 2 * tp / (g + t) ELSE 0 END), 6) AS f1 FROM c"""),
    "token_f1": (token_f1, f"""
WITH {IN_TURN}, x AS (
  SELECT doc_id, item_id, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS r FROM in_turn),
y AS (SELECT *, len(list_intersect(p, r)) AS k FROM x),
z AS (SELECT *, CASE WHEN len(p) > 0 THEN k / len(p) ELSE 0 END AS pp, CASE WHEN len(r) > 0 THEN k / len(r) ELSE 0 END AS rr FROM y)
SELECT doc_id, item_id, round(pp, 6) AS p, round(rr, 6) AS r, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS f1 FROM z"""),
    "ngram_bleu": (ngram_bleu, None),
    "cluster_bootstrap": (cluster_bootstrap, None),
    "stratified_positions": (stratified_positions, """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, k, round_even(k * n / 7, 0)::BIGINT AS edge FROM (SELECT lang, n, unnest(range(0, 8)) AS k FROM c)"""),
    "stratified_sample": (stratified_sample, """
SELECT source, doc_id FROM (
  SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY substr(md5('audit:' || source || ':' || doc_id), 1, 12), doc_id) AS o FROM documents)
WHERE o <= greatest(3, round_even(n * 0.1, 0))"""),
    "far_threshold": (far_threshold, """
WITH s AS (SELECT round(embedding[1]::DOUBLE * 5 + label / 5, 4) AS z, label >= 5 AS related FROM embeddings),
c AS (SELECT DISTINCT round(z, 2) AS t FROM s UNION SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0])),
r AS (SELECT t, avg((z >= t)::INT) FILTER (WHERE NOT related) AS accepts, avg((z < t)::INT) FILTER (WHERE related) AS rejects FROM c CROSS JOIN s GROUP BY t)
SELECT t AS threshold, round(accepts, 6) AS accepts, round(rejects, 6) AS rejects FROM r WHERE accepts <= 0.05 ORDER BY t LIMIT 1"""),
    "leave_one_out": (leave_one_out, """
WITH g AS (SELECT 's' || l_linenumber AS lecture, l_discount AS setting, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL),
r AS (SELECT h.lecture AS held, h.setting, h.value, round((SELECT avg(o.value) FROM g o WHERE o.setting = h.setting AND o.lecture <> h.lecture), 9) AS m FROM g h)
SELECT held, setting, value FROM r WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY held ORDER BY m DESC, setting DESC) = 1"""),
    "constrained_argmax": (constrained_argmax, """
WITH g AS (SELECT l_discount AS setting, round(avg(l_tax), 9) AS precision, round(avg((l_quantity > 10)::INT), 9) AS coverage FROM lineitem GROUP BY ALL)
SELECT setting, precision, coverage FROM g WHERE coverage >= 0.5 ORDER BY precision DESC, setting DESC LIMIT 1"""),
    "mode_matrix_mean_std": (mode_matrix_mean_std, """
WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS runs FROM r GROUP BY ALL"""),
    "group_sets_report": (group_sets_report, "SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS good FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (lang), ())"),
    "rollup_overall": (rollup_overall, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "pivot_cells": (pivot_cells, """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) FILTER (WHERE l_linestatus = 'F') AS "F" FROM lineitem GROUP BY l_returnflag"""),
    "change_ratio": (change_ratio, """
WITH e AS (SELECT user_id, event_id % 4 - 1 AS v, lag(event_id % 4 - 1) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, round(sum(coalesce((v <> p)::INT, 0)) / count(DISTINCT v), 6) AS changes, round(avg((v = -1)::INT), 6) AS absent FROM e GROUP BY user_id"""),
    "run_agreement": (run_agreement, """
WITH r AS (SELECT event_type AS run, user_id AS qid, max((value > 50)::INT) AS verdict FROM events GROUP BY ALL)
SELECT x.run AS a, y.run AS b, count(*) AS n, round(avg((x.verdict = y.verdict)::INT), 6) AS agreement FROM r x JOIN r y USING (qid) WHERE x.run < y.run GROUP BY ALL"""),
    "rank_correlation": (rank_correlation, """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)
SELECT round(corr(a, b), 6) AS rho FROM r"""),
    "claim_support": (claim_support, """
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS t, trim(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', ' ', 'g'), ' ') AS c, contains(substr(text, 1, 80), '...') OR contains(substr(text, 1, 80), '…') AS cut FROM documents),
v AS (SELECT a.doc_id, CASE WHEN a.doc_id % 5 = 0 THEN 'weak' WHEN length(a.c) > 0 AND contains(b.t, a.c) THEN 'supported' ELSE 'unsupported' END AS verdict FROM n a JOIN n b ON b.doc_id = a.doc_id - a.doc_id % 3)
SELECT doc_id % 20 AS qid, count(*) AS claims, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'weak') AS weak, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported,
  round(count(*) FILTER (WHERE verdict = 'unsupported') / count(*), 6) AS rate FROM v GROUP BY doc_id % 20"""),
    "mock_answer": (mock_answer, None),
    "citation_correctness": (citation_correctness, "SELECT l_orderkey AS qid, count(*) FILTER (WHERE l_partkey % 2 = 0) AS correct, count(*) AS cited, round(count(*) FILTER (WHERE l_partkey % 2 = 0) / count(*), 6) AS share FROM lineitem GROUP BY l_orderkey"),
}
