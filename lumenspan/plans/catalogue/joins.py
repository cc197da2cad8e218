"""Joins on places and times, runs and windows over events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import places as P
from ...operators import evaluation, intervals, segments
from ...sources import readers
from .base import SPANS, spans, table


def _sides(spark, sf, left, right):
    s = spans(spark, sf)
    a = s.where(F.col("event_type") == left).select("user_id", F.col("event_id").alias("a"), F.col("t0").alias("a0"), (F.col("t0") + 3600).alias("a1"))
    b = s.where(F.col("event_type") == right).select("user_id", F.col("event_id").alias("b"), F.col("t0").alias("b0"), (F.col("t0") + 1800).alias("b1"))
    return a, b


_SIDES = f"""
{SPANS},
a AS (SELECT user_id, event_id AS a, t0 AS a0, t0 + 3600 AS a1 FROM spans WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS b, t0 AS b0, t0 + 1800 AS b1 FROM spans WHERE event_type = 'view'),
pairs AS (SELECT user_id, a, b, a0, a1, b0, b1, least(a1, b1) - greatest(a0, b0) AS shared FROM a JOIN b USING (user_id) WHERE a0 < b1 AND a1 > b0)
"""


def interval_overlap_score(spark, sf):
    """Views within an hour of a click of the same user, by the share of the view's half hour."""
    a, b = _sides(spark, sf, "click", "view")
    pairs = intervals.overlap_join(a, b, ["user_id"], 3600.0)
    shared = P.overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return pairs.select("user_id", "a", "b", F.round(F.least(F.lit(1.0), shared / F.greatest(F.lit(1.0), F.col("b1") - F.col("b0"))), 4).alias("score"))


def argmax_overlap(spark, sf):
    a, b = _sides(spark, sf, "click", "view")
    return intervals.greatest_overlap(a, b, ["user_id"], 3600.0).select("user_id", "a", "b", F.round("shared", 3).alias("shared"))


def point_in_interval(spark, sf):
    """For each purchase the first error span of its user that it falls into."""
    s = spans(spark, sf)
    points = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("t0").alias("t"))
    errors = s.where("event_type = 'error'").select("user_id", F.col("event_id").alias("b"), F.col("t0").alias("b0"), (F.col("t0") + 7200).alias("b1"))
    return intervals.point_join(points, errors, ["user_id"], 7200.0).select("user_id", "a", F.coalesce("b", F.lit(-1)).alias("b"))


def as_of_value(spark, sf):
    """For each purchase the value of its user's latest view before."""
    s = spans(spark, sf)
    points = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("t0").alias("t"))
    facts = s.where("event_type = 'view'").groupBy("user_id", F.col("t0").alias("t")).agg(F.max("value").alias("value"))
    return intervals.as_of(points, facts, ["user_id"]).select("user_id", "a", "value")


def iou_hit_at_k(spark, sf):
    """Of each click the first views in time as ranked results, its own hour as gold."""
    a, b = _sides(spark, sf, "click", "view")
    pairs = intervals.overlap_join(a, b, ["user_id"], 3600.0)
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    ranked = pairs.select(F.col("a").alias("qid"), nth.alias("rank"), F.col("b0").alias("s0"), F.col("b1").alias("s1"), F.col("a0").alias("g0"), (F.col("a0") + 1200).alias("g1"))
    h = evaluation.hits_at(ranked)
    return h.select("qid", *(F.col(f"hit_{k}").cast("long").alias(f"hit_{k}") for k in (1, 3, 8)), F.round("best_iou", 6).alias("best_iou"))


def _places(spark, sf):
    """Documents as units on pages of their source; for each a gold place on a page that may or may not hold one."""
    docs, d = table(spark, sf, "documents"), F.col("doc_id")
    none = F.lit(None).cast("double")
    place = lambda page, *first: F.struct(*first, page.cast("int").alias("page"), none.alias("start_s"), none.alias("end_s"))
    found = docs.select((d % 10).alias("qid"), F.col("source").alias("source_file"), place(d % 50).alias("location"))
    gold = docs.select((d % 10).alias("qid"), "doc_id", place((d * 3) % 50, F.col("source")).alias("place"))
    return found, gold


def locator_semi(spark, sf):
    return intervals.gold_hits(*_places(spark, sf))[0].select("qid", "doc_id")


def locator_anti(spark, sf):
    return intervals.gold_hits(*_places(spark, sf))[1].select("qid", "doc_id")


def gold_coverage(spark, sf):
    c = intervals.coverage(*intervals.gold_hits(*_places(spark, sf)))
    return c.select("qid", F.col("found").cast("long").alias("found"), F.col("missed").cast("long").alias("missed"), "covered")


_GOLD = """
held AS (SELECT DISTINCT doc_id % 10 AS qid, source, doc_id % 50 AS page FROM documents),
hits AS (SELECT g.doc_id % 10 AS qid, g.doc_id, h.page IS NOT NULL AS hit FROM documents g LEFT JOIN held h ON h.qid = g.doc_id % 10 AND h.source = g.source AND h.page = (g.doc_id * 3) % 50)
"""


def consecutive_runs(spark, sf):
    e = table(spark, sf, "events")
    return segments.runs(e.withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type"))), ["user_id"], "event_id", "kind").select("user_id", F.col("kind"), "first", "last", "n")


def lag_intervals(spark, sf):
    e = spans(spark, sf).select("user_id", "event_id", F.col("t0").alias("t"))
    x = segments.spans_from_previous(segments.spans_to_next(e, ["user_id"], "t", 5.0), ["user_id"], "t", 3.0)
    return x.select("event_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def trailing_60s_rate(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("t"), F.round("value", 0).cast("long").alias("amount"))
    return intervals.trailing(e, ["event_type"], 60).select("event_id", "requests", F.col("total").alias("tokens"))


def local_argmin_bucket(spark, sf):
    """For every user's hundredth second targets, the quietest bucket of an hour within a day."""
    e = table(spark, sf, "events").select("user_id", (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)") - 1704067200).cast("double").alias("t"), F.col("value").alias("level"))
    targets = e.groupBy("user_id").agg(F.floor(F.avg("t") / 3600).alias("h")).select("user_id", (F.col("h") * 3600.0).alias("target"))
    return segments.quietest(e, targets, "user_id", 86400.0, 3600.0).select("user_id", "target", F.col("offset").cast("double").alias("offset"))


def fixed_span_pack(spark, sf):
    words = readers.spoken(table(spark, sf, "conversations"))
    packed = segments.fixed_spans(words, "by", 30.0)
    return packed.groupBy("by", "bucket").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def greedy_pack(spark, sf):
    words = readers.spoken(table(spark, sf, "conversations"))
    sentences = segments.sentences_of_words(words, ["by"])
    packed = segments.packed(sentences, "by", 30.0)
    return packed.groupBy("by", "bucket").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def slide_changes(spark, sf):
    """Slides of each user's events, whose kinds stand for image hashes."""
    h = F.when(F.col("event_type").isin("view", "click"), F.lit(0)).when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(0xFFFF))
    frames = table(spark, sf, "events").withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double")).select("user_id", "t", h.cast("long").alias("hash"))
    s = segments.slides(frames, "user_id")
    return s.select("user_id", "slide", "hash", F.size("spans").cast("long").alias("visits"))


QUERIES = {
    "interval_overlap_score": (interval_overlap_score, f"WITH {_SIDES} SELECT user_id, a, b, round(least(1.0, shared / greatest(1.0, b1 - b0)), 4) AS score FROM pairs"),
    "argmax_overlap": (argmax_overlap, f"WITH {_SIDES} SELECT user_id, a, b, round(shared, 3) AS shared FROM pairs WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY user_id, a ORDER BY shared DESC, b DESC) = 1"),
    "point_in_interval": (point_in_interval, f"""
WITH {SPANS} SELECT p.user_id, p.event_id AS a, coalesce(min(e.event_id), -1) AS b FROM spans p LEFT JOIN spans e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.t0 <= p.t0 AND p.t0 < e.t0 + 7200
WHERE p.event_type = 'purchase' GROUP BY ALL"""),
    "as_of_value": (as_of_value, f"""
WITH {SPANS}, facts AS (SELECT user_id, t0, max(value) AS value FROM spans WHERE event_type = 'view' GROUP BY ALL)
SELECT p.user_id, p.event_id AS a, f.value FROM spans p ASOF LEFT JOIN facts f ON p.user_id = f.user_id AND p.t0 >= f.t0 WHERE p.event_type = 'purchase'"""),
    "iou_hit_at_k": (iou_hit_at_k, f"""
WITH {_SIDES}, ranked AS (
  SELECT a AS qid, row_number() OVER (PARTITION BY a ORDER BY b) AS rank, b0, b1, a0 AS g0, a0 + 1200 AS g1 FROM pairs),
cells AS (SELECT *, b0 < g1 AND b1 > g0 AS meets, greatest(0, least(b1, g1) - greatest(b0, g0)) AS shared FROM ranked)
SELECT qid, max((meets AND rank <= 1)::BIGINT) AS hit_1, max((meets AND rank <= 3)::BIGINT) AS hit_3, max((meets AND rank <= 8)::BIGINT) AS hit_8,
       round(max(CASE WHEN rank <= 8 THEN shared / ((b1 - b0) + (g1 - g0) - shared) ELSE 0 END), 6) AS best_iou FROM cells GROUP BY qid"""),
    "locator_semi": (locator_semi, f"WITH {_GOLD} SELECT qid, doc_id FROM hits WHERE hit"),
    "locator_anti": (locator_anti, f"WITH {_GOLD} SELECT qid, doc_id FROM hits WHERE NOT hit"),
    "gold_coverage": (gold_coverage, f"""
WITH {_GOLD} SELECT qid, count(*) FILTER (WHERE hit) AS found, count(*) FILTER (WHERE NOT hit) AS missed,
  CASE WHEN bool_and(hit) THEN 'yes' WHEN bool_or(hit) THEN 'partial' ELSE 'no' END AS covered FROM hits GROUP BY qid"""),
    "consecutive_runs": (consecutive_runs, """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events),
m AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, kind, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY user_id, run, kind"""),
    "lag_intervals": (lag_intervals, f"""
WITH {SPANS} SELECT event_id, round(coalesce(lag(t0) OVER w, greatest(0, t0 - 3)), 3) AS start, round(coalesce(lead(t0) OVER w, t0 + 5), 3) AS "end" FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY t0)"""),
    "trailing_60s_rate": (trailing_60s_rate, """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS t, round(value, 0)::BIGINT AS amount FROM events)
SELECT event_id, count(*) OVER w AS requests, (sum(amount) OVER w)::BIGINT AS tokens FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)"""),
    "local_argmin_bucket": (local_argmin_bucket, """
WITH e AS (SELECT user_id, (epoch_us(ts) // 1000000 - 1704067200)::DOUBLE AS t, value AS level FROM events),
targets AS (SELECT user_id, floor(avg(t) / 3600) * 3600.0 AS target FROM e GROUP BY user_id),
means AS (SELECT user_id, floor(t / 3600) * 3600 AS spot, avg(level) AS level FROM e GROUP BY ALL),
near AS (SELECT user_id, target, spot FROM targets JOIN means USING (user_id) WHERE abs(spot - target) <= 86400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY level, spot) = 1)
SELECT t.user_id, t.target, coalesce(n.spot, t.target) AS "offset" FROM targets t LEFT JOIN near n USING (user_id)"""),
    "fixed_span_pack": (fixed_span_pack, None),
    "greedy_pack": (greedy_pack, None),
    "slide_changes": (slide_changes, None),
}
