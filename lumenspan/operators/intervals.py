"""Joins on time: overlapping spans, points in spans, gold places.

Spark plans a bare overlap predicate as a nested loop over all pairs. Here both sides
are dealt into bins of the time axis and joined on equal bins; the predicate is checked
on those pairs only, and of the bins that a pair shares the first alone gives the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions.text import file_name


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: float, closed: bool = False) -> DataFrame:
    """Pairs of left(by..., a, a0, a1, ...) and right(by..., b, b0, b1, ...) of one group whose spans overlap.

    width is about the length of a usual span: a span is dealt to as many bins as it
    has widths. Spans with a missing end join nothing.
    """
    x = left.where("a0 IS NOT NULL AND a1 IS NOT NULL").withColumn("_bin", _bins(F.col("a0"), F.col("a1"), width))
    y = right.where("b0 IS NOT NULL AND b1 IS NOT NULL").withColumn("_bin", _bins(F.col("b0"), F.col("b1"), width))
    test = P.overlaps_closed if closed else P.overlaps_strictly
    first = F.floor(F.greatest("a0", "b0") / width) == F.col("_bin")
    return x.join(y, [*by, "_bin"]).where(first & test(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))).drop("_bin")


def point_join(points: DataFrame, spans: DataFrame, by: list[str], width: float) -> DataFrame:
    """points(by..., a, t) with the first span b (by index) with b0 <= t < b1, null where there is none."""
    x = points.withColumn("_bin", F.floor(F.col("t") / width))
    y = spans.withColumn("_bin", _bins(F.col("b0"), F.col("b1"), width)).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [x[c] == y[f"_{c}"] for c in by]
    joined = x.join(y, [*same, x["_bin"] == y["_bin"], P.inside(x["t"], y["b0"], y["b1"])], "left")
    return joined.groupBy(*by, "a", "t").agg(F.min("b").alias("b"))


def greatest_overlap(left: DataFrame, right: DataFrame, by: list[str], width: float, later: bool = True) -> DataFrame:
    """(by..., a, b, shared): for each left span the right one that it shares most time with; of equals the later or earlier."""
    pairs = overlap_join(left, right, by, width).withColumn("shared", P.overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))).where("shared > 0")
    order = F.struct("shared", F.col("b") if later else -F.col("b"))
    return pairs.groupBy(*by, "a").agg(F.max(order).alias("m")).select(*by, "a", (F.col("m")["b"] if later else -F.col("m")["col2"]).alias("b"), F.col("m.shared").alias("shared"))


def gold_pairs(units: DataFrame, places: DataFrame, width: float = 30.0) -> DataFrame:
    """(qid, place, id): units(id, source_file, location) at gold places(qid, place: struct<source, page, start_s, end_s>).

    Joined on the file and the page, or, where a place has no page, on the file and bins of time.
    """
    at, wanted = F.col("location"), F.col("place")
    u = units.select("id", "location", file_name(F.col("source_file")).alias("_file"))
    g = places.select("qid", "place", file_name(wanted["source"]).alias("_file"))
    paged = u.withColumn("_page", at["page"]).join(g.where(wanted["page"].isNotNull()).withColumn("_page", wanted["page"]), ["_file", "_page"])
    spans = u.select("_file", F.col("id").alias("a"), at["start_s"].alias("a0"), at["end_s"].alias("a1"))
    asked = g.where(wanted["page"].isNull()).select("_file", F.struct("qid", "place").alias("b"), wanted["start_s"].alias("b0"), wanted["end_s"].alias("b1"))
    timed = overlap_join(spans, asked, ["_file"], width)
    return paged.select("qid", "place", "id").unionByName(timed.select("b.qid", "b.place", F.col("a").alias("id")))


def gold_hits(retrieved: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missed) gold places of each question, by its retrieved units(qid, source_file, location).

    Pages are met by an equal join with the distinct ones. A place in time is met if, of
    the question's units in its file that begin before its end, one ends after its
    begin: the greatest end so far in the order of times tells, and no pairs are made.
    """
    at, wanted = F.col("location"), F.col("place")
    r = retrieved.select(F.col("qid").alias("_qid"), file_name(F.col("source_file")).alias("_rfile"), at["page"].alias("_page"), at["start_s"].alias("_t"), at["end_s"].alias("_end")).where("_qid IS NOT NULL AND _rfile IS NOT NULL")
    g = places.withColumn("_gfile", file_name(wanted["source"]))
    pages = r.select("_qid", "_rfile", "_page").distinct().withColumn("_hit", F.lit(True))
    same = (F.col("_qid") == F.col("qid")) & (F.col("_rfile") == F.col("_gfile")) & (F.col("_page") == wanted["page"])
    paged = g.where(wanted["page"].isNotNull()).join(pages, same, "left").select(*places.columns, F.coalesce("_hit", F.lit(False)).alias("_hit"))
    asked = g.where(wanted["page"].isNull()).select(F.col("qid").alias("_qid"), F.col("_gfile").alias("_rfile"), wanted["end_s"].alias("_t"), F.struct(*places.columns).alias("_row"))
    met = asked.withColumn("_kind", F.lit(0)).unionByName(r.where("_t IS NOT NULL AND _end IS NOT NULL").drop("_page").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("_qid", "_rfile").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = met.withColumn("_last", F.max("_end").over(before)).where("_kind = 0").select("_row.*", F.col("_t").isNotNull().alias("_timed"), "_last")
    timed = ends.select(*places.columns, F.coalesce(F.col("_timed") & (F.col("_last") > wanted["start_s"]), F.lit(False)).alias("_hit"))
    told = paged.unionByName(timed)
    return told.where("_hit").drop("_hit"), told.where("NOT _hit").drop("_hit")


def coverage(found: DataFrame, missed: DataFrame) -> DataFrame:
    """(qid, found, missed, covered): yes, partial or no, as a question's places were found."""
    counts = found.select("qid", F.lit(1).alias("hit")).unionByName(missed.select("qid", F.lit(0).alias("hit"))).groupBy("qid").agg(F.sum("hit").alias("found"), F.sum(1 - F.col("hit")).alias("missed"))
    return counts.withColumn("covered", F.when(F.col("missed") == 0, "yes").when(F.col("found") > 0, "partial").otherwise("no"))


def as_of(points: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """points(by..., a, t) with the value of the latest of facts(by..., t, value) not after t: one union and one window."""
    rows = points.select(*by, "t", F.col("a"), F.lit(None).cast(facts.schema["value"].dataType).alias("value"), F.lit(1).alias("_kind"))
    marks = facts.select(*by, "t", F.lit(None).cast(points.schema["a"].dataType).alias("a"), "value", F.lit(0).alias("_kind"))
    before = Window.partitionBy(*by).orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(marks).withColumn("value", F.last("value", ignorenulls=True).over(before)).where("_kind = 1").drop("_kind")


def trailing(rows: DataFrame, by: list[str], seconds: float, t: str = "t", amount: str = "amount") -> DataFrame:
    """rows with how many rows, and how much, the last seconds before and with each hold."""
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-seconds, 0)
    return rows.withColumn("requests", F.count("*").over(w)).withColumn("total", F.sum(amount).over(w))
