"""Writers: DataFrames to tables, JSON lines with a stamp, CSV, GraphML and Markdown reports."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(units: DataFrame, path: str, meta: dict | None = None) -> None:
    """Units with their vectors as one Parquet table, and what is known of it beside."""
    units.write.mode("overwrite").parquet(f"{path}/units")
    stamp(units, f"{path}/meta", meta or {})


def stamp(df: DataFrame, path: str, meta: dict) -> None:
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def links(rows: DataFrame, path: str, manifest_hash: str | None = None) -> None:
    """Links as JSON lines with scores of six decimals, and a line with the manifest's hash."""
    spark = rows.sparkSession
    out = rows.withColumn("score", F.round("score", 6)).select(F.to_json(F.struct(*rows.columns)).alias("value"))
    head = spark.createDataFrame([(json.dumps({"_meta": {"manifest_hash": manifest_hash}}),)], "value string")
    head.unionByName(out).write.mode("overwrite").text(path)


def pairs_csv(pairs: DataFrame, units: DataFrame, path: str) -> None:
    """Pointing pairs with the places of both ends, in a fixed order of columns; an unknown end is blank."""
    side = lambda n, p: units.select(F.col("id").alias(n), *(F.col(f"location.{c}").alias(f"{p}_{c}") for c in ("page", "start_s", "end_s")))
    rows = pairs.join(side("src_id", "segment"), "src_id", "left").join(side("dst_id", "figure"), "dst_id", "left")
    cells = ("src_id", "segment_start_s", "segment_end_s", "cue", "tier", "cues", "dst_id", "figure_page", "score")
    rows.select(*cells).orderBy(F.desc("score"), "src_id").write.mode("overwrite").option("header", True).csv(path)


def ledger(rows: DataFrame, path: str) -> None:
    """Rows of use, appended."""
    rows.write.mode("append").json(path)


def replies(rows: DataFrame, path: str) -> None:
    """Stored replies, in a folder for each cache; a cache that is written again is replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_dir").parquet(path)


def batches(rows: DataFrame, path: str) -> None:
    """Prompt batches, a folder for each; shared contexts are a table of their own."""
    rows.select("batch", "slot", "question", F.sha2("context", 256).alias("context_key")).write.mode("overwrite").partitionBy("batch").json(f"{path}/prompts")
    rows.select(F.sha2("context", 256).alias("context_key"), "context").distinct().write.mode("overwrite").json(f"{path}/contexts")


def imported(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(slot, reply, state) of asked(slot): stored, missing, refused or pending, by answers(slot, reply)."""
    state = F.when(F.col("reply").isNull(), "missing").when(F.trim("reply") == "", "refused").when(F.trim("reply") == "PENDING", "pending").otherwise("stored")
    return asked.join(answers, "slot", "left").withColumn("state", state)


def graphml(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of GraphML, one row each: nodes, then edges; nested attributes as JSON. Small graphs can be collected and joined."""
    attribute = lambda c, kind: F.to_json(F.col(c)) if kind.startswith(("struct", "array", "map")) else F.col(c).cast("string")

    def lines(df: DataFrame, head) -> DataFrame:
        cells = [F.concat(F.lit(f"<data key={quoteattr(c)}>"), _escaped(attribute(c, kind)), F.lit("</data>")) for c, kind in df.dtypes if c not in ("id", "src_id", "dst_id")]
        return df.select(F.concat(head, F.concat_ws("", *cells)).alias("value"))

    nodes = lines(units, F.concat(F.lit('<node id="'), _escaped(F.col("id")), F.lit('">'))).select(F.concat("value", F.lit("</node>")).alias("value"), F.lit(0).alias("part"))
    links_ = lines(edges, F.concat(F.lit('<edge source="'), _escaped(F.col("src_id")), F.lit('" target="'), _escaped(F.col("dst_id")), F.lit('">'))).select(F.concat("value", F.lit("</edge>")).alias("value"), F.lit(1).alias("part"))
    return nodes.unionByName(links_)


def _escaped(c):
    for raw in "&<>":
        c = F.replace(c, F.lit(raw), F.lit(escape(raw)))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small report table as Markdown."""
    head, body = rows.columns, rows.limit(limit).collect()
    lines = [f"# {title}", "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}"]
    return "\n".join([*lines, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in body)]) + "\n"


def json_lines(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """Rows as JSON lines, with what is known of them in a _meta line where it is given: gold questions, verdicts, gates."""
    out = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    if meta is not None:
        out = rows.sparkSession.createDataFrame([(json.dumps({"_meta": meta}, sort_keys=True),)], "value string").unionByName(out)
    out.write.mode("overwrite").text(path)


def transcripts(words: DataFrame, path: str) -> None:
    """words(source_file, nth, start, end, text) as one {audio, words} object for each recording."""
    cell = F.array(F.col("start").cast("string"), F.col("end").cast("string"), F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", cell.alias("w")))), lambda x: x["w"])
    words.groupBy(F.col("source_file").alias("audio")).agg(listed.alias("words")).write.mode("overwrite").json(path)


def manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
