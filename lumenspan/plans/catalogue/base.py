"""What the catalogue's queries share: how tables become units, edges and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...operators import ranking, units
from ...sources import scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return units.chunked(table(spark, sf, "documents"))


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of documents with their tokens, as a table: cut and tokenised once for all passes."""
    u = chunks(spark, sf)
    return scratch.stored(u.select("pos", "id", ranking.T.tokens(F.col("content")).alias("tokens")), "windows")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's passages as questions, with vectors of the hash encoder."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return q.join(ranking.hash_bag(q, "qid", "text"), "qid")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts as a graph of typed, scored links."""
    kind = F.when(F.col("l_returnflag") == "A", "audio_slide").when(F.col("l_returnflag") == "N", "figure_text").otherwise("deictic")
    rows = table(spark, sf, "lineitem")
    return rows.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst_id"), kind.alias("link_type"), F.round(0.5 + F.col("l_discount"), 2).alias("score"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.lit("audio").alias("modality"), F.col("o_orderpriority").alias("source_file"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.lit("figure").alias("modality"), F.col("p_brand").alias("source_file"))
    return o.unionByName(p)


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Of every twentieth customer the orders as seeds, by price."""
    o = table(spark, sf, "orders").where("o_custkey % 20 = 0")
    return o.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_totalprice").alias("score"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as spans of seconds up to the next."""
    e = table(spark, sf, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", "event_type", "value", F.round(t, 3).alias("t0"), F.round(F.coalesce(F.lead(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)")).over(w) / 1e6, t + 60), 3).alias("t1"))


def pools(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in pools of twenty, with a modality by label and a score by a coordinate."""
    e = table(spark, sf, "embeddings")
    modality = F.element_at(F.array(*map(F.lit, ("text", "figure", "audio", "table"))), (F.col("label") % 4 + 1).cast("int"))
    return e.select(F.floor(F.col("vec_id") / 20).alias("qid"), F.concat(F.lit("u"), F.col("vec_id")).alias("id"), (F.col("vec_id") % 20).alias("nth"), modality.alias("modality"), F.round(0.5 + F.col("embedding")[0].cast("double"), 6).alias("score"), "embedding")


def matrix(spark: SparkSession, sf: str, slides: int = 12) -> DataFrame:
    """A matrix for each label: its vectors as segments, their first coordinates as similarities to slides."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("pair"), F.col("vec_id").alias("i"), F.posexplode(F.slice("embedding", 1, slides)).alias("j", "s")).select("pair", "i", F.col("j").cast("long").alias("j"), F.round(F.col("s").cast("double"), 6).alias("s"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as units of four kinds, every third one's file a deck; recordings have times, the others pages."""
    d = F.col("doc_id")
    audio = d % 4 == 3
    kind = F.element_at(F.array(*map(F.lit, ("text", "figure", "table", "audio"))), (d % 4 + 1).cast("int"))
    where = units.location(page=F.when(~audio, d % 50), start_s=F.when(audio, d * 1.25), end_s=F.when(audio, d * 1.25 + 10))
    return table(spark, sf, "documents").select(
        d.alias("pos"), F.concat_ws(":", "source", d.cast("string")).alias("id"), kind.alias("modality"), F.col("text").alias("content"),
        F.concat(F.lit("in/"), "source", F.when(audio, ".mp3").otherwise(".pdf")).alias("source_file"), where.alias("location"), (d % 3 == 0).alias("deck"), "lang",
    )


def in_turn(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, lang, item_id, passage): each document with one passage of the benchmark, which are taken in turn."""
    items = table(spark, sf, "benchmark")
    number = F.row_number().over(Window.orderBy("item_id")) - 1
    placed = items.select("item_id", F.col("text").alias("passage"), number.alias("_n"))
    docs = table(spark, sf, "documents").crossJoin(F.broadcast(items.agg(F.count("*").alias("_of"))))
    return docs.withColumn("_n", F.col("doc_id") % F.col("_of")).join(F.broadcast(placed), "_n").select("doc_id", "text", "lang", "item_id", "passage")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of documents as blocks of a page in two columns: every seventh an image, every fifth with a caption's beginning."""
    n = F.col("nth")
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    x, y = (n % 2) * 300.0, n * 60.0
    text = F.when(n % 5 == 4, F.concat(F.lit("Figure "), (n % 12).cast("string"), F.lit(": "), "line")).otherwise(F.col("line"))
    return lines.select("page", n.cast("long").alias("nth"), F.when(n % 7 == 6, 1).otherwise(0).alias("kind"), F.array(x, y, x + 280.0, y + 45.0).alias("box"), text.alias("text"))


# -- the same in SQL ----------------------------------------------------------

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

CHUNKS = r"""
worded AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, source, w, unnest(range(0, greatest(len(w), 1)::BIGINT, 180)) AS s FROM worded WHERE len(w) > 0),
windows AS (SELECT doc_id, source, s, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk, list_slice(w, s + 1, s + 225) AS w FROM placed WHERE s = 0 OR len(w) - s > 45),
units AS (
  SELECT doc_id * 1048576 + chunk AS pos, source || ':p' || doc_id || ':t' || chunk AS id, array_to_string(w, ' ') AS content, source AS source_file, doc_id AS page FROM windows)
"""

EDGES = """
edges AS (
  SELECT 'o' || l_orderkey AS src_id, 'p' || l_partkey AS dst_id,
         CASE l_returnflag WHEN 'A' THEN 'audio_slide' WHEN 'N' THEN 'figure_text' ELSE 'deictic' END AS link_type, round(0.5 + l_discount, 2) AS score FROM lineitem),
sides AS (SELECT src_id AS id, dst_id AS neighbour, link_type, score FROM edges UNION ALL SELECT dst_id, src_id, link_type, score FROM edges),
best AS (SELECT id, neighbour, link_type, max(score) AS score FROM sides GROUP BY ALL)
"""

SPANS = """
spans AS (
  SELECT event_id, user_id, event_type, value, round(epoch_us(ts) / 1e6, 3) AS t0,
         round(coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6, epoch_us(ts) / 1e6 + 60), 3) AS t1 FROM events)
"""

POOLS = """
pools AS (
  SELECT floor(vec_id / 20)::BIGINT AS qid, 'u' || vec_id AS id, vec_id % 20 AS nth, ['text', 'figure', 'audio', 'table'][label % 4 + 1] AS modality,
         round(0.5 + embedding[1]::DOUBLE, 6) AS score, embedding FROM embeddings)
"""

MATRIX = """
matrix AS (
  SELECT label AS pair, vec_id AS i, unnest(range(0, 12)) AS j, round(unnest(embedding[1:12])::DOUBLE, 6) AS s FROM embeddings)
"""

CORPUS = """
corpus AS (
  SELECT doc_id AS pos, source || ':' || doc_id AS id, ['text', 'figure', 'table', 'audio'][doc_id % 4 + 1] AS modality, text AS content, lang,
         source || CASE WHEN doc_id % 4 = 3 THEN '.mp3' ELSE '.pdf' END AS file, CASE WHEN doc_id % 4 <> 3 THEN doc_id % 50 END AS page,
         CASE WHEN doc_id % 4 = 3 THEN (doc_id * 1.25)::DOUBLE END AS start_s, CASE WHEN doc_id % 4 = 3 THEN (doc_id * 1.25 + 10)::DOUBLE END AS end_s, doc_id % 3 = 0 AS deck FROM documents)
"""

IN_TURN = """
placed AS (SELECT item_id, text AS passage, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS m FROM benchmark),
in_turn AS (SELECT doc_id, d.text, lang, item_id, passage FROM documents d JOIN placed ON d.doc_id % m = n)
"""

BLOCKS = r"""
cut AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
blocks AS (
  SELECT page, nth, CASE WHEN nth % 7 = 6 THEN 1 ELSE 0 END AS kind, (nth % 2) * 300.0::DOUBLE AS x0, nth * 60.0::DOUBLE AS y0, (nth % 2) * 300.0::DOUBLE + 280 AS x1, nth * 60.0::DOUBLE + 45 AS y1,
         CASE WHEN nth % 5 = 4 THEN 'Figure ' || nth % 12 || ': ' || line ELSE line END AS text FROM cut)
"""


def clock(seconds: str, how: str = "round_even({}, 0)") -> str:
    """m:ss of seconds in SQL."""
    whole = how.format(seconds) + "::BIGINT"
    return f"(({whole}) // 60) || ':' || lpad((({whole}) % 60)::VARCHAR, 2, '0')"
