"""Accounts: costs, budgets, caches, manifests, ids, batches."""

from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import ledger, segments, units
from .base import table

PRICES = [("pro", 2.0, 8.0, 0.0), ("prom", 1.0, 4.0, 0.0), ("view", 0.5, 1.5, 0.0), ("click", 0.1, 0.2, 0.006), ("err", 0.0, 0.0, 0.0)]
_PRICES = "prices(prefix, i, o, m) AS (VALUES ('pro', 2.0::DOUBLE, 8.0::DOUBLE, 0.0::DOUBLE), ('prom', 1.0, 4.0, 0.0), ('view', 0.5, 1.5, 0.0), ('click', 0.1, 0.2, 0.006), ('err', 0.0, 0.0, 0.0))"


def _prices(spark):
    rows = spark.createDataFrame(PRICES, "prefix string, input double, output double, per_minute double")
    return rows.select("prefix", F.struct("input", "output", "per_minute").alias("price"))


def _usage(spark, sf):
    e = table(spark, sf, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    model = F.when(F.col("event_type") == "purchase", "promo-1").otherwise(F.col("event_type"))
    used = e.select("event_id", "user_id", model.alias("model"), (F.col("event_id") % 5000).alias("prompt_tokens"), (n * 10).alias("completion_tokens"), (F.col("event_id") % 7).alias("cached_prompt_tokens"), F.lit(0).alias("cached_completion_tokens"), (F.col("event_id") % 90).alias("audio_seconds"))
    priced = ledger.price_for(used, _prices(spark))
    c = lambda x: F.col(x)
    return priced.withColumn("cost", ledger.cost(c("price"), c("prompt_tokens"), c("completion_tokens"), c("cached_prompt_tokens"), c("cached_completion_tokens"), c("audio_seconds")))


_USAGE = f"""
{_PRICES},
used AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'promo-1' ELSE event_type END AS model, event_id % 5000 AS p, json_extract(props, '$.k')::BIGINT * 10 AS c, event_id % 7 AS cp, event_id % 90 AS s FROM events),
usage AS (
  SELECT u.*, (SELECT struct_pack(prefix, i, o, m) FROM prices WHERE starts_with(u.model, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS price FROM used u),
costed AS (SELECT *, CASE WHEN price IS NOT NULL THEN ((p - cp) * price.i + c * price.o) / 1e6 + s / 60 * price.m END AS cost FROM usage)
"""


def price_prefix_match(spark, sf):
    return _usage(spark, sf).select("event_id", "model", F.col("price.input").alias("input"))


def ledger_cost(spark, sf):
    return _usage(spark, sf).select("event_id", F.round("cost", 9).alias("cost"))


def cumulative_spend(spark, sf):
    b = ledger.budget(_usage(spark, sf), ["user_id"], "event_id", 0.05)
    return b.select("event_id", F.round("spent", 9).alias("spent"))


def unpriced_rows(spark, sf):
    t = ledger.totals(_usage(spark, sf), ["model"])
    return t.select("model", "prompt_tokens", F.round("cost", 7).alias("cost"), "unpriced")


def reply_cache(spark, sf):
    """Calls of a system and a user text, those already answered, and the queue of the others."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("user"))
    calls = ledger.numbered_slots(e, "event_id")
    replies = calls.where("event_id % 3 = 0").select("slot", "nth", F.col("event_id").cast("string").alias("reply"))
    answered, queue = ledger.cached(calls, replies)
    return answered.select("system", F.lit("answered").alias("state")).unionByName(queue.select("system", F.lit("queued").alias("state"))).groupBy("system", "state").agg(F.count("*").alias("n"))


def prompt_slots(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("user"))
    return ledger.numbered_slots(e, "event_id").select("event_id", "slot", F.col("nth").cast("long").alias("nth"))


def manifest_counts(spark, sf):
    docs = table(spark, sf, "documents")
    u = docs.select(F.col("source").alias("source_file"), F.col("lang").alias("modality"))
    files = docs.groupBy(F.col("source").alias("name")).agg(F.encode(F.min("text"), "UTF-8").alias("content"))
    m = ledger.manifest(u, files)
    return m.select("name", "bytes", "sha256", F.explode("units").alias("modality", "n"))


def dup_id_suffix(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.lit(":"), "lang").alias("id"))
    return units.suffixed_ids(docs).select("pos", "id")


def content_hash(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.sha2("html", 256).alias("sha256"), ledger.stem(F.sha2("html", 256), F.lit("small"), 60).alias("stem"))


def file_summary(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_file"), units.location(page=F.col("doc_id")).alias("location"))
    return units.file_summary(docs).select("source_file", "units", F.col("pages").cast("long").alias("pages"))


def exclusive_terms(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("text").alias("content"), "lang")
    return units.exclusive_terms(docs, F.col("lang")).select("term", "role", "n")


def prompt_batches(spark, sf):
    """Prompts by model, first fit into batches of 20,000 characters and 10 items; a longer prompt is a batch of its own."""
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    b = segments.first_fit(docs, "lang", "doc_id", "n_chars", 20_000, 10)
    return b.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def host_pairs(spark, sf):
    """Unordered pairs of hosts that link to pages of one number."""
    p = table(spark, sf, "pages").select((F.col("page_id") % 50).alias("k"), T.host(F.col("url")).alias("h")).distinct()
    q = p.withColumnRenamed("h", "g")
    pair = T.pair_key(F.col("h"), F.col("g"))
    return p.join(q, "k").where("h < g").select(pair["a"].alias("a"), pair["b"].alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


QUERIES = {
    "price_prefix_match": (price_prefix_match, f"WITH {_USAGE} SELECT event_id, model, price.i::DOUBLE AS input FROM usage"),
    "ledger_cost": (ledger_cost, f"WITH {_USAGE} SELECT event_id, round(cost::DOUBLE, 9) AS cost FROM costed"),
    "cumulative_spend": (cumulative_spend, f"WITH {_USAGE} SELECT event_id, round(sum(coalesce(cost, 0)::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS spent FROM costed"),
    "unpriced_rows": (unpriced_rows, f"WITH {_USAGE} SELECT model, sum(p)::BIGINT AS prompt_tokens, round(coalesce(sum(cost::DOUBLE), 0), 7) AS cost, count(*) FILTER (WHERE cost IS NULL) AS unpriced FROM costed GROUP BY model"),
    "reply_cache": (reply_cache, "SELECT event_type AS system, CASE WHEN event_id % 3 = 0 THEN 'answered' ELSE 'queued' END AS state, count(*) AS n FROM events GROUP BY ALL"),
    "prompt_slots": (prompt_slots, "SELECT event_id, sha256(event_type || chr(0) || user_id) AS slot, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS nth FROM events"),
    "manifest_counts": (manifest_counts, """
WITH f AS (SELECT source AS name, min(text) AS t FROM documents GROUP BY source)
SELECT name, octet_length(encode(t)) AS bytes, sha256(t) AS sha256, lang AS modality, count(*) AS n FROM documents JOIN f ON name = source GROUP BY ALL"""),
    "dup_id_suffix": (dup_id_suffix, """
WITH r AS (SELECT doc_id, source || ':' || lang AS id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
SELECT doc_id AS pos, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM r"""),
    "content_hash": (content_hash, "SELECT page_id, sha256(html) AS sha256, substr(sha256(html), 1, 24) || '-small-60' AS stem FROM pages"),
    "file_summary": (file_summary, "SELECT source AS source_file, count(*) AS units, max(doc_id) AS pages FROM documents GROUP BY source"),
    "exclusive_terms": (exclusive_terms, r"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, any_value(lang) AS role, count(*) AS n FROM t WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY term HAVING count(DISTINCT lang) = 1"""),
    "prompt_batches": (prompt_batches, None),
    "host_pairs": (host_pairs, r"""
WITH p AS (SELECT DISTINCT page_id % 50 AS k, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1) AS h FROM pages)
SELECT x.h AS a, y.h AS b, count(*) AS n FROM p x JOIN p y USING (k) WHERE x.h < y.h GROUP BY ALL"""),
}
