"""Texts: terms, windows, sentences, references, times, replies."""

from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import evidence, links, ranking, segments, units
from ...sources import readers
from .base import CHUNKS, TOKENS, chunks, table


def tokenize_stats(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def df_idf(spark, sf):
    return ranking.smoothed_idf(table(spark, sf, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


def rare_term_overlap(spark, sf):
    """Of each benchmark passage the five documents that share most of its idf mass."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return ranking.overlap_top_k(docs, items, 5).withColumn("rank", F.col("rank").cast("long"))


def chunk_windows(spark, sf):
    return chunks(spark, sf).select("pos", "id", "source_file", F.col("location.page").cast("long").alias("page"), F.md5("content").alias("content_md5"))


def sentence_split_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    u = docs.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "lang")
    return units.role_sentences(u, F.col("lang")).select("role", F.md5("sentence").alias("sentence_md5"), "id")


def sentence_islands(spark, sf):
    words = readers.spoken(table(spark, sf, "conversations"))
    return segments.sentences_of_words(words, ["by"]).select("by", F.col("sentence").cast("long").alias("sentence"), "start", "end", "n", F.md5("text").alias("text_md5"))


def _referring(spark, sf):
    d = F.col("doc_id").cast("string")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    text = F.concat(F.lit("As Figure "), n(15), F.lit(" and Tab. "), n(7), F.lit(" show, see the diagram "), F.when(F.col("doc_id") % 2 == 0, "below").otherwise("on the left"), F.lit("; fig "), n(120), F.lit(" no. "), d)
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


_REFERRING = """
referring AS (
  SELECT doc_id, 'As Figure ' || doc_id % 15 || ' and Tab. ' || doc_id % 7 || ' show, see the diagram ' || CASE WHEN doc_id % 2 = 0 THEN 'below' ELSE 'on the left' END || '; fig ' || doc_id % 120 || ' no. ' || doc_id AS text FROM documents)
"""


def numbered_refs(spark, sf):
    t = F.col("text")
    return _referring(spark, sf).select("doc_id", T.figure_number(t).cast("long").alias("number"), T.figure_kind(t).alias("kind"), F.array_join(T.referenced(t), ",").alias("refs"))


def descriptive_refs(spark, sf):
    return _referring(spark, sf).select("doc_id", F.explode(T.descriptive_refs(F.col("text"))).alias("r")).select("doc_id", "r.noun", "r.direction")


def deictic_cue_tiers(spark, sf):
    """Pointing words in what is said in conversations."""
    words = readers.spoken(table(spark, sf, "conversations"))
    u = words.groupBy(F.col("by").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "start", "end", "text"))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"))).alias("words"))
    return links.cues(u).select("id", F.col("nth").cast("long").alias("nth"), "cue", "start_s", "end_s", "tier", F.md5("context").alias("context_md5"), F.md5("sentence").alias("sentence_md5"))


def html_text_units(spark, sf):
    u = readers.page_units(table(spark, sf, "pages"))
    return u.select("pos", "id", "source_file", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


def timestamp_parse(spark, sf):
    e = table(spark, sf, "events")
    k = lambda n: (F.col("event_id") % n).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(k(30), F.lit(":"), k(75), F.lit(":"), k(65))).when(F.col("event_id") % 4 == 1, F.concat(k(90), F.lit(":"), k(70))).when(F.col("event_id") % 4 == 2, k(500)).otherwise(F.concat(F.lit("at "), k(9)))
    s = F.col("value") * 100
    return e.select("event_id", T.strict_seconds(text).alias("seconds"), T.mmss(s).alias("rounded"), T.mmss_floor(s).alias("floored"))


def json_claims_parse(spark, sf):
    e = table(spark, sf, "events")
    reply = F.concat(F.lit('Sure. {"answer": "'), F.col("event_type"), F.lit('", "claims": [{"text": "t'), F.col("event_id").cast("string"), F.lit('", "units": ["a", "b"]}, {"text": " ", "units": []}]} done'))
    return e.select("event_id", T.answer_claims(reply).alias("a"), F.get_json_object("props", "$.k").cast("long").alias("k")).select("event_id", "a.answer", F.size("a.claims").cast("long").alias("n_claims"), F.get("a.claims", F.lit(0))["text"].alias("first_claim"), F.size(F.get("a.claims", F.lit(0))["units"]).cast("long").alias("n_units"), "k")


def text_scalars(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.excerpt(c).alias("excerpt"), T.normal(c).alias("normal"), T.estimated_tokens(F.col("text")).alias("tokens"),
        T.cost_text(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") / 1e4)).alias("cost"), T.file_name(F.concat(F.lit("a/b/"), F.col("source"))).alias("file"),
    )


def span_in_text(spark, sf):
    """All documents that hold a passage of the benchmark word for word, of all passages."""
    found = evidence.quoted_spans(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id")


_SENTENCES = r"""
cut AS (
  SELECT doc_id, lang, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s,
         generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS n FROM documents),
kept AS (SELECT doc_id, lang, n, trim(s, ' ') AS s FROM cut WHERE len(list_filter(regexp_split_to_array(trim(s, ' '), '\s+'), lambda x: x <> '')) >= 5)
"""
_TEXT = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g')"

QUERIES = {
    "tokenize_stats": (tokenize_stats, f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents"),
    "df_idf": (df_idf, f"""
WITH terms AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))), 6) AS idf FROM terms GROUP BY term"""),
    "rare_term_overlap": (rare_term_overlap, f"""
WITH terms AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM terms GROUP BY term),
asked AS (SELECT item_id, term, idf FROM (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark) JOIN idf USING (term)),
scored AS (
  SELECT item_id, doc_id, round(least(1.0, sum(idf) / any_value(mass)), 6) AS overlap
  FROM asked JOIN terms USING (term) JOIN (SELECT item_id, sum(idf) AS mass FROM asked GROUP BY item_id) USING (item_id) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM scored) WHERE rank <= 5"""),
    "chunk_windows": (chunk_windows, f"WITH {CHUNKS} SELECT pos, id, source_file, page, md5(content) AS content_md5 FROM units"),
    "sentence_split_dedup": (sentence_split_dedup, f"""
WITH {_SENTENCES}
SELECT lang AS role, md5(s) AS sentence_md5, doc_id::VARCHAR AS id FROM kept
QUALIFY row_number() OVER (PARTITION BY lang, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' ') ORDER BY doc_id, n) = 1"""),
    "sentence_islands": (sentence_islands, r"""
WITH turns AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS k FROM conversations),
words AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS nth FROM turns),
marked AS (SELECT *, coalesce(regexp_matches(lag(w) OVER (PARTITION BY conv_id ORDER BY nth), '[.!?]["'')\]]?$'), false) AS fresh FROM words),
islands AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS sentence FROM marked)
SELECT conv_id::VARCHAR AS "by", sentence::BIGINT AS sentence, min(nth) * 0.5::DOUBLE AS start, (max(nth) + 1) * 0.5::DOUBLE AS "end", count(*) AS n, md5(string_agg(w, ' ' ORDER BY nth)) AS text_md5
FROM islands GROUP BY conv_id, sentence"""),
    "numbered_refs": (numbered_refs, rf"""
WITH {_REFERRING}, hits AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(fig(?:ure)?|tab(?:le)?)\s*\.?\s*(\d{{1,2}})\b', 1)) AS k, unnest(regexp_extract_all(text, '(?i)\b(fig(?:ure)?|tab(?:le)?)\s*\.?\s*(\d{{1,2}})\b', 2)) AS n FROM referring)
SELECT doc_id, nullif(regexp_extract(any_value(r.text), '(?i)\b(fig(?:ure)?|tab(?:le)?)\s*\.?\s*(\d{{1,2}})\b', 2), '')::BIGINT AS number,
       CASE WHEN lower(regexp_extract(any_value(r.text), '(?i)\b(fig(?:ure)?|tab(?:le)?)\s*\.?\s*(\d{{1,2}})\b', 1)) LIKE 'tab%' THEN 'table' ELSE 'figure' END AS kind,
       array_to_string(list_sort(list_distinct(list(CASE WHEN lower(k) LIKE 'tab%' THEN 'table' ELSE 'figure' END || ' ' || n::INT))), ',') AS refs
FROM referring r JOIN hits USING (doc_id) GROUP BY doc_id"""),
    "descriptive_refs": (descriptive_refs, rf"""
WITH {_REFERRING}
SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.DESCRIPTIVE}', 1)) AS noun, unnest(regexp_extract_all(lower(text), '{T.DESCRIPTIVE}', 2)) AS direction FROM referring"""),
    "deictic_cue_tiers": (deictic_cue_tiers, None),
    "html_text_units": (html_text_units, rf"""
WITH plain AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_replace({_TEXT}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages),
u AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS content FROM plain)
SELECT page_id AS pos, 'page:' || page_id AS id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1) AS source_file, length(content) AS n_chars, md5(content) AS content_md5 FROM u"""),
    "timestamp_parse": (timestamp_parse, """
WITH x AS (
  SELECT event_id, value * 100 AS s, event_id % 4 AS k, event_id % 30 AS h, event_id % 75 AS m, event_id % 65 AS c, event_id % 90 AS mm, event_id % 70 AS ss FROM events)
SELECT event_id,
       CASE k WHEN 0 THEN CASE WHEN h < 24 AND m < 60 AND c < 60 THEN h * 3600 + m * 60 + c END WHEN 1 THEN CASE WHEN ss < 60 THEN mm * 60 + ss END WHEN 2 THEN event_id % 500 END::DOUBLE AS seconds,
       (round_even(s, 0)::BIGINT // 60) || ':' || lpad((round_even(s, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS rounded,
       (floor(s)::BIGINT // 60) || ':' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') AS floored FROM x"""),
    "json_claims_parse": (json_claims_parse, "SELECT event_id, event_type AS answer, 1::BIGINT AS n_claims, 't' || event_id AS first_claim, 2::BIGINT AS n_units, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "text_scalars": (text_scalars, r"""
WITH c AS (SELECT doc_id, text, source, text AS t FROM documents),
w AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS one FROM c)
SELECT doc_id, CASE WHEN length(one) <= 360 THEN one ELSE regexp_replace(substr(one, 1, 360), '\s\S*$', '') || '…' END AS excerpt,
       trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' ') AS normal, round_even(length(text) / 4, 0)::BIGINT AS tokens,
       CASE WHEN doc_id % 5 = 0 THEN 'price unknown' ELSE '$' || printf('%.4f', doc_id / 1e4) END AS cost, source AS file FROM w"""),
    "span_in_text": (span_in_text, """
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS t FROM benchmark)
SELECT doc_id, item_id FROM n JOIN p ON p.t <> '' AND contains(n.t, p.t)"""),
}
