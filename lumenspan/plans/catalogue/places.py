"""Units and where they are: their names, views, regions of pages, times near edges."""

from pyspark.sql import functions as F

from ...functions import places as P
from ...functions import text as T
from ...operators import intervals, regions, views
from ...operators import units as U
from .base import BLOCKS, CORPUS, EDGES, SPANS, blocks, clock, corpus, edges, nodes, spans, table

DECKS = ("src0.pdf", "src3.pdf")


def unit_places(spark, sf):
    """Every way to name a unit's place."""
    m, c, s, at = (F.col(x) for x in ("modality", "content", "source_file", "location"))
    place = T.locator_of(s, at)
    return corpus(spark, sf).select(
        "id", T.locator(s, at).alias("locator"), T.judge_place(s, at).alias("judge"), T.modality_tag(m, at).alias("tag"), T.cite(at).alias("cite"),
        F.md5(T.embed_text(m, F.when(F.col("pos") % 7 == 0, "").otherwise(c), s, at)).alias("embed_md5"), F.md5(T.rerank_text(m, at, c)).alias("rerank_md5"),
        place["source"].alias("source"), place["page"].cast("string").alias("page"), place["start_s"].alias("start_s"), T.describe_locator(place).alias("described"),
    )


def unit_roles(spark, sf):
    m, d, s = F.col("modality"), F.col("deck"), F.col("source_file")
    kind = F.element_at(F.array(*map(F.lit, T.LINK_TYPES)), (F.col("pos") % 4 + 1).cast("int"))
    value = F.when(F.col("pos") % 5 == 0, float("inf")).when(F.col("pos") % 5 == 1, float("nan")).otherwise(F.col("pos") / 7)
    phrase = F.when(F.col("pos") % 2 == 0, "this").otherwise("on the left side")
    return corpus(spark, sf).select(
        "id", T.role_of(m, d).alias("role"), T.material_kind(m, d).alias("kind"), T.source_of(m, s, DECKS).alias("source"), T.is_deck(F.when(F.col("pos") % 2 == 0, d)).alias("deck"),
        T.checked_link_type(kind).alias("link_type"), T.finite(value).alias("value"), F.round(T.cue_strength(phrase), 6).alias("strength"),
    )


def modality_mix(spark, sf):
    return views.modality_mix(corpus(spark, sf), "source_file")


def unit_views(spark, sf):
    return views.unit_view(corpus(spark, sf)).drop("bbox").withColumn("page", F.col("page").cast("string"))


def role_files(spark, sf):
    return views.files_by_role(corpus(spark, sf)).select("role", F.array_join("files", ",").alias("files"))


def topic_units(spark, sf):
    named = corpus(spark, sf).withColumn("source_file", F.concat(F.lit("x/"), "lang", F.lit("_"), T.file_name(F.col("source_file"))))
    return views.of_topic(named, "en").groupBy("source_file").agg(F.count("*").alias("n"))


def main_recording(spark, sf):
    return views.main_recording(corpus(spark, sf)).select("id", F.col("location.start_s").alias("start_s"))


def units_by_use(spark, sf):
    return views.by_use(corpus(spark, sf)).select("use", "id")


def reading_order(spark, sf):
    """Each file's units in reading order under their places."""
    c = U.full_context(corpus(spark, sf).withColumn("content", F.substring("content", 1, 20)), F.col("source_file"))
    return c.select("source", F.md5("context").alias("context_md5"))


def corpus_stats(spark, sf):
    return views.corpus_stats(edges(spark, sf), nodes(spark, sf).where(~F.col("id").rlike("^p.*7$")))


def page_titles(spark, sf):
    return regions.titles(regions.text_blocks(blocks(spark, sf)))


def image_captions(spark, sf):
    b = blocks(spark, sf)
    images = b.where("kind = 1").select("page", F.col("nth").alias("image"), "box")
    return regions.captions(images, regions.text_blocks(b)).select("page", "image", F.md5("caption").alias("caption_md5"))


def caption_regions(spark, sf):
    found = regions.captioned(regions.text_blocks(blocks(spark, sf)))
    return found.select("page", "nth", *(F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), F.md5("caption").alias("caption_md5"))


def _drawings(spark, sf):
    """Boxes at places that a digest of document and line names."""
    n = lambda a: F.conv(F.substring(F.md5(F.concat_ws(":", "page", "nth")), a, 3), 16, 10).cast("double")
    x, y = n(1) / 8, n(4) / 8
    return blocks(spark, sf).select("page", F.array(x, y, x + n(7) / 30, y + n(10) / 30).alias("box"))


def figure_regions(spark, sf):
    """Regions of drawings merged until none are near each other, with what becomes of them."""
    drawn = _drawings(spark, sf)
    pages = drawn.select("page").distinct().withColumns({"width": F.lit(700.0), "height": F.lit(700.0)})
    return regions.figures(drawn, pages).select("page", *(F.round(F.col("box")[i], 6).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), "kind")


def region_counts(spark, sf):
    drawn = _drawings(spark, sf)
    pages = drawn.select("page").distinct().withColumns({"width": F.lit(700.0), "height": F.lit(700.0)})
    return regions.region_counts(regions.figures(drawn, pages))


def box_geometry(spark, sf):
    """Boxes of neighbouring lines: white space between them, the box around them, nearness, logos."""
    b = blocks(spark, sf)
    two = b.select("page", "nth", F.col("box").alias("a")).join(b.select("page", (F.col("nth") - 1).alias("nth"), F.col("box").alias("b")), ["page", "nth"])
    u = P.box_union(F.array("a", "b"))
    return two.select("page", "nth", P.vertical_gap(F.col("a"), F.col("b")).alias("gap"), u[0].alias("x0"), u[3].alias("y1"), P.box_area(u).alias("area"), P.boxes_near(F.col("a"), F.col("b"), 20.0).alias("near"), P.is_logo(F.col("a"), F.lit(600.0), F.lit(900.0), 0.03, 0.3).alias("logo"))


def same_span_pages(spark, sf):
    s = spans(spark, sf).select("user_id", F.floor(F.col("t0") / 20000).alias("start"), F.floor(F.col("t1") / 20000).alias("end"), F.col("event_id").alias("page"))
    return views.same_spans(s, "user_id").select("user_id", "page", F.array_join("same", ",").alias("same"))


def boundary_flags(spark, sf):
    """Whether an event of a user lies within three seconds of either end of another's span, moved a little."""
    s = spans(spark, sf)
    segments = s.select("user_id", F.col("event_id").alias("a"), (F.col("t0") + F.col("event_id") % 9).alias("a0"), (F.col("t1") - F.col("event_id") % 7).alias("a1"))
    marks = s.select("user_id", F.col("t0").alias("t")).unionByName(s.select("user_id", F.col("t1").alias("t")))
    return views.near_edges(segments, marks, "user_id").select("user_id", "a", "near")


def gold_intervals(spark, sf):
    """A question's interval, or what is wrong with it."""
    e = F.col("event_id")
    start, end = F.when(e % 11 != 0, (e % 60).cast("double")), F.when(e % 13 != 0, (e % 47 + 10).cast("double"))
    g = P.gold_interval(start, end, F.lit(50.0))
    return table(spark, sf, "events").select("event_id", g["start_s"].alias("start_s"), g["end_s"].alias("end_s"), g["reason"].alias("reason"))


def gold_units(spark, sf):
    """Units at stated gold places: pages of files, or times."""
    u = corpus(spark, sf)
    places = u.where("pos % 10 = 1").select(F.col("pos").alias("qid"), F.struct(F.col("source_file").alias("source"), F.col("location.page").alias("page"), F.col("location.start_s").alias("start_s"), (F.col("location.start_s") + 40).alias("end_s")).alias("place"))
    return intervals.gold_pairs(u, places).select("qid", "id")


_PLACE = f"CASE WHEN page IS NOT NULL THEN file || ' p.' || page WHEN start_s IS NOT NULL THEN file || ' ' || {clock('start_s')} || '-' || {clock('end_s')} ELSE file END"
_CITE = "CASE WHEN start_s IS NOT NULL THEN printf('%.1fs-%.1fs', start_s, end_s) WHEN page IS NOT NULL THEN 'p.' || page ELSE '?' END"
_TAG = f"'[' || upper(modality) || CASE WHEN start_s IS NOT NULL THEN ' ' || {clock('start_s', 'floor({})')} || '-' || {clock('end_s', 'floor({})')} WHEN page IS NOT NULL THEN ' p.' || page ELSE '' END || ']'"
_NORMAL = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' ')"

QUERIES = {
    "unit_places": (unit_places, rf"""
WITH {CORPUS}
SELECT id, {_PLACE} AS locator, CASE WHEN page IS NOT NULL THEN 'page ' || page WHEN start_s IS NOT NULL THEN {clock('start_s')} ELSE file END AS judge, {_TAG} AS tag, {_CITE} AS cite,
       md5(CASE WHEN pos % 7 <> 0 AND trim(content, ' ') <> '' THEN content ELSE modality || ' from ' || file || ' at ' || {_CITE} END) AS embed_md5,
       md5({_TAG} || ' ' || {_NORMAL.format('content')}) AS rerank_md5, file AS source, page::VARCHAR AS page, round(start_s, 1) AS start_s,
       CASE WHEN page IS NOT NULL THEN file || ' p.' || page ELSE file || ' ' || round(start_s, 1) || '-' || round(end_s, 1) || 's' END AS described FROM corpus"""),
    "unit_roles": (unit_roles, f"""
WITH {CORPUS}
SELECT id, CASE WHEN modality = 'audio' THEN 'transcript' WHEN deck THEN 'deck' ELSE 'paper' END AS role, CASE WHEN modality = 'audio' THEN 'speech' WHEN deck THEN 'slides' ELSE 'notes' END AS kind,
       CASE WHEN modality = 'audio' THEN 'audio' WHEN file IN ('src0.pdf', 'src3.pdf') THEN 'deck' ELSE 'paper' END AS source, deck AND pos % 2 = 0 AS deck,
       ['audio_slide', 'figure_text', 'deictic', 'same_slide'][pos % 4 + 1] AS link_type, CASE WHEN pos % 5 > 1 THEN round(pos / 7, 2) END AS value, CASE WHEN pos % 2 = 0 THEN 0.333333 ELSE 1.0 END::DOUBLE AS strength FROM corpus"""),
    "modality_mix": (modality_mix, f"""
WITH {CORPUS}, c AS (SELECT 'in/' || file AS source_file, modality, count(*) AS k, sum(count(*)) OVER (PARTITION BY file) AS n, count(*) OVER (PARTITION BY file) AS kinds FROM corpus GROUP BY file, modality)
SELECT source_file, any_value(n)::BIGINT AS n, string_agg(CASE WHEN kinds = 1 THEN n || '/' || n || ' ' || modality ELSE modality || ' ' || k || '/' || n END, ', ' ORDER BY list_position(['text', 'figure', 'table', 'audio'], modality)) AS mix FROM c GROUP BY source_file"""),
    "unit_views": (unit_views, f"""
WITH {CORPUS} SELECT id AS unit_id, CASE WHEN modality = 'audio' THEN 'speech' WHEN deck THEN 'slides' ELSE 'notes' END AS kind, modality IN ('figure', 'table') AS figure, file, round(start_s, 2) AS start_s, round(end_s, 2) AS end_s, page::VARCHAR AS page FROM corpus"""),
    "role_files": (role_files, f"""
WITH {CORPUS}, r AS (SELECT CASE WHEN modality = 'audio' THEN 'transcript' WHEN deck THEN 'deck' ELSE 'paper' END AS role, file, min(pos) AS pos FROM corpus GROUP BY ALL)
SELECT role, string_agg(file, ',' ORDER BY pos) AS files FROM r GROUP BY role"""),
    "topic_units": (topic_units, f"WITH {CORPUS} SELECT 'x/en_' || file AS source_file, count(*) AS n FROM corpus WHERE lang = 'en' GROUP BY file"),
    "main_recording": (main_recording, f"WITH {CORPUS} SELECT id, start_s FROM corpus WHERE modality = 'audio' AND file = (SELECT min(file) FROM corpus WHERE modality = 'audio')"),
    "units_by_use": (units_by_use, f"""
WITH {CORPUS} SELECT 'audio' AS use, id FROM corpus WHERE modality = 'audio' UNION ALL SELECT 'slide', id FROM corpus WHERE modality = 'text' AND deck
UNION ALL SELECT 'text', id FROM corpus WHERE modality = 'text' UNION ALL SELECT 'figure', id FROM corpus WHERE modality = 'figure'"""),
    "reading_order": (reading_order, f"""
WITH {CORPUS} SELECT 'in/' || file AS source, md5(string_agg('[' || {_PLACE} || '] ' || substr(content, 1, 20), chr(10) ORDER BY coalesce(start_s, -1), coalesce(page, -1), id)) AS context_md5 FROM corpus GROUP BY file"""),
    "corpus_stats": (corpus_stats, f"""
WITH {EDGES}, ok AS (SELECT * FROM edges WHERE dst_id NOT LIKE '%7')
SELECT 'type ' || link_type AS name, count(*) AS n FROM ok GROUP BY link_type UNION ALL SELECT 'total', count(*) FROM ok UNION ALL SELECT 'dropped', (SELECT count(*) FROM edges) - count(*) FROM ok
UNION ALL SELECT 'links', count(*) FROM edges UNION ALL SELECT 'cross_file', count(*) FROM ok JOIN orders ON 'o' || o_orderkey = src_id JOIN part ON 'p' || p_partkey = dst_id WHERE o_orderpriority <> p_brand"""),
    "page_titles": (page_titles, rf"""
WITH {BLOCKS}, t AS (SELECT page, nth, y0, {_NORMAL.format('text')} AS text FROM blocks WHERE kind = 0)
SELECT page, arg_min(text, nth) AS title FROM t WHERE text <> '' GROUP BY page"""),
    "image_captions": (image_captions, rf"""
WITH {BLOCKS}, t AS (SELECT *, {_NORMAL.format('text')} AS t FROM blocks WHERE kind = 0)
SELECT i.page, i.nth AS image, md5(coalesce(arg_min(b.t, (b.y0 - i.y1) * 100000 + b.nth), '')) AS caption_md5
FROM blocks i LEFT JOIN (SELECT * FROM t WHERE t <> '') b ON b.page = i.page AND b.y0 - i.y1 BETWEEN 0 AND 120 AND least(b.x1, i.x1) - greatest(b.x0, i.x0) > 0 WHERE i.kind = 1 GROUP BY i.page, i.nth"""),
    "caption_regions": (caption_regions, rf"""
WITH {BLOCKS}, t AS (SELECT *, {_NORMAL.format('text')} AS t FROM blocks WHERE kind = 0),
heads AS (SELECT * FROM t WHERE t <> '' AND regexp_matches(t, '(?i)^\s*(figure|table)\s+(\d{{1,2}})\s*[:.]')),
prose AS (SELECT * FROM t WHERE t <> '' AND len(string_split(t, ' ')) >= 12),
tops AS (
  SELECT h.page, h.nth, h.x0, h.y0, h.x1, h.t, greatest(coalesce(max(p.y1), 0), h.y0 - 420) AS top FROM heads h
  LEFT JOIN prose p ON p.page = h.page AND p.nth <> h.nth AND p.y1 <= h.y0 AND least(p.x1, h.x1) - greatest(p.x0, h.x0) > 0.3 * (h.x1 - h.x0) GROUP BY h.page, h.nth, h.x0, h.y0, h.x1, h.t)
SELECT page, nth, x0, top AS y0, x1, y0 AS y1, md5(t) AS caption_md5 FROM tops WHERE tops.y0 - top >= 40"""),
    "figure_regions": (figure_regions, None),
    "region_counts": (region_counts, None),
    "box_geometry": (box_geometry, f"""
WITH {BLOCKS}, two AS (SELECT a.page, a.nth, a.x0 AS ax, b.x0 AS bx, a.y0 AS ay, b.y1 AS by1, b.y0 - a.y1 AS gap FROM blocks a JOIN blocks b ON a.page = b.page AND b.nth = a.nth + 1)
SELECT page, nth, gap, least(ax, bx) AS x0, by1 AS y1, (greatest(ax, bx) + 280 - least(ax, bx)) * (by1 - ay) AS area, abs(ax - bx) <= 300 AND gap <= 20 AS near,
       280 * 45 <= 600 * 900 * 0.03 AND ((ax + 140) / 600 < 0.3 OR (ax + 140) / 600 > 0.7) AND ((ay + 22.5) / 900 < 0.3 OR (ay + 22.5) / 900 > 0.7) AS logo FROM two"""),
    "same_span_pages": (same_span_pages, f"""
WITH {SPANS}, s AS (SELECT user_id, floor(t0 / 20000) AS a, floor(t1 / 20000) AS b, event_id FROM spans),
c AS (SELECT user_id, a, b, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS same FROM s GROUP BY ALL HAVING count(DISTINCT event_id) > 1)
SELECT user_id, event_id AS page, same FROM c JOIN s USING (user_id, a, b)"""),
    "boundary_flags": (boundary_flags, f"""
WITH {SPANS}, marks AS (SELECT user_id, t0 AS t FROM spans UNION SELECT user_id, t1 FROM spans), seg AS (SELECT user_id, event_id AS a, t0 + event_id % 9 AS a0, t1 - event_id % 7 AS a1 FROM spans)
SELECT user_id, a, EXISTS (SELECT 1 FROM marks m WHERE m.user_id = seg.user_id AND (abs(m.t - a0) <= 3 OR abs(m.t - a1) <= 3)) AS near FROM seg"""),
    "gold_intervals": (gold_intervals, """
WITH x AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 60 END::DOUBLE AS s, CASE WHEN event_id % 13 <> 0 THEN event_id % 47 + 10 END::DOUBLE AS e FROM events),
y AS (SELECT *, CASE WHEN s IS NULL OR e IS NULL THEN 'ambiguous format' WHEN e < s THEN 'end before start' WHEN s > 52 OR e > 52 THEN 'beyond video end' ELSE '' END AS reason FROM x)
SELECT event_id, CASE WHEN reason = '' THEN s END AS start_s, CASE WHEN reason = '' THEN CASE WHEN e = s THEN e + 1 ELSE e END END AS end_s, reason FROM y"""),
    "gold_units": (gold_units, f"""
WITH {CORPUS}, g AS (SELECT pos AS qid, file, page, start_s, start_s + 40 AS end_s FROM corpus WHERE pos % 10 = 1)
SELECT g.qid, c.id FROM g JOIN corpus c ON c.file = g.file AND CASE WHEN g.page IS NOT NULL THEN c.page = g.page ELSE c.start_s < g.end_s AND c.end_s > g.start_s END"""),
}
