"""What is written is read again: every writer and reader on whole tables, by way of a shared folder."""

import io
import json
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import ledger, views
from ...sources import readers, scratch, sinks
from .base import CORPUS, EDGES, corpus, edges, nodes, table


def stored_index(spark, sf):
    path = scratch.folder(spark, "index")
    sinks.index(corpus(spark, sf), path, {"dims": 64})
    units, meta = readers.index(spark, path)
    return units.select("id", F.md5("content").alias("content_md5"), F.lit(meta["dims"]).cast("long").alias("dims"))


def stored_links(spark, sf):
    """Links as JSON lines under a manifest's hash, read back without those judged unrelated."""
    path = scratch.folder(spark, "links")
    passed = F.when(F.col("score") < 0.53, False).when(F.col("score") < 0.56, True)
    rows = edges(spark, sf).withColumn("metadata", F.struct(F.struct(passed.alias("passed")).alias("relatedness")))
    sinks.links(rows, path, "abc")
    return readers.links(spark, path, "abc").groupBy("link_type", "score", "passed").agg(F.count("*").alias("n"))


def stored_pairs(spark, sf):
    """Pointing pairs as CSV with the places of both ends."""
    path = scratch.folder(spark, "pairs")
    u = corpus(spark, sf)
    pairs = u.select(F.col("id").alias("src_id"), F.lead("id").over(Window.partitionBy("source_file").orderBy("pos")).alias("dst_id"), F.lit("this").alias("cue"), F.lit(2).alias("tier"), F.lit(1).alias("cues"), (F.col("pos") % 10 / 10).alias("score"))
    sinks.pairs_csv(pairs.where("dst_id IS NOT NULL"), u, path)
    return spark.read.option("header", True).csv(path).select("src_id", "segment_start_s", "dst_id", "figure_page", "score")


def stored_usage(spark, sf):
    """Rows of use, appended twice, and their totals."""
    path = scratch.folder(spark, "usage")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.lit(1).cast("long").alias("calls"), F.col("event_id").alias("prompt_tokens"), F.lit(7).cast("long").alias("estimated_tokens"), F.when(F.col("event_id") % 4 != 0, 0.5).alias("cost"))
    sinks.ledger(rows, path)
    sinks.ledger(rows, path)
    t = ledger.totals(spark.read.schema(rows.schema).json(path), ["model"])
    return t.select("model", "calls", "prompt_tokens", "estimated_tokens", "cost", "unpriced")


def stored_replies(spark, sf):
    path = scratch.folder(spark, "replies")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("cache_dir"), F.col("event_id").cast("string").alias("slot"), F.lit(0).alias("nth"), F.concat(F.lit("r"), F.col("event_id")).alias("reply"))
    sinks.replies(rows, path)
    sinks.replies(rows.where("cache_dir = 'click'").withColumn("reply", F.lit("again")), path)
    return spark.read.parquet(path).groupBy(F.col("cache_dir").cast("string").alias("cache_dir"), (F.col("reply") == "again").alias("again")).agg(F.count("*").alias("n"))


def stored_batches(spark, sf):
    """Prompts in batches with their contexts apart, and what came back for them."""
    path = scratch.folder(spark, "batches")
    e = F.col("event_id")
    rows = table(spark, sf, "events").select((e % 9).alias("batch"), e.cast("string").alias("slot"), F.concat(F.lit("q"), e).alias("question"), F.concat(F.lit("context "), "user_id").alias("context"))
    sinks.batches(rows, path)
    asked = spark.read.json(f"{path}/prompts").join(spark.read.json(f"{path}/contexts"), "context_key")
    answers = table(spark, sf, "events").where(e % 9 != 4).select(e.cast("string").alias("slot"), F.when(e % 5 == 0, " ").when(e % 5 == 1, "PENDING").otherwise("yes").alias("reply"))
    return sinks.imported(answers, asked).groupBy("context", "state").agg(F.count("*").alias("n"))


def graphml_lines(spark, sf):
    u = nodes(spark, sf).where("modality = 'figure'").withColumn("note", F.lit('a < b & "c"'))
    lines = sinks.graphml(u, edges(spark, sf).groupBy("src_id", "dst_id").agg(F.min("score").alias("score")))
    return lines.select("part", F.md5("value").alias("line_md5"))


def report_lines(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")
    lines = sinks.markdown(rows, "events").strip().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "nth long, line string")


def stored_gold(spark, sf):
    """Gold questions as JSON lines after a line about them, and gates in the same form."""
    path = scratch.folder(spark, "gold")
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), F.array(F.struct(F.lit("f").alias("source"), (F.col("item_id") % 9).cast("int").alias("page"))).alias("gold_units"))
    sinks.json_lines(b, path, {"manifest_hash": "abc", "runs": 3})
    rows, meta = readers.json_lines(spark, path, "qid string, question string, gold_units array<struct<source:string,page:int>>")
    return rows.select("qid", F.md5("question").alias("question_md5"), F.get("gold_units", F.lit(0))["page"].cast("long").alias("page"), F.lit(meta["runs"]).cast("long").alias("runs"))


def stored_gates(spark, sf):
    path = scratch.folder(spark, "gates")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.max("value"), 4).alias("z"))
    sinks.json_lines(g.select(F.struct(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).alias("pair"), F.struct("z", (F.col("z") > 60).alias("related")).alias("gate")), path)
    rows, _ = readers.json_lines(spark, path, "pair struct<a:bigint,b:bigint>, gate struct<z:double,related:boolean>")
    verdicts = readers.named(spark, f"{path}=first", "pair struct<a:bigint,b:bigint>")
    return rows.join(verdicts, "pair").select("pair.a", "gate.z", "gate.related", "name")


def stored_transcripts(spark, sf):
    """Recordings' words stored and read, in units of sentences and of fixed spans."""
    path = scratch.folder(spark, "transcripts")
    words = readers.spoken(table(spark, sf, "conversations")).withColumn("source_file", F.concat(F.lit("talk"), "by", F.lit(".mp3")))
    sinks.transcripts(words, path)
    back = spark.read.schema(readers.TRANSCRIPT).json(path).select(F.col("audio").alias("source_file"), F.posexplode("words").alias("nth", "w")).select("source_file", F.col("nth").cast("long").alias("nth"), F.col("w")[0].cast("double").alias("start"), F.col("w")[1].cast("double").alias("end"), F.col("w")[2].alias("text"))
    u = readers.spoken_units(back)
    return u.select("id", "source_file", F.col("location.start_s").alias("start_s"), F.col("location.end_s").alias("end_s"), F.size("words").cast("long").alias("n"), F.md5("content").alias("content_md5"))


def fixed_units(spark, sf):
    words = readers.spoken(table(spark, sf, "conversations")).withColumn("source_file", F.concat(F.lit("talk"), "by", F.lit(".mp3")))
    u = readers.spoken_units(words.drop("by"), "fixed", 10.0)
    return u.groupBy("source_file").agg(F.count("*").alias("n"), F.max("location.end_s").alias("end_s"))


def known_transcripts(spark, sf):
    audio = spark.createDataFrame([(f"t{i}.mp3",) for i in range(6)], "name string")
    stored = spark.createDataFrame([(f"t{i}.frozen.json",) for i in range(0, 6, 2)], "name string")
    return readers.with_transcript(audio, stored)


def _docx(paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def file_kinds(spark, sf):
    """Files by what reads them: one that can't be read is an error of its own."""
    path = scratch.folder(spark, "files")
    for name, content in (("a.docx", _docx(["one two", "three"])), ("bad.docx", b"no archive"), ("b.PDF", b"%PDF"), ("c.txt", b"text"), ("d.JPG", b"x")):
        scratch.put(spark, f"{path}/{name}", content)
    found = readers.files(spark, path)
    units = readers.parsed(found, {"docx": readers.docx_units})
    return found.select("name", "kind").join(units.select("name", F.size("units").cast("long").alias("n"), F.col("error").isNull().alias("read")), "name")


def label_files(spark, sf):
    """Labels of segments from a table of text."""
    path = scratch.folder(spark, "labels")
    e = F.col("event_id")
    table(spark, sf, "events").select(F.concat(F.lit("s"), e).alias("segment_id"), (e * 2).alias("start"), (e * 2 + 2).alias("end"), F.when(e % 5 == 0, "none").otherwise((e % 30).cast("string")).alias("true_slide"), F.when(e % 4 == 0, F.concat_ws(";", (e % 7).cast("string"), F.lit("x"), (e % 30).cast("string"))).alias("also_correct")).write.option("header", True).csv(path)
    rows = readers.alignment_labels(spark, path)
    return rows.select("segment_id", "start", F.col("true_slide").cast("string").alias("true_slide"), F.array_join("accept", ",").alias("accept"))


def timeline_files(spark, sf):
    path = scratch.folder(spark, "timeline")
    e = F.col("event_id")
    clock = lambda c: F.concat_ws(":", F.floor(c / 60).cast("string"), (c % 60).cast("string"))
    table(spark, sf, "events").select(F.when(e % 50 == 0, "outro").otherwise(e.cast("string")).alias("slide"), F.when(e % 11 != 0, clock(e)).alias("start"), clock(e + e % 3).alias("end")).write.option("header", True).csv(path)
    rows = readers.slide_timeline(spark, path)
    return rows.select(F.col("slide").cast("string").alias("slide"), "start", "end", "outro", "zero_length")


def word_subtitles(spark, sf):
    """Words with times, one a line; a piece without a space before it belongs to the word before."""
    path = scratch.folder(spark, "srt")
    words = readers.spoken(table(spark, sf, "conversations"))
    stamp = lambda c: F.format_string("%02d:%02d:%06.3f", F.floor(c / 3600), F.floor(c / 60) % 60, c % 60)
    line = F.concat(F.lit("["), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("]"), F.when(F.col("nth") % 6 == 5, "").otherwise(" "), "text")
    lines = words.withColumn("line", line).groupBy("by").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("value"))
    first = lines.agg(F.min_by("value", F.col("by").cast("long")).alias("value"))
    first.coalesce(1).write.text(path)
    return readers.word_srt(spark, path)


def question_files(spark, sf):
    path = scratch.folder(spark, "questions")
    b = table(spark, sf, "benchmark").withColumn("video", F.concat(F.lit("v"), F.col("item_id") % 7))
    item = F.struct(F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.lit("very_easy").alias("level"), F.lit("00:01").alias("timestamp_start"), F.lit("00:09").alias("timestamp_end"))
    listed = b.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", item.alias("q")))), lambda x: x["q"]).alias("items"))
    whole = listed.agg(F.map_from_entries(F.collect_list(F.struct("video", "items"))).alias("m")).select(F.to_json("m").alias("value"))
    whole.coalesce(1).write.text(path)
    q = readers.question_maps(spark, path, "mcq")
    return q.select("video", F.col("nth").cast("long").alias("nth"), "kind", F.md5("question").alias("question_md5"), "level", F.size("options").cast("long").alias("n"))


def stored_manifest(spark, sf):
    path = scratch.folder(spark, "manifest")
    schema = "name string, bytes bigint, sha256 string, units map<string,bigint>"
    missing = readers.manifest(spark, path, schema) is None
    u = corpus(spark, sf).withColumn("source_file", T.file_name(F.col("source_file")))
    files = u.groupBy(F.col("source_file").alias("name")).agg(F.encode(F.concat(F.lit("file "), F.min("id")), "utf-8").alias("content"))
    sinks.manifest(ledger.manifest(u, files), path)
    m = readers.manifest(spark, path, schema)
    return m.select("name", "bytes", "sha256", F.aggregate(F.map_values("units"), F.lit(0).cast("long"), lambda s, x: s + x).alias("units"), F.lit(missing).alias("was_missing"))


def page_units(spark, sf):
    """Units of pages that lines of documents lay out: windows of text, and figures as decks or papers have them."""
    from .base import blocks

    b = blocks(spark, sf).withColumn("source_file", F.concat(F.lit("f"), (F.col("page") % 30).cast("string"), F.lit(".pdf")))
    pages = b.select("source_file", "page").distinct().withColumns({"width": F.when(F.col("page") % 30 < 12, 900.0).otherwise(600.0), "height": F.lit(700.0)})
    drawn = b.where("kind = 1").select("source_file", "page", "box")
    u = readers.page_layout(b, drawn, pages)
    return u.select("id", "modality", F.md5("content").alias("content_md5"), "deck")


def image_units(spark, sf):
    i = table(spark, sf, "part").select(F.concat(F.lit("i"), "p_partkey", F.lit(".png")).alias("name"), (F.col("p_size") * 10).alias("width"), F.lit(20).alias("height"), F.encode("p_name", "utf-8").alias("content"))
    u = readers.image_units(i, lambda b: bytes(b).decode().upper())
    return u.select("id", "content", F.col("location.bbox")[2].alias("width"))


def topic_tables(spark, sf):
    path = scratch.folder(spark, "topics")
    scratch.put(spark, f"{path}/topics.json", json.dumps([{"topic": "a", "files": ["x", "y"], "notes_pages": [2, 5]}, {"topic": "b", "files": []}]).encode())
    scratch.put(spark, f"{path}-truth/t.csv", b"Time,Text,Key\n1.5,hello,3\n,lost,4\n2,,-1\n")
    scratch.put(spark, f"{path}-links/l.txt", b"video_1 https://example.org/a.\nno link here\n video_2 http://example.org/b\n")
    t = readers.topics(spark, f"{path}/topics.json").select(F.col("topic").alias("name"), F.concat_ws(",", F.array_join("files", "+"), F.col("first").cast("string"), F.col("last").cast("string")).alias("value"))
    s = readers.truth_sheet(spark, f"{path}-truth").select(F.col("t").cast("string").alias("name"), F.concat_ws(",", "text", F.col("slide").cast("string")).alias("value"))
    links = readers.table_links(spark.read.text(f"{path}-links").withColumnRenamed("value", "text")).select(F.col("id").alias("name"), F.col("url").alias("value"))
    return t.unionByName(s).unionByName(links)


def policy_guards(spark, sf):
    """What policies let pass, case by case, and what a backend may set."""
    ok = ledger.allowed
    judge, cheap = {"model": "big"}, ["small"]
    cases = {
        "cheap": ok(ledger.refuse_strong, {"llm": {"model": "small-2"}}, cheap), "strong": ok(ledger.refuse_strong, {"llm": judge}, cheap), "leave": ok(ledger.refuse_strong, {"llm": judge}, cheap, True),
        "stored": ok(ledger.refuse_strong, {"llm": judge}, cheap, False, ("llm",)), "gold": ok(ledger.refuse_ablation, "nli", ["gold"], ["gold/x"]), "scratch": ok(ledger.refuse_ablation, "nli", ["gold"], ["tmp/x"]),
        "llm gold": ok(ledger.refuse_ablation, "llm", ["gold"], ["gold/x"]), "billed": ok(ledger.refuse_billing, judge, 0.0, False), "budget": ok(ledger.refuse_billing, judge, 1.0, False), "free": ok(ledger.refuse_billing, {"billing": "free"}, 0.0, False),
        "backend": readers.config('{"models": {"llm": {"model": "a", "n": 1}, "backends": {"b": {"model": "c", "n": 2}}}}', "b")["models"]["llm"]["model"] == "c",
        "other keys": readers.config('{"models": {"llm": {"model": "a", "n": 1}, "backends": {"b": {"model": "c", "n": 2}}}}', "b")["models"]["llm"]["n"] == 2,
    }
    return spark.createDataFrame(list(cases.items()), "name string, allowed boolean")


def page_ranges(spark, sf):
    return readers.page_range(corpus(spark, sf), 10, 20).select("id")


def tagged_units(spark, sf):
    """Units numbered for citing, a second time for each repeated id."""
    u = corpus(spark, sf).select(F.col("lang").alias("qid"), "id", F.col("pos").alias("rank"))
    return views.numbered_evidence(u).groupBy("qid").agg(F.max("n").cast("long").alias("n"))


_WORDS = r"""
turns AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS k FROM conversations),
words AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS nth FROM turns)
"""

QUERIES = {
    "stored_index": (stored_index, f"WITH {CORPUS} SELECT id, md5(content) AS content_md5, 64::BIGINT AS dims FROM corpus"),
    "stored_links": (stored_links, f"WITH {EDGES} SELECT link_type, score, CASE WHEN score < 0.56 THEN true END AS passed, count(*) AS n FROM edges WHERE score >= 0.53 GROUP BY ALL"),
    "stored_pairs": (stored_pairs, f"""
WITH {CORPUS}, p AS (SELECT id AS src_id, start_s, pos, lead(id) OVER w AS dst_id, lead(page) OVER w AS page FROM corpus WINDOW w AS (PARTITION BY file ORDER BY pos))
SELECT src_id, start_s::VARCHAR AS segment_start_s, dst_id, page::VARCHAR AS figure_page, ((pos % 10) / 10)::VARCHAR AS score FROM p WHERE dst_id IS NOT NULL"""),
    "stored_usage": (stored_usage, """
SELECT event_type AS model, 2 * count(*) AS calls, (2 * sum(event_id))::BIGINT AS prompt_tokens, 14 * count(*) AS estimated_tokens, 1.0::DOUBLE * count(*) FILTER (WHERE event_id % 4 <> 0) AS cost, 2 * count(*) FILTER (WHERE event_id % 4 = 0) AS unpriced FROM events GROUP BY event_type"""),
    "stored_replies": (stored_replies, "SELECT event_type AS cache_dir, event_type = 'click' AS again, count(*) AS n FROM events GROUP BY event_type"),
    "stored_batches": (stored_batches, """
SELECT 'context ' || user_id AS context, CASE WHEN event_id % 9 = 4 THEN 'missing' WHEN event_id % 5 = 0 THEN 'refused' WHEN event_id % 5 = 1 THEN 'pending' ELSE 'stored' END AS state, count(*) AS n FROM events GROUP BY ALL"""),
    "graphml_lines": (graphml_lines, f"""
WITH {EDGES}, e AS (SELECT src_id, dst_id, min(score) AS score FROM edges GROUP BY ALL)
SELECT 0::INT AS part, md5('<node id="p' || p_partkey || '"><data key="modality">figure</data><data key="source_file">' || p_brand || '</data><data key="note">a &lt; b &amp; &quot;c&quot;</data></node>') AS line_md5 FROM part
UNION ALL SELECT 1, md5('<edge source="' || src_id || '" target="' || dst_id || '"><data key="score">' || score || '</data></edge>') FROM e"""),
    "report_lines": (report_lines, """
WITH r AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type) + 3 AS nth FROM events GROUP BY event_type)
SELECT 0::BIGINT AS nth, '# events' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| event_type | n |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT nth, '| ' || event_type || ' | ' || n || ' |' FROM r"""),
    "stored_gold": (stored_gold, "SELECT item_id::VARCHAR AS qid, md5(text) AS question_md5, item_id % 9 AS page, 3::BIGINT AS runs FROM benchmark"),
    "stored_gates": (stored_gates, "SELECT user_id AS a, round(max(value), 4) AS z, round(max(value), 4) > 60 AS related, 'first' AS name FROM events GROUP BY user_id"),
    "stored_transcripts": (stored_transcripts, rf"""
WITH {_WORDS}, marked AS (SELECT *, coalesce(regexp_matches(lag(w) OVER (PARTITION BY conv_id ORDER BY nth), '[.!?]["'')\]]?$'), false) AS fresh FROM words),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS n FROM marked)
SELECT 'talk' || conv_id || ':a' || n AS id, 'talk' || conv_id || '.mp3' AS source_file, min(nth) * 0.5::DOUBLE AS start_s, (max(nth) + 1) * 0.5::DOUBLE AS end_s, count(*) AS n, md5(string_agg(w, ' ' ORDER BY nth)) AS content_md5 FROM s GROUP BY conv_id, s.n"""),
    "fixed_units": (fixed_units, rf"WITH {_WORDS} SELECT 'talk' || conv_id || '.mp3' AS source_file, max(nth) // 20 + 1 AS n, (max(nth) + 1) * 0.5::DOUBLE AS end_s FROM words GROUP BY conv_id"),
    "known_transcripts": (known_transcripts, "SELECT 't' || i || '.mp3' AS name, i % 2 = 0 AS has_transcript FROM (SELECT unnest(range(0, 6)) AS i)"),
    "file_kinds": (file_kinds, "SELECT * FROM (VALUES ('a.docx', 'docx', 1::BIGINT, true), ('bad.docx', 'docx', 0, false), ('b.PDF', 'pdf', 0, false), ('c.txt', NULL, 0, false), ('d.JPG', 'image', 0, false)) AS t(name, kind, n, read)"),
    "label_files": (label_files, """
SELECT 's' || event_id AS segment_id, (event_id * 2)::DOUBLE AS start, CASE WHEN event_id % 5 <> 0 THEN (event_id % 30)::VARCHAR END AS true_slide,
       CASE WHEN event_id % 5 <> 0 THEN event_id % 30 || CASE WHEN event_id % 4 = 0 AND event_id % 7 <> event_id % 30 THEN ',' || event_id % 7 ELSE '' END END AS accept FROM events"""),
    "timeline_files": (timeline_files, """
SELECT CASE WHEN event_id % 50 <> 0 THEN event_id::VARCHAR END AS slide, event_id::DOUBLE AS start, (event_id + event_id % 3)::DOUBLE AS "end", event_id % 50 = 0 AS outro, event_id % 3 = 0 AS zero_length FROM events WHERE event_id % 11 <> 0"""),
    "word_subtitles": (word_subtitles, rf"""
WITH {_WORDS}, f AS (SELECT * FROM words WHERE conv_id = (SELECT min(conv_id) FROM conversations)), g AS (SELECT *, sum((nth % 6 <> 5)::INT) OVER (ORDER BY nth) AS g FROM f)
SELECT min(nth) * 0.5::DOUBLE AS start, (max(nth) + 1) * 0.5::DOUBLE AS "end", string_agg(w, '' ORDER BY nth) AS text FROM g GROUP BY g"""),
    "question_files": (question_files, "SELECT 'v' || item_id % 7 AS video, row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) - 1 AS nth, 'mcq' AS kind, md5(text) AS question_md5, 'very easy' AS level, 2::BIGINT AS n FROM benchmark"),
    "stored_manifest": (stored_manifest, f"WITH {CORPUS} SELECT file AS name, length('file ' || min(id)) AS bytes, sha256('file ' || min(id)) AS sha256, count(*) AS units, true AS was_missing FROM corpus GROUP BY file"),
    "page_units": (page_units, None),
    "image_units": (image_units, "SELECT 'i' || p_partkey || ':f0' AS id, trim(regexp_replace(upper(p_name), '\\s+', ' ', 'g'), ' ') AS content, (p_size * 10)::DOUBLE AS width FROM part"),
    "topic_tables": (topic_tables, "SELECT * FROM (VALUES ('a', 'x+y,2,5'), ('b', ''), ('1.5', 'hello,3'), ('2.0', ',-1'), ('video_1', 'https://example.org/a'), ('video_2', 'http://example.org/b')) AS t(name, value)"),
    "policy_guards": (policy_guards, """
SELECT * FROM (VALUES ('cheap', true), ('strong', false), ('leave', true), ('stored', true), ('gold', false), ('scratch', true), ('llm gold', true), ('billed', false), ('budget', true), ('free', true), ('backend', true), ('other keys', false)) AS t(name, allowed)"""),
    "page_ranges": (page_ranges, f"WITH {CORPUS} SELECT id FROM corpus WHERE page BETWEEN 10 AND 20"),
    "tagged_units": (tagged_units, f"WITH {CORPUS} SELECT lang AS qid, count(DISTINCT id) AS n FROM corpus GROUP BY lang"),
}
