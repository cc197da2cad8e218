"""Studies: sweeps, tables over repeats, paired comparisons, samples, alignment variants, gates between documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import alignment, evaluation, graph, links, ranking, sampling, segments, studies, views
from .base import CORPUS, EDGES, IN_TURN, MATRIX, SPANS, corpus, edges, in_turn, matrix, nodes, spans, table


def _scores(spark, sf):
    """Scores of lectures in two parts under settings: parts of the price of orders by priority."""
    o = table(spark, sf, "orders")
    part = F.when(F.col("o_custkey") % 2 == 0, "tune").otherwise("test")
    return o.groupBy(F.col("o_custkey").alias("lecture"), part.alias("part"), F.col("o_orderpriority").alias("setting")).agg(F.round(F.avg(F.col("o_totalprice") % 1000) / 1000, 6).alias("value"))


def weight_sweep(spark, sf):
    """A fused matrix's mean best cell for each of five weights."""
    m = matrix(spark, sf)
    grid = spark.createDataFrame([(k / 4,) for k in range(5)], "w double")
    cells = m.groupBy("pair", "i").agg(F.max("s").alias("a"), F.max(F.round(F.col("s") * F.col("s"), 6)).alias("b"))
    return studies.swept(grid, cells, ["pair"], F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")).withColumn("value", F.round("value", 6))


def tuned_setting(spark, sf):
    return studies.best_setting(_scores(spark, sf), ["setting"])


def kept_gate(spark, sf):
    """The best setting's mean, unless none of them beats the first."""
    return studies.kept_if_better(_scores(spark, sf), "setting", "1-URGENT").withColumn("mean", F.round("mean", 6))


def _frames(spark, sf):
    return alignment.margin(matrix(spark, sf)).select("pair", "i", (F.col("i") % 7).alias("words"), F.round("margin", 6).alias("margin"))


def visible_frames(spark, sf):
    f = _frames(spark, sf)
    return f.select("pair", "i", studies.visible(F.col("words"), F.col("margin"), 3, 0.05).alias("seen"))


def gated_fusion(spark, sf):
    """Three matrices fused, with blind rows where no slide is seen."""
    m = matrix(spark, sf)
    squared, shifted = (m.withColumn("s", F.round(c, 6)) for c in (F.col("s") * F.col("s"), F.col("s") + F.col("j") / 50))
    blind = studies.blinded(m, _frames(spark, sf), ["pair"], 3, 0.05)
    return studies.fused_many([blind, squared, shifted], [0.5, 0.3, 0.2], ["pair"]).withColumn("s", F.round("s", 6))


def shown_rows(spark, sf):
    """Rows of the frame that was shown at each midpoint."""
    s = spans(spark, sf).withColumn("b", F.row_number().over(Window.partitionBy("user_id").orderBy("t0", "event_id")) - 1)
    slides = s.where("b % 3 < 2").select("user_id", F.col("b").cast("long").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    points = s.select("user_id", F.col("event_id").alias("a"), ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    frames = slides.select("user_id", F.col("b").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).withColumn("s", (F.col("k") * 3 + F.col("j")) % 5 + 1.0)
    return studies.rows_of_shown(points, slides, frames, ["user_id"], 20000.0).withColumn("j", F.col("j").cast("long"))


def position_floors(spark, sf):
    """The page that a segment's place alone gives."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("pair"), F.col("vec_id").alias("i"))
    return studies.position_floor(e, "pair", "i", F.lit(12)).select("pair", "i", F.col("floor").cast("long").alias("floor"))


def decoder_table(spark, sf):
    """Mean F1 of two matrices and two decoders against a made-up truth."""
    m = matrix(spark, sf)
    truth = m.select(F.col("pair").alias("lecture"), "i").distinct().withColumn("truth", F.when(F.col("i") % 9 == 0, -1).otherwise(F.col("i") % 12))
    squared = m.withColumn("s", F.round(F.col("s") * F.col("s"), 6))
    paths = graph.union_all([
        alignment.abstained(alignment.naive(x), x, least).select(F.lit(name).alias("matrix"), F.lit(how).alias("decoder"), F.col("pair").alias("lecture"), "i", F.col("j").alias("pred"))
        for name, x in (("plain", m), ("squared", squared)) for how, least in (("naive", None), ("abstain", 0.2))
    ])
    return studies.decoder_table(paths, truth).withColumn("f1", F.round("f1", 6))


def lecture_wins(spark, sf):
    s = _scores(spark, sf).select("lecture", F.col("setting").alias("variant"), "value")
    return studies.wins(s, "1-URGENT", "5-LOW").select("n", "wins", "ties", F.round("diff", 6).alias("diff"))


def signed_ranks(spark, sf):
    d = table(spark, sf, "events").select((F.floor(F.col("value") * 10) % 41 - 17).alias("diff"))
    return studies.signed_ranks(d)


def gate_granularity(spark, sf):
    o = table(spark, sf, "orders")
    z = o.groupBy(F.col("o_custkey").alias("lecture"), F.substring("o_orderpriority", 1, 1).alias("granularity")).agg(F.round(F.avg("o_totalprice") / 1e4, 4).alias("z"))
    wide = studies.by_granularity(z, ["1", "2", "3"])
    return wide.select("lecture", F.col("1").alias("z1"), F.col("2").alias("z2"), F.col("3").alias("z3"))


def _answers(spark, sf):
    e = F.col("event_id")
    said = F.when(e % 10 == 0, "It is NOT found in the provided material.").otherwise("yes")
    return table(spark, sf, "events").select(F.col("event_type").alias("level"), F.element_at(F.array(F.lit("closed"), F.lit("open")), (e % 2 + 1).cast("int")).alias("mode"), (F.floor(e / 2) % 3).alias("rep"), said.alias("answer"), (e % 101 / 100).alias("f1"), (e % 37 / 36).alias("sim"))


def answer_table(spark, sf):
    t = studies.answer_table(_answers(spark, sf), refusals=("not found in the provided material",), metrics=("f1", "sim"))
    return t.select("level", "mode", "n", *(F.round(c, 6).alias(c) for c in ("f1", "f1_std", "sim", "sim_std")), "refusals")


def share_reached(spark, sf):
    return studies.share_reached(_answers(spark, sf), "closed", "open").withColumn("share", F.round("share", 6))


def echo_floor(spark, sf):
    """Token F1 of passages echoed as answers to documents, taken in turn."""
    rows = in_turn(spark, sf).select(F.col("lang").alias("level"), F.col("passage").alias("question"), F.col("text").alias("ref"))
    return studies.echo_floor(rows).withColumn("f1", F.round("f1", 6))


def greedy_pairs(spark, sf):
    """Pairs of vectors of two labels, the closest first, each vector once."""
    v = table(spark, sf, "embeddings")
    a = v.where("label % 2 = 0").select((F.col("label") / 2).cast("int").alias("g"), F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = v.where("label % 2 = 1").select(((F.col("label") - 1) / 2).cast("int").alias("g"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return studies.closest_pairs(a, b, "g", 0.1, 8)


def timed_context(spark, sf):
    """Retrieval within a question's time, in runs that touch."""
    c = spans(spark, sf)
    chunks = c.select(F.col("event_id").alias("pos"), F.concat(F.lit("e"), "event_id").alias("id"), F.col("t0").alias("start_s"), F.col("t1").alias("end_s"))
    asked = c.groupBy(F.col("user_id").alias("qid")).agg(F.min("t0").alias("m")).select("qid", F.when(F.col("qid") % 3 != 0, F.col("m") + 20000).alias("low"), (F.col("m") + 800000).alias("high"))
    scored = c.select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.round(F.col("event_id") % 89 / 88, 6).alias("score"))
    t = studies.timed_context(chunks, asked, scored, k=30, least=0.3, around=30.0, gap=9000.0)
    return t.select("qid", F.col("nth").cast("long").alias("nth"), F.array_join("ids", ",").alias("ids"), "start_s", "end_s", "score")


def scaled_scores(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 == 0, 2.0).when((F.col("user_id") % 7 != 0) | (F.col("event_id") % 50 != 0), F.col("value")).alias("score"))
    return studies.scaled_scores(raw).withColumn("score", F.round("score", 6))


def unit_vectors(spark, sf):
    """Vectors at length 1 of pools that have all of theirs."""
    v = table(spark, sf, "embeddings")
    results = v.select(F.floor(F.col("vec_id") / 10).alias("qid"), F.when((F.floor(F.col("vec_id") / 10) % 4 == 0) & (F.col("vec_id") % 10 == 3), "none").otherwise(F.concat(F.lit("v"), F.col("vec_id"))).alias("id"))
    u = studies.unit_vectors(results, v.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")))
    return u.select("qid", "id", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.col("embedding")[63], 5).alias("last"))


def build_paths(spark, sf):
    """Alignment with decks whose pages build on each other in twos."""
    m = matrix(spark, sf)
    terms = lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.lit("t"), k.cast("string")))
    pages = m.select("pair", "j").distinct().withColumn("tokens", F.concat(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("p"), F.floor(F.col("j") / 2).cast("string"), F.lit("_"), k.cast("string"))), F.when(F.col("j") % 2 == 1, F.array(F.concat(F.lit("x"), F.col("j").cast("string")))).otherwise(F.array().cast("array<string>"))))
    sentences = m.select("pair", "i").distinct().withColumn("tokens", F.concat(F.array(F.concat(F.lit("x"), (F.col("i") % 12).cast("string"))), terms((F.col("i") % 3).cast("int"))))
    return studies.build_paths(m, pages, sentences, least=0.05).withColumn("s", F.round("s", 6))


def decoded_windows(spark, sf):
    """Slides of sentences, three of them to a window."""
    m = matrix(spark, sf)
    owners = m.select("pair", "i").distinct().select("pair", "i", F.explode(F.sequence(F.col("i") * 3, F.col("i") * 3 + 2)).alias("sentence"))
    return studies.decoded(m, owners, "naive+abstain", least=0.2)


def fixed_windows(spark, sf):
    """Consecutive events closed into windows of a stated span, by their share of cuts."""
    s = spans(spark, sf).select("user_id", "event_id", "t0", "t1").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("t0", "event_id")))
    w = segments.closing_spans(s, "user_id", 90000.0, "nth", "t1", "t0")
    return w.groupBy("user_id", "bucket").agg(F.count("*").alias("n"), F.min("t0").alias("start"), F.max("t1").alias("end"))


def page_builds(spark, sf):
    """Lines of documents as pages: each with all terms of the one before builds on it."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    grown = lines.withColumn("tokens", F.when(F.col("page") % 3 == 1, F.concat(T.tokens(F.coalesce(F.lag("line").over(Window.partitionBy("doc_id").orderBy("page")), F.lit(""))), T.tokens(F.col("line")))).otherwise(T.tokens(F.col("line"))))
    return segments.build_groups(grown, "doc_id").select("doc_id", F.col("page").cast("long").alias("page"), F.col("island").cast("long").alias("island"))


def changed_frames(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return segments.changed_frames(e, "label", "vec_id", "embedding", 0.13).select("label", "vec_id", "kept")


def sampled_ticks(spark, sf):
    s = spans(spark, sf).select("user_id", "t0")
    return segments.sampled_ticks(s, "user_id", "t0", 50000.0).groupBy("user_id").agg(F.sum("kept").alias("kept"), F.count("*").alias("n"))


def systematic_sample(spark, sf):
    """One event of each of seven strata of a user's events."""
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("p"))
    return sampling.systematic(rows, "user_id", "p", 7, "s").select("user_id", "event_id")


def topped_up_sample(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "source")
    few = sampling.stratified(rows, "source", "id", 0.02, 1, 5)
    return sampling.topped_up(few, rows, "id", ["src1:", "src3:"], 6, 9)


def seeded_halves(spark, sf):
    return sampling.halves(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")), "key", 4)


def paired_differences(spark, sf):
    """Differences of two cells by question, over their runs."""
    e = F.col("event_id")
    results = table(spark, sf, "events").select((e % 150).alias("qid"), (e % 150 % 7).alias("topic"), F.element_at(F.array(F.lit("links"), F.lit("plain"), F.lit("other")), (F.floor(e / 150) % 3 + 1).cast("int")).alias("cell"), F.floor(e / 450).alias("run"), F.col("value"))
    return evaluation.paired(results, "links", "plain").withColumn("diff", F.round("diff", 6))


def tolerant_accuracy(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select((e % 12).alias("pred"), F.array(e % 7, e % 11).alias("accept"))
    one, two = (evaluation.tolerant_accuracy(rows, k).withColumn("tolerance", F.lit(k)) for k in (0, 1))
    return one.unionByName(two).select("tolerance", F.round("accuracy", 6).alias("accuracy"), "n")


def type_buckets(spark, sf):
    kind = F.element_at(F.array(F.lit("deictic"), F.lit("cross_modal"), F.lit("audio_only"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.explode(evaluation.buckets(kind)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def audit_marks(spark, sf):
    """Where right options stand, and how often they are the longest."""
    e = F.col("event_id")
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.repeat(F.lit("x"), ((e * (k + 3)) % 11 + 1).cast("int")))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("level"), options.alias("options"), (e % 4).cast("int").alias("gold"))
    m = evaluation.audit_marks(rows)
    return m.select("level", *(F.round(c, 6).alias(c) for c in ("share_A", "share_B", "share_C", "share_D", "longest")), "n")


def confident_rates(spark, sf):
    return alignment.confident_rate(matrix(spark, sf), 0.05).withColumn("rate", F.round("rate", 6))


def temporal_links(spark, sf):
    """Links between events and moved spans of the same user whose times overlap."""
    s = spans(spark, sf)
    unit = lambda a, b, p: s.select(F.col("user_id").cast("string").alias("source_file"), F.concat(F.lit(p), "event_id").alias("id"), F.struct(a.alias("start_s"), b.alias("end_s")).alias("location"))
    return links.temporal(unit(F.col("t0"), F.col("t1"), "a"), unit(F.col("t0") + 5000, F.col("t1") + 6000, "f"), 20000.0)


def aligned_links(spark, sf):
    """Links of a path with the recordings that a gate lets through."""
    m = matrix(spark, sf)
    name = lambda c, p, out: m.select("pair", c).distinct().withColumn(out, F.concat(F.lit(p), F.col("pair").cast("string"), F.lit("_"), F.col(c).cast("string")))
    gates = m.select("pair").distinct().withColumn("related", F.col("pair") % 3 != 0)
    return links.aligned_links(alignment.naive(m), name("i", "a", "id"), name("j", "s", "id"), gates, 0.2)


def shown_slides(spark, sf):
    """The slide that each order is linked with last, and the better of its pairs by tier."""
    e = edges(spark, sf).where("link_type = 'audio_slide'").withColumn("nth", F.xxhash64("dst_id"))
    slides = nodes(spark, sf).where("modality = 'figure'").withColumn("location", F.struct(F.regexp_replace("id", "p", "").cast("int").alias("page")))
    ordered = e.groupBy("src_id", "link_type", "dst_id").agg(F.max(F.regexp_replace("dst_id", "p", "").cast("long")).alias("nth"))
    return links.slide_map(ordered, slides).select("id", "deck", F.col("page").cast("long").alias("page"))


def _pointing(spark, sf):
    e = edges(spark, sf)
    return e.select("src_id", "dst_id", F.col("link_type").alias("cue"), (F.length("dst_id") % 3 + 1).alias("tier"), "score", F.length("link_type").alias("nth"))


def deictic_pairs(spark, sf):
    p = links.deictic_pairs(_pointing(spark, sf))
    return p.select("src_id", "dst_id", "score", "cues", F.col("tier").cast("long").alias("tier"))


def tier_breakdown(spark, sf):
    t = links.tier_breakdown(links.deictic_pairs(_pointing(spark, sf)))
    return t.select(F.col("tier").cast("long").alias("tier"), "n", F.round("mean", 6).alias("mean"))


def _gates(spark, sf):
    """Vectors by label as documents: even ones have figures, odd ones texts, and shuffled texts beside."""
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("f"), F.col("vec_id")).alias("id"), F.concat(F.lit("d"), F.col("label")).alias("source_file"), "label", "vec_id", "embedding")
    turned = lambda k: F.concat(F.slice("embedding", k + 1, 64), F.slice("embedding", 1, k))
    figures, texts = v.where("label % 2 = 0"), v.where("label % 2 = 1")
    nulls = graph.union_all([texts.select("source_file", F.lit(k).alias("shuffle"), turned(7 * k + 1).alias("embedding")) for k in range(3)])
    return links.document_gate(figures, texts, nulls, 1.27)


def document_gates(spark, sf):
    return _gates(spark, sf).select("src_file", "dst_file", F.round("z", 4).alias("z"), "related")


def pair_gates(spark, sf):
    """Gates of directions as gates of pairs."""
    paired = graph.file_pairs(edges(spark, sf), nodes(spark, sf)).where("file_a IS NOT NULL")
    g = paired.select(F.when(F.col("score") > 0.55, F.col("file_a")).otherwise(F.col("file_b")).alias("src_file"), F.when(F.col("score") > 0.55, F.col("file_b")).otherwise(F.col("file_a")).alias("dst_file"), F.round(F.col("score") * 4 - 2, 4).alias("z"), (F.col("score") > 0.59).alias("related"))
    return views.pair_gates(g)


def pair_rows(spark, sf):
    paired = graph.file_pairs(edges(spark, sf), nodes(spark, sf)).where("file_a IS NOT NULL")
    size = F.length("file_a") + F.length("file_b")
    counts = paired.where("score >= 0.58").groupBy("file_a", "file_b").agg(F.count("*").alias("n"))
    pairs = paired.select("file_a", "file_b").distinct()
    gates = pairs.where(size % 4 != 0).select("file_a", "file_b", ((size % 7) / 2 - 1).alias("z"), (size % 2 == 0).alias("related"), F.when(size % 5 < 3, "audio_slide").otherwise("figure_text").alias("kind"))
    overrides = pairs.where(size % 3 == 0).select("file_a", "file_b", (size % 2 == 0).alias("related"))
    return views.pair_rows(counts, gates, overrides, 1.2)


def judged_links(spark, sf):
    """Links after verdicts, the last one of an edge, and how many a gate keeps."""
    e = edges(spark, sf).distinct()
    last = F.regexp_extract("dst_id", "[0-9]+", 0).cast("long")
    v = e.where(last % 3 != 0).select("src_id", "dst_id", "link_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), last.alias("k")).withColumn("passed", (F.col("k") + F.col("nth")) % 2 == 0)
    return graph.gated(graph.apply_verdicts(e, v)).groupBy("link_type", "passed").agg(F.count("*").alias("n"))


def expansion_reasons(spark, sf):
    """Why each unit of an expansion is there."""
    from .base import seeds

    x = graph.expand(seeds(spark, sf), graph.neighbours(edges(spark, sf)), nodes(spark, sf))
    return x.groupBy(F.regexp_replace(views.explained(F.col("origin"), F.col("via_seed"), F.col("via_link"), F.col("link_score")), "o[0-9]+", "o").alias("why")).agg(F.count("*").alias("n"))


def control_counts(spark, sf):
    e = edges(spark, sf).select(F.concat(F.col("link_type"), F.lit(":"), "src_id").alias("src_id"), F.concat(F.when(F.col("score") > 0.55, F.col("link_type")).otherwise("b"), F.lit(":"), "dst_id").alias("dst_id"), "link_type")
    return views.control_counts(e)


def gate_rejections(spark, sf):
    g = table(spark, sf, "events").select(F.round(F.col("value") / 10, 4).alias("z")).withColumn("related", F.col("z") >= 1.27)
    return views.rejections(g).select("n", "rejected", F.round("share", 6).alias("share"), "low", F.round("middle", 6).alias("middle"), "high")


def label_crosstab(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 5).alias("group"), F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").otherwise("poor").alias("verdict"))
    return views.crosstab(rows, "group", "verdict", ["good", "poor", "bad"])


def status_coverage(spark, sf):
    ids = views.numbered_names(spark, "video_", 100)
    e = table(spark, sf, "events")
    statuses = e.where("event_id % 13 = 0").select(F.concat(F.lit("video_"), F.col("event_id") % 140).alias("id"), F.when(F.col("event_id") % 140 % 3 == 0, "failed").otherwise("done").alias("status")).distinct()
    return views.status_coverage(ids, statuses)


def deck_pages(spark, sf):
    """Texts of decks' pages, by OCR where they have none."""
    u = corpus(spark, sf).where("deck").withColumn("content", F.when(F.col("pos") % 5 == 0, " ").otherwise(F.substring("content", 1, 25)))
    read = u.select(T.file_name(F.col("source_file")).alias("file"), F.col("location.page").alias("page")).where("page IS NOT NULL").distinct().withColumn("text", F.when(F.col("page") % 4 != 0, F.concat(F.lit("read "), F.col("page").cast("string"))))
    found = views.first_of_page(u, read)
    return found.select("file", F.col("page").cast("long").alias("page"), F.md5("text").alias("text_md5"))


_DRAW = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0"
_SCORES = """
scores AS (SELECT o_custkey AS lecture, CASE WHEN o_custkey % 2 = 0 THEN 'tune' ELSE 'test' END AS part, o_orderpriority AS setting, round(avg(o_totalprice % 1000) / 1000, 6) AS value FROM orders GROUP BY ALL)
"""
_MARGIN = f"""
{MATRIX}, r AS (SELECT pair, i, list(s ORDER BY s DESC) AS l FROM matrix GROUP BY ALL), frames AS (SELECT pair, i, i % 7 AS words, round(l[1] - l[2], 6) AS margin FROM r)
"""
_ANSWERS = """
answers AS (
  SELECT event_type AS level, ['closed', 'open'][event_id % 2 + 1] AS mode, (event_id // 2) % 3 AS rep, event_id % 10 = 0 AS refused, (event_id % 101) / 100 AS f1, (event_id % 37) / 36 AS sim FROM events)
"""
_PAIRED = f"""
{EDGES}, paired AS (
  SELECT e.score, least(o_orderpriority, p_brand) AS file_a, greatest(o_orderpriority, p_brand) AS file_b FROM edges e JOIN orders ON 'o' || o_orderkey = src_id JOIN part ON 'p' || p_partkey = dst_id WHERE o_orderpriority <> p_brand)
"""
_POINTING = f"""
{EDGES}, p AS (SELECT src_id, dst_id, link_type AS cue, length(dst_id) % 3 + 1 AS tier, score, length(link_type) AS nth FROM edges),
pairs AS (SELECT src_id, dst_id, max(score) AS score, count(*) AS cues, any_value(tier) AS tier FROM p GROUP BY ALL)
"""

QUERIES = {
    "weight_sweep": (weight_sweep, f"""
WITH {MATRIX}, c AS (SELECT pair, i, max(s) AS a, max(round(s * s, 6)) AS b FROM matrix GROUP BY ALL)
SELECT pair, w, round(avg(w * a + (1 - w) * b), 6) AS value FROM c, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) GROUP BY pair, w"""),
    "tuned_setting": (tuned_setting, f"""
WITH {_SCORES}, m AS (SELECT setting, round(avg(value), 9) AS m FROM scores WHERE part = 'tune' GROUP BY setting ORDER BY m DESC, setting LIMIT 1)
SELECT lecture, part, setting, value FROM scores JOIN m USING (setting)"""),
    "kept_gate": (kept_gate, f"WITH {_SCORES}, m AS (SELECT setting, round(avg(value), 9) AS mean FROM scores GROUP BY setting) SELECT setting, round(mean, 6) AS mean FROM m ORDER BY m.mean DESC, setting <> '1-URGENT', setting LIMIT 1"),
    "visible_frames": (visible_frames, f"WITH {_MARGIN} SELECT pair, i, words >= 3 OR margin > 0.05 AS seen FROM frames"),
    "gated_fusion": (gated_fusion, f"""
WITH {_MARGIN}, parts AS (
  SELECT m.pair, m.i, j, CASE WHEN words >= 3 OR margin > 0.05 THEN s ELSE min(s) OVER (PARTITION BY m.pair) END AS a, round(s * s, 6) AS b, round(s + j / 50, 6) AS c FROM matrix m JOIN frames f ON f.pair = m.pair AND f.i = m.i)
SELECT pair, i, j, round(0.5 * (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) + 0.3 * (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) + 0.2 * (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w), 6) AS s FROM parts WINDOW w AS (PARTITION BY pair)"""),
    "shown_rows": (shown_rows, f"""
WITH {SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) - 1 AS b FROM spans), sl AS (SELECT * FROM n WHERE b % 3 < 2),
p AS (SELECT n.user_id, n.event_id AS a, min(sl.b) AS b FROM n LEFT JOIN sl ON sl.user_id = n.user_id AND sl.t0 <= (n.t0 + n.t1) / 2 AND (n.t0 + n.t1) / 2 < sl.t1 GROUP BY ALL)
SELECT user_id, a, j, CASE WHEN b IS NULL THEN 0 ELSE (b * 3 + j) % 5 + 1 END::DOUBLE AS s FROM p, (SELECT unnest([0, 1, 2])::BIGINT AS j)"""),
    "position_floors": (position_floors, """
SELECT label AS pair, vec_id AS i, least(((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 12) // count(*) OVER (PARTITION BY label), 11) AS floor FROM embeddings"""),
    "decoder_table": (decoder_table, f"""
WITH {MATRIX}, two AS (SELECT 'plain' AS matrix, pair, i, j, s FROM matrix UNION ALL SELECT 'squared', pair, i, j, round(s * s, 6) FROM matrix),
path AS (SELECT matrix, pair, i, j, s FROM two QUALIFY row_number() OVER (PARTITION BY matrix, pair, i ORDER BY s DESC, j) = 1),
paths AS (SELECT matrix, 'naive' AS decoder, pair, i, j FROM path UNION ALL SELECT matrix, 'abstain', pair, i, CASE WHEN s < 0.2 THEN -1 ELSE j END FROM path),
t AS (SELECT *, CASE WHEN i % 9 = 0 THEN -1 ELSE i % 12 END AS truth FROM paths), labels AS (SELECT matrix, decoder, pair, list(DISTINCT truth) AS l FROM t GROUP BY ALL),
c AS (SELECT t.matrix, t.decoder, t.pair, count(*) FILTER (WHERE j = truth) AS tp, count(*) FILTER (WHERE j <> truth AND list_contains(l, j)) AS fp, count(*) FILTER (WHERE j <> truth) AS fn FROM t JOIN labels b ON b.matrix = t.matrix AND b.decoder = t.decoder AND b.pair = t.pair WHERE truth <> -1 GROUP BY ALL)
SELECT matrix, decoder, round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1 FROM c GROUP BY ALL"""),
    "lecture_wins": (lecture_wins, f"""
WITH {_SCORES} SELECT count(*) AS n, count(*) FILTER (WHERE a.value > b.value) AS wins, count(*) FILTER (WHERE a.value = b.value) AS ties, round(avg(a.value - b.value), 6) AS diff FROM scores a JOIN scores b USING (lecture) WHERE a.setting = '1-URGENT' AND b.setting = '5-LOW'"""),
    "signed_ranks": (signed_ranks, """
WITH d AS (SELECT floor(value * 10)::BIGINT % 41 - 17 AS x FROM events), r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2 AS r FROM d WHERE x <> 0)
SELECT count(*) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END)::DOUBLE AS plus, sum(CASE WHEN x < 0 THEN r ELSE 0 END)::DOUBLE AS minus FROM r"""),
    "gate_granularity": (gate_granularity, """
WITH z AS (SELECT o_custkey AS lecture, substr(o_orderpriority, 1, 1) AS g, round(avg(o_totalprice) / 1e4, 4) AS z FROM orders GROUP BY ALL)
SELECT lecture, max(z) FILTER (WHERE g = '1') AS z1, max(z) FILTER (WHERE g = '2') AS z2, max(z) FILTER (WHERE g = '3') AS z3 FROM z GROUP BY lecture"""),
    "answer_table": (answer_table, f"""
WITH {_ANSWERS}, b AS (SELECT * FROM answers UNION ALL SELECT 'overall', mode, rep, refused, f1, sim FROM answers),
r AS (SELECT level, mode, rep, avg(f1) AS f1, avg(sim) AS sim, count(*) FILTER (WHERE rep = 0) AS n, count(*) FILTER (WHERE rep = 0 AND refused) AS k FROM b GROUP BY ALL)
SELECT level, mode, max(n) AS n, round(avg(f1), 6) AS f1, round(stddev_pop(f1), 6) AS f1_std, round(avg(sim), 6) AS sim, round(stddev_pop(sim), 6) AS sim_std, max(k) AS refusals FROM r GROUP BY ALL"""),
    "share_reached": (share_reached, f"WITH {_ANSWERS} SELECT level, round(avg(f1) FILTER (WHERE mode = 'closed') / avg(f1) FILTER (WHERE mode = 'open'), 6) AS share FROM answers GROUP BY level"),
    "echo_floor": (echo_floor, f"""
WITH {IN_TURN}, q AS (SELECT lang AS level, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS r FROM in_turn),
f AS (SELECT level, CASE WHEN len(list_intersect(p, r)) > 0 THEN 2 * len(list_intersect(p, r)) / (len(p) + len(r)) ELSE 0 END AS f FROM q), b AS (SELECT * FROM f UNION ALL SELECT 'overall', f FROM f)
SELECT level, count(*) AS n, round(avg(f), 6) AS f1 FROM b GROUP BY level"""),
    "greedy_pairs": (greedy_pairs, None),
    "timed_context": (timed_context, f"""
WITH {SPANS}, q AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN min(t0) + 20000 END AS low, min(t0) + 800000 AS high FROM spans GROUP BY user_id),
top AS (SELECT user_id, event_id, t0, t1, round((event_id % 89) / 88, 6) AS score FROM spans QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round((event_id % 89) / 88, 6) DESC, event_id) <= 30),
ins AS (SELECT top.* FROM top JOIN q USING (user_id) WHERE score > 0.3 AND (low IS NULL OR (t0 <= high + 30 AND t1 >= low - 30))),
f AS (SELECT *, coalesce((t0 - lag(t1) OVER (PARTITION BY user_id ORDER BY t0, event_id) >= 9000)::INT, 1) AS fresh FROM ins), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f),
r AS (SELECT user_id, g, max(score) AS score, min(t0) AS a, max(t1) AS b, string_agg('e' || event_id, ',' ORDER BY t0, event_id) AS ids FROM g GROUP BY user_id, g),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, a) <= 4)
SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY a) AS nth, ids, a AS start_s, b AS end_s, score FROM k"""),
    "scaled_scores": (scaled_scores, """
WITH r AS (SELECT user_id AS qid, event_id AS id, CASE WHEN user_id % 5 = 0 THEN 2.0 WHEN user_id % 7 <> 0 OR event_id % 50 <> 0 THEN value END::DOUBLE AS s FROM events)
SELECT qid, id, round(CASE WHEN count(s) OVER w = count(*) OVER w THEN CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1.0 END END, 6) AS score FROM r WINDOW w AS (PARTITION BY qid)"""),
    "unit_vectors": (unit_vectors, """
WITH v AS (SELECT vec_id, vec_id // 10 AS qid, (vec_id // 10) % 4 = 0 AND vec_id % 10 = 3 AS lost, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT qid, bool_or(lost) AS broken FROM v GROUP BY qid)
SELECT v.qid, CASE WHEN lost THEN 'none' ELSE 'v' || vec_id END AS id, CASE WHEN NOT broken THEN round(e[1] / sqrt(list_dot_product(e, e)), 5) END AS first, CASE WHEN NOT broken THEN round(e[64] / sqrt(list_dot_product(e, e)), 5) END AS last FROM v JOIN k ON k.qid = v.qid"""),
    "build_paths": (build_paths, None),
    "decoded_windows": (decoded_windows, f"""
WITH {MATRIX}, p AS (SELECT pair, i, CASE WHEN s < 0.2 THEN -1 ELSE j END AS j FROM matrix QUALIFY row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) = 1)
SELECT pair, i * 3 + k AS sentence, j FROM p, (SELECT unnest([0, 1, 2]) AS k)"""),
    "fixed_windows": (fixed_windows, f"""
WITH RECURSIVE {SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS nth FROM spans),
w AS (SELECT user_id, nth, t0, t1, 0::BIGINT AS bucket, t0 AS anchor FROM n WHERE nth = 1
  UNION ALL SELECT n.user_id, n.nth, n.t0, n.t1, w.bucket + (w.t1 - w.anchor >= 90000)::INT, CASE WHEN w.t1 - w.anchor >= 90000 THEN n.t0 ELSE w.anchor END FROM w JOIN n ON n.user_id = w.user_id AND n.nth = w.nth + 1)
SELECT user_id, bucket, count(*) AS n, min(t0) AS start, max(t1) AS "end" FROM w GROUP BY user_id, bucket"""),
    "page_builds": (page_builds, None),
    "changed_frames": (changed_frames, """
WITH RECURSIVE n AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings),
w AS (SELECT label, vec_id, nth, e AS last, 1::BIGINT AS kept FROM n WHERE nth = 1
  UNION ALL SELECT n.label, n.vec_id, n.nth, CASE WHEN list_avg(list_transform(range(1, 65), lambda k: abs(n.e[k] - w.last[k]))) > 0.13 THEN n.e ELSE w.last END, (list_avg(list_transform(range(1, 65), lambda k: abs(n.e[k] - w.last[k]))) > 0.13)::BIGINT FROM w JOIN n ON n.label = w.label AND n.nth = w.nth + 1)
SELECT label, vec_id, kept FROM w"""),
    "sampled_ticks": (sampled_ticks, f"""
WITH RECURSIVE {SPANS}, n AS (SELECT user_id, t0, row_number() OVER (PARTITION BY user_id ORDER BY t0) AS nth FROM spans),
w AS (SELECT user_id, nth, t0 + 50000 AS due, 1::BIGINT AS kept FROM n WHERE nth = 1
  UNION ALL SELECT n.user_id, n.nth, CASE WHEN n.t0 + 1e-9 >= w.due THEN w.due + 50000 ELSE w.due END, (n.t0 + 1e-9 >= w.due)::BIGINT FROM w JOIN n ON n.user_id = w.user_id AND n.nth = w.nth + 1)
SELECT user_id, sum(kept)::BIGINT AS kept, count(*) AS n FROM w GROUP BY user_id"""),
    "systematic_sample": (systematic_sample, f"""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS t FROM events),
k AS (SELECT u.user_id, u.t, k, round_even(k * t / 7, 0)::BIGINT AS low, round_even((k + 1) * t / 7, 0)::BIGINT AS high FROM (SELECT DISTINCT user_id, t FROM r) u, (SELECT unnest(range(0, 7)) AS k)),
d AS (SELECT user_id, low + floor({_DRAW.format("'s:' || user_id || ':' || k")} * (high - low))::BIGINT AS pick FROM k)
SELECT DISTINCT r.user_id, event_id FROM r LEFT JOIN d ON d.user_id = r.user_id AND d.pick = r.p WHERE t <= 7 OR d.pick IS NOT NULL"""),
    "topped_up_sample": (topped_up_sample, f"""
WITH r AS (SELECT source || ':' || doc_id AS id, source FROM documents),
few AS (SELECT id, source FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format("'5:' || source || ':' || id")}, id) <= greatest(1, round_even(0.02 * count(*) OVER (PARTITION BY source), 0))),
x AS (SELECT * FROM few UNION ALL SELECT * FROM (SELECT id, source FROM r WHERE starts_with(id, 'src1:') AND id NOT IN (SELECT id FROM few) QUALIFY row_number() OVER (ORDER BY {_DRAW.format("'9:src1::' || id")}, id) <= 6 - (SELECT count(*) FROM few WHERE starts_with(id, 'src1:'))))
SELECT * FROM x UNION ALL SELECT * FROM (SELECT id, source FROM r WHERE starts_with(id, 'src3:') AND id NOT IN (SELECT id FROM few) QUALIFY row_number() OVER (ORDER BY {_DRAW.format("'9:src3::' || id")}, id) <= 6 - (SELECT count(*) FROM few WHERE starts_with(id, 'src3:')))"""),
    "seeded_halves": (seeded_halves, f"""
SELECT s_suppkey AS key, CASE WHEN row_number() OVER (ORDER BY {_DRAW.format("'4:' || s_suppkey")}, s_suppkey) <= count(*) OVER () // 2 THEN 'tune' ELSE 'test' END AS part FROM supplier"""),
    "paired_differences": (paired_differences, """
WITH m AS (SELECT event_id % 150 AS qid, event_id % 150 % 7 AS topic, avg(value) FILTER (WHERE (event_id // 150) % 3 = 0) AS a, avg(value) FILTER (WHERE (event_id // 150) % 3 = 1) AS b FROM events GROUP BY ALL)
SELECT qid, topic, round(a - b, 6) AS diff FROM m WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "tolerant_accuracy": (tolerant_accuracy, """
SELECT k::INT AS tolerance, round(avg((least(abs(event_id % 12 - event_id % 7), abs(event_id % 12 - event_id % 11)) <= k)::INT), 6) AS accuracy, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY k"""),
    "type_buckets": (type_buckets, """
SELECT 'cross_modal' AS bucket, count(*) AS n FROM events WHERE event_id % 4 < 2 UNION ALL SELECT 'deictic', count(*) FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'single_modality', count(*) FROM events WHERE event_id % 4 = 2"""),
    "audit_marks": (audit_marks, """
WITH x AS (SELECT event_type AS level, event_id % 4 AS gold, [(event_id * 3) % 11 + 1, (event_id * 4) % 11 + 1, (event_id * 5) % 11 + 1, (event_id * 6) % 11 + 1] AS l FROM events)
SELECT level, round(avg((gold = 0)::INT), 6) AS "share_A", round(avg((gold = 1)::INT), 6) AS "share_B", round(avg((gold = 2)::INT), 6) AS "share_C", round(avg((gold = 3)::INT), 6) AS "share_D",
       round(avg(CASE WHEN len(list_filter(l, lambda v: v = list_max(l))) = 1 THEN (list_position(l, list_max(l)) = gold + 1)::INT END), 6) AS longest, count(*) AS n FROM x GROUP BY level"""),
    "confident_rates": (confident_rates, f"WITH {MATRIX}, r AS (SELECT pair, i, list(s ORDER BY s DESC) AS l FROM matrix GROUP BY ALL) SELECT pair, round(avg((l[1] - l[2] > 0.05)::INT), 6) AS rate FROM r GROUP BY pair"),
    "temporal_links": (temporal_links, f"""
WITH {SPANS} SELECT 'a' || a.event_id AS src_id, 'f' || b.event_id AS dst_id, 'audio_slide' AS link_type, round(least(1.0, (least(a.t1, b.t1 + 6000) - greatest(a.t0, b.t0 + 5000)) / greatest(1.0, b.t1 + 6000 - b.t0 - 5000)), 4) AS score
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.t0 < b.t1 + 6000 AND a.t1 > b.t0 + 5000"""),
    "aligned_links": (aligned_links, f"""
WITH {MATRIX}, p AS (SELECT pair, i, j, s FROM matrix QUALIFY row_number() OVER (PARTITION BY pair, i ORDER BY s DESC, j) = 1)
SELECT 'a' || pair || '_' || i AS src_id, 's' || pair || '_' || j AS dst_id, 'audio_slide' AS link_type, s AS score FROM p WHERE pair % 3 <> 0 AND s >= 0.2"""),
    "shown_slides": (shown_slides, f"""
WITH {EDGES}, m AS (SELECT src_id AS id, max(substr(dst_id, 2)::BIGINT) AS page FROM edges WHERE link_type = 'audio_slide' GROUP BY src_id) SELECT id, p_brand AS deck, page FROM m JOIN part ON p_partkey = page"""),
    "deictic_pairs": (deictic_pairs, f"WITH {_POINTING} SELECT src_id, dst_id, score, cues, tier FROM pairs"),
    "tier_breakdown": (tier_breakdown, f"WITH {_POINTING} SELECT tier, count(*) AS n, round(avg(score), 6) AS mean FROM pairs GROUP BY tier"),
    "document_gates": (document_gates, """
WITH f AS (SELECT 'd' || label AS src_file, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE label % 2 = 0), t AS (SELECT 'd' || label AS dst_file, embedding::DOUBLE[] AS e FROM embeddings WHERE label % 2 = 1),
n AS (SELECT dst_file, -1 AS k, e AS y FROM t UNION ALL SELECT dst_file, 0, list_concat(e[2:], e[1:1]) FROM t UNION ALL SELECT dst_file, 1, list_concat(e[9:], e[1:8]) FROM t UNION ALL SELECT dst_file, 2, list_concat(e[16:], e[1:15]) FROM t),
b AS (SELECT src_file, dst_file, k, vec_id, max(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))) AS best FROM f, n GROUP BY ALL),
s AS (SELECT src_file, dst_file, k, avg(best) AS v FROM b GROUP BY ALL),
g AS (SELECT src_file, dst_file, max(v) FILTER (WHERE k < 0) AS v, avg(v) FILTER (WHERE k >= 0) AS m, stddev_pop(v) FILTER (WHERE k >= 0) AS d FROM s GROUP BY ALL)
SELECT src_file, dst_file, round((v - m) / d, 4) AS z, (v - m) / d >= 1.27 AS related FROM g"""),
    "pair_gates": (pair_gates, f"WITH {_PAIRED} SELECT file_a, file_b, max(round(score * 4 - 2, 4)) AS z, bool_or(score > 0.59) AS related FROM paired GROUP BY ALL"),
    "pair_rows": (pair_rows, f"""
WITH {_PAIRED}, p AS (SELECT file_a, file_b, length(file_a) + length(file_b) AS k, count(*) FILTER (WHERE score >= 0.58) AS n FROM paired GROUP BY ALL),
g AS (SELECT *, CASE WHEN k % 4 <> 0 THEN round((k % 7) / 2 - 1, 2) END AS z, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'related' ELSE 'unrelated' END ELSE 'auto' END AS setting FROM p)
SELECT file_a, file_b, z, CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'related' ELSE 'unrelated' END END AS gate, setting, n AS links,
       CASE WHEN setting = 'auto' AND n > 0 AND z IS NOT NULL AND k % 5 < 3 AND z < 1.2 THEN 'unsure' WHEN n > 0 THEN 'linked' ELSE 'unlinked' END AS state FROM g WHERE n > 0 OR z IS NOT NULL OR setting <> 'auto'"""),
    "judged_links": (judged_links, f"""
WITH {EDGES}, d AS (SELECT DISTINCT * FROM edges), v AS (SELECT *, CASE WHEN substr(dst_id, 2)::BIGINT % 3 <> 0 THEN (substr(dst_id, 2)::BIGINT + 1) % 2 = 0 END AS passed FROM d)
SELECT link_type, passed, count(*) AS n FROM v WHERE passed IS NULL OR passed GROUP BY ALL"""),
    "expansion_reasons": (expansion_reasons, None),
    "control_counts": (control_counts, f"""
WITH {EDGES}, c AS (SELECT t.link_type, count(e.src_id) AS total, count(*) FILTER (WHERE e.score <= 0.55) AS cross_file FROM (SELECT unnest(['audio_slide', 'figure_text', 'deictic', 'same_slide']) AS link_type) t LEFT JOIN edges e USING (link_type) GROUP BY ALL)
SELECT * FROM c UNION ALL SELECT 'all', sum(total)::BIGINT, sum(cross_file)::BIGINT FROM c"""),
    "gate_rejections": (gate_rejections, """
WITH g AS (SELECT round(value / 10, 4) AS z FROM events)
SELECT count(*) AS n, count(*) FILTER (WHERE NOT z >= 1.27) AS rejected, round(count(*) FILTER (WHERE NOT z >= 1.27) / count(*), 6) AS share, min(z) AS low, round(median(z), 6) AS middle, max(z) AS high FROM g"""),
    "label_crosstab": (label_crosstab, """
SELECT doc_id % 5 AS "group", count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS good, count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS poor, count(*) FILTER (WHERE toxic = 1) AS bad, count(*) AS n FROM labels GROUP BY ALL"""),
    "status_coverage": (status_coverage, """
WITH s AS (SELECT DISTINCT event_id % 140 AS v FROM events WHERE event_id % 13 = 0), i AS (SELECT unnest(range(1, 101)) AS v)
SELECT CASE WHEN s.v IS NULL THEN 'missing' WHEN i.v % 3 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM i LEFT JOIN s USING (v) GROUP BY ALL"""),
    "deck_pages": (deck_pages, f"""
WITH {CORPUS}, d AS (SELECT *, CASE WHEN pos % 5 = 0 THEN ' ' ELSE substr(content, 1, 25) END AS t FROM corpus WHERE deck AND page IS NOT NULL), p AS (SELECT DISTINCT file, page FROM d), f AS (SELECT file, page, arg_min(t, pos) AS t FROM d WHERE modality = 'text' GROUP BY ALL)
SELECT p.file, p.page, md5(CASE WHEN trim(coalesce(f.t, ''), ' ') <> '' THEN f.t WHEN p.page % 4 <> 0 THEN 'read ' || p.page ELSE '(page ' || p.page || ')' END) AS text_md5 FROM p LEFT JOIN f ON f.file = p.file AND f.page = p.page"""),
}
