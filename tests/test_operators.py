"""Joins, graphs, links, evidence, accounts, readers and writers on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import stats as S
from lumenspan.functions import text as T
from lumenspan.operators import evaluation, evidence, graph, intervals, ledger, links, ranking, sampling, units
from lumenspan.sources import readers, sinks


def one(spark, expression, **columns):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", bool: "boolean"}
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    return row.select(expression.alias("x")).first().x


def test_scalars(spark):
    c = F.col("t")
    assert one(spark, T.split_sentences(c, min_words=2), t="One two. Three four! five six? Seven eight") == ["One two.", "Three four! five six?", "Seven eight"]
    assert one(spark, T.premises(c), t="See e.g. the plot. Then go.") == ["See e.g. the plot.", "Then go."]
    assert one(spark, T.facts(c), t="It rains; the street is wet. Yes.") == ["It rains", "the street is wet."]
    assert one(spark, T.span_in_text(F.lit("the cat ... the mat"), c), t="The cat sat on THE mat!")
    assert not one(spark, T.span_in_text(F.lit("the mat ... the cat"), c), t="The cat sat on the mat")
    assert not one(spark, T.span_in_text(F.lit("..."), c), t="anything")
    assert one(spark, T.cited_ids(c), t="as [b:1] and [a.2], [b:1]") == ["b:1", "a.2"]
    assert one(spark, T.clean_query(c), t='query: "what is it"\nmore') == "what is it"
    assert one(spark, T.strict_seconds(c), t="1:02:03") == 3723.0
    assert one(spark, T.strict_seconds(c), t="1:75") is None
    assert one(spark, T.parse_mmss(c), t="2:30") == 150.0
    assert one(spark, T.mcq_choice(c, F.array(F.lit("yes"), F.lit("no"))), t="B) no") == 1
    assert one(spark, T.mcq_choice(c, F.array(F.lit("yes"), F.lit("no"))), t="No") == 1
    assert one(spark, T.longest_option(F.array(F.lit("a"), F.lit("abc"), F.lit("ab"))), t="") == "B"
    assert one(spark, T.tier_of(F.lit("this"), c), t="this shows the graph") == 2
    assert one(spark, T.tier_of(F.lit("this"), c), t="this is so") == 3
    assert one(spark, T.host(c), t="https://www.example.com:80/x") == "www.example.com"
    assert one(spark, T.shared_context(c, 3), t="context\n\nQuestion: why") == ("context", "\n\nQuestion: why")
    with pytest.raises(Exception, match="unknown link type"):
        one(spark, T.checked_link_type(c), t="other")


def test_answers(spark):
    reply = 'ok {"answer": "a", "claims": [{"text": "x", "units": ["u1"]}, {"text": " "}]} end'
    got = one(spark, T.answer_claims(F.col("t")), t=reply)
    assert got.answer == "a" and [c.text for c in got.claims] == ["x"]
    assert one(spark, T.answer_claims(F.col("t")), t='{"claims": []}') is None


def test_bleu_and_wilson(spark):
    words = F.split(F.col("t"), " ")
    assert one(spark, S.bleu4(words, words), t="a b c d e") == pytest.approx(1.0)
    assert one(spark, S.bleu4(words, F.split(F.lit("a b c x e"), " ")), t="a b c d e") == 0.0
    w = one(spark, S.wilson(F.col("k"), F.col("n")), k=0, n=0)
    assert (w.low, w.high) == (0.0, 1.0)


def test_windows_drop_a_tail_of_overlap(spark):
    n = lambda k: [len(w.words) for w in one(spark, units.word_windows(T.words(F.col("t"))), t=" ".join(["w"] * k))]
    assert n(225) == [225] and n(226) == [225, 46] and n(180) == [180] and n(405) == [225, 225] and n(1) == [1]


LINKS = [("a1", "s5", "audio_slide", 0.9), ("a1", "f5", "deictic", 0.7), ("f5", "s9", "figure_text", 0.55)]


def test_graph(spark):
    e = spark.createDataFrame(LINKS, "src_id string, dst_id string, link_type string, score double")
    near = sorted((r.neighbour, r.score) for r in graph.neighbours(e).where("id = 'f5'").collect())
    assert near == [("a1", 0.7), ("s9", 0.55)]
    u = spark.createDataFrame([(x,) for x in ("a1", "s5", "f5", "s9")], "id string")
    seeds = spark.createDataFrame([(1, "a1", 0.4), (1, "s5", 0.2)], "qid long, id string, score double")
    got = {r.id: r for r in graph.expand(seeds, graph.neighbours(e), u, hops=2, normalise=False).collect()}
    assert got["s5"].origin == "seed" and got["s5"].score == 0.2
    assert got["f5"].score == pytest.approx(0.4 * 0.7 * 0.5) and got["f5"].via_seed == "a1"
    assert got["s9"].score == pytest.approx(0.14 * 0.55 * 0.5)
    kept, dropped = graph.checked(e, u.where("id != 's9'"))
    assert (kept.count(), dropped.count()) == (2, 1)
    nodes, inside = graph.ego(e, spark.createDataFrame([("a1",)], "root string"), 1)
    assert {r.id for r in nodes.collect()} == {"a1", "s5", "f5"} and inside.count() == 2
    lines = [r.value for r in sinks.graphml(u, e).orderBy("part", "value").collect()]
    assert lines[0] == '<node id="a1"></node>' and len(lines) == 7


def test_retrieval_finds_what_only_links_reach(spark):
    """A unit that shares no word with the question is found over its link."""
    from lumenspan.plans import retrieval

    texts = ["the recording speaks of gradients here"] + [f"noise {i} about things" for i in range(11)] + ["zzz yyy"]
    rows = [(i, f"u{i}", "audio" if i == 0 else "text", t, "f", None) for i, t in enumerate(texts)]
    u = spark.createDataFrame(rows, units.UNITS)
    u = u.join(ranking.hash_bag(u), "pos")
    e = spark.createDataFrame([("u0", "u12", "audio_slide", 0.9)], "src_id string, dst_id string, link_type string, score double")
    q = spark.createDataFrame([(1, "gradients in the recording")], "qid long, text string")
    q = q.join(ranking.hash_bag(q, "qid", "text"), "qid")
    corpus, s = retrieval.Corpus(u, e), retrieval.Settings(top_k=5)
    plain = [r.id for r in corpus.chosen("baseline", "none", q, s).collect()]
    linked = [r.id for r in corpus.chosen("linked", "none", q, s).collect()]
    assert "u0" in plain and "u12" not in plain and "u12" in linked
    asked = []

    def propose(questions, found):
        asked.append(found.count())
        new = questions.select("qid", F.lit("zzz yyy").alias("text"))
        return new.join(ranking.hash_bag(new, "qid", "text"), "qid")

    rounds = corpus.pool("iterative", q, s, propose)
    assert asked == [5] and "u12" in {r.id for r in rounds.collect()}
    with pytest.raises(ValueError):
        corpus.pool("other", q)


def test_figure_text_and_same_slide(spark):
    def unit(pos, name, modality, content, file, page, bbox):
        return (pos, name, modality, content, file, (page, bbox, None, None), [1.0, 0.0])

    schema = units.UNITS + ", embedding array<double>"
    figures = spark.createDataFrame([unit(0, "f1", "figure", "Figure 1: heat map", "d.pdf", 2, [0.0, 200.0, 100.0, 300.0])], schema)
    texts = spark.createDataFrame([
        unit(1, "t1", "text", "As Figure 1 shows, heat", "d.pdf", 2, [0.0, 0.0, 100.0, 100.0]), unit(2, "t2", "text", "see the diagram below", "d.pdf", 2, [0.0, 0.0, 100.0, 180.0]),
        unit(3, "t3", "text", "As Table 1 shows", "d.pdf", 9, None), unit(4, "t4", "text", "Figure 1 again", "e.pdf", 3, None),
    ], schema)
    scores = {r.dst_id: r for r in links.figure_text_scores(figures, texts).collect()}
    assert scores["t1"].why.reference == "figure 1" and scores["t1"].why.layout_gap_pt == 100.0
    assert scores["t2"].why.descriptive == "the diagram below" and scores["t2"].why.reference is None
    assert scores["t3"].why.reference is None and scores["t4"].why.reference == "figure 1"
    kept = links.figure_text(links.figure_text_scores(figures, texts), 0.5, most=2)
    assert [r.dst_id for r in kept.orderBy(F.desc("score")).collect()][0] == "t1"
    assert {r.dst_id for r in links.same_slide(figures, texts).collect()} == {"t1", "t2"}
    assert links.same_slide(figures, texts, enabled=False).count() == 0


def test_cues(spark):
    said = "so this arrow here shows it. As you can see, that is all.".split()
    rows = [("a", [(i * 0.5, i * 0.5 + 0.5, w) for i, w in enumerate(said)])]
    got = links.cues(spark.createDataFrame(rows, "id string, words array<struct<start:double,end:double,text:string>>")).orderBy("nth").collect()
    assert [(r.cue, r.tier, r.start_s) for r in got] == [("this arrow here", 1, 0.5), ("as you can see", 1, 3.0), ("that", 2, 5.0)]
    assert got[0].sentence == "so this arrow here shows it." and got[2].sentence == "As you can see, that is all."


def test_points_and_overlaps(spark):
    a = spark.createDataFrame([("g", 1, 0.0, 10.0), ("g", 2, 95.0, 130.0), ("g", 3, None, 5.0)], "k string, a long, a0 double, a1 double")
    b = spark.createDataFrame([("g", 7, 5.0, 100.0), ("g", 8, 100.0, 120.0), ("g", 9, 10.0, 10.0)], "k string, b long, b0 double, b1 double")
    pairs = sorted((r.a, r.b) for r in intervals.overlap_join(a, b, ["k"], 10.0).collect())
    assert pairs == [(1, 7), (2, 7), (2, 8)]
    assert sorted((r.a, r.b) for r in intervals.overlap_join(a, b, ["k"], 10.0, closed=True).collect()) == [(1, 7), (1, 9), (2, 7), (2, 8)]
    best = {r.a: r.b for r in intervals.greatest_overlap(a, b, ["k"], 10.0).collect()}
    assert best == {1: 7, 2: 8}
    assert {r.a: r.b for r in intervals.greatest_overlap(a, b, ["k"], 10.0, later=False).collect()} == {1: 7, 2: 8}


def test_evidence(spark):
    votes = spark.createDataFrame([("c1", "u1", 0, r, v, "the cat", "The cat sat") for r, v in enumerate(("yes", "yes", "no"))] + [("c2", "u1", 0, r, "yes", "a dog", "The cat sat") for r in range(3)], "claim string, id string, pos long, run long, verdict string, span string, content string")
    supported = evidence.unit_votes(votes)
    claims = spark.createDataFrame([(1, "c1", ["u1"]), (1, "c2", ["u1"]), (1, "c3", [])], "qid long, claim string, cited array<string>")
    got = {r.claim: r.verdict for r in evidence.claim_verdicts(claims, supported).collect()}
    assert got == {"c1": "supported", "c2": "unsupported", "c3": "weak"}
    report = evidence.answer_report(evidence.claim_verdicts(claims, supported)).first()
    assert report.rate == pytest.approx(1 / 3)
    flags = spark.createDataFrame([("cross_modal", False, False, False, True), ("x", True, False, False, True), ("x", False, False, False, False)], "o string, a boolean, d boolean, p boolean, t boolean")
    kinds = [r.x.type for r in flags.select(evidence.relabelled(*(F.col(c) for c in "oadpt")).alias("x")).collect()]
    assert kinds == ["cross_modal", "audio_only", None]


def test_bootstrap_and_threshold(spark):
    rows = spark.createDataFrame([(f"c{i % 6}", float(i % 2)) for i in range(60)], "c string, v double")
    r = evaluation.cluster_bootstrap(rows, "c", "v", draws=500).first()
    assert r.mean == 0.5 and r.low < 0.5 < r.high and r.n == 60
    scores = spark.createDataFrame([(z / 10, z >= 15) for z in range(30)], "z double, related boolean")
    t = evaluation.false_accept_threshold(scores).first()
    assert t.threshold == 1.5 and t.accepts == 0.0


def test_samples_are_repeatable(spark):
    d = spark.range(300).selectExpr("id AS i", "cast(id % 3 as string) AS g")
    w = d.withColumn("p", (F.col("i") / 3).cast("long"))
    got = sampling.systematic(w, "g", "p", 7)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"0": 7, "1": 7, "2": 7}
    assert got.orderBy("i").collect() == sampling.systematic(w, "g", "p", 7).orderBy("i").collect()
    k = d.withColumn("k", F.concat("g", F.lit(":"), "i"))
    topped = sampling.topped_up(sampling.stratified(k, "g", "k", 0.01, 2, "s"), k, "k", ["1:"], 9, "s")
    assert topped.where("g = '1'").count() == 9 and topped.where("g = '0'").count() == 2
    shuffled = one(spark, sampling.shuffled_options(F.split(F.col("t"), " "), F.lit(2), F.col("t")), t="a b c d")
    assert sorted(shuffled.options) == ["a", "b", "c", "d"] and shuffled.options[shuffled.gold] == "c"


def test_manifest_hash():
    a = {"files": [1], "created_utc": "x", "hash": "y"}
    assert ledger.manifest_hash(a) == ledger.manifest_hash({"files": [1]}) and len(ledger.manifest_hash(a)) == 16
    assert ledger.manifest_warning("a", "a") is None and ledger.manifest_warning(None, "a") and ledger.manifest_warning("a", "b")


def test_files_and_errors(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.xyz").write_text("?")
    got = {r.name: r for r in readers.parsed(readers.files(spark, f"{tmp_path}/*"), {"docx": readers.docx_units}).collect()}
    assert got["a.docx"].error is None and got["a.docx"].units[0].content == "one two three"
    assert got["b.docx"].units == [] and "BadZipFile" in got["b.docx"].error
    assert "no reader" in got["c.xyz"].error


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.frozen.json").write_text(json.dumps({"audio": "t.mp3", "words": [[0.0, 0.5, "hi"], [0.5, 1.0, "you"]]}))
    assert [(r.nth, r.text, r.end) for r in readers.transcripts(spark, str(tmp_path / "t.frozen.json")).orderBy("nth").collect()] == [(0, "hi", 0.5), (1, "you", 1.0)]
    (tmp_path / "l.csv").write_text("segment_id,start,end,true_slide,also_correct\ns1,0,5,3,4;5\ns2,5,9,none,\n")
    a, b = readers.alignment_labels(spark, str(tmp_path / "l.csv")).orderBy("segment_id").collect()
    assert a.accept == [3, 4, 5] and b.accept is None
    (tmp_path / "w.srt").write_text("[0:00:01.0 --> 0:00:01.5] he\n[0:00:01.5 --> 0:00:02.0]llo\n[0:00:02.0 --> 0:00:03.0] you\n")
    assert [(r.text, r.start, r.end) for r in readers.word_srt(spark, str(tmp_path / "w.srt")).collect()] == [("hello", 1.0, 2.0), ("you", 2.0, 3.0)]
    (tmp_path / "q.json").write_text(json.dumps({"v1": [{"question": "q", "answer": "a", "level": "level_1"}]}))
    assert readers.question_maps(spark, str(tmp_path / "q.json"), "open").first().level == "level 1"
    (tmp_path / "tl.csv").write_text("slide,start,end,note\n1,0:00,0:30,\noutro,0:30,1:00,\n2,,,x\n")
    assert [r.outro for r in readers.slide_timeline(spark, str(tmp_path / "tl.csv")).orderBy("start").collect()] == [False, True]


def test_links_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(*x[:3], x[3] + 1e-9) for x in LINKS], "src_id string, dst_id string, link_type string, score double")
    sinks.links(e, str(tmp_path / "links"), "abc")
    back = readers.links(spark, str(tmp_path / "links"), "abc")
    assert sorted((r.src_id, r.dst_id, r.link_type, r.score) for r in back.collect()) == sorted(LINKS)
    with pytest.raises(ValueError, match="manifest"):
        readers.links(spark, str(tmp_path / "links"), "other")


def test_streams(spark, tmp_path):
    from lumenspan import streaming

    src = tmp_path / "in"
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 20) AS ts, 'm' AS model, id AS tokens, id % 2 AS user_id FROM range(12)").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, model string, tokens long, user_id long").parquet(str(src))
    for name, frame in (("w", streaming.usage_windows(stream)), ("s", streaming.sessions(stream, "30 seconds"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.requests, r.tokens) for r in spark.table("w").collect()) == [(3, 3), (3, 12), (3, 21), (3, 30)]
