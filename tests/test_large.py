"""Operators that were mended for large tables: the same results as by trying everything, with little that is passed on."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenspan.functions import stats as S
from lumenspan.functions import text as T
from lumenspan.operators import evidence, studies, tiles


def vectors(n, seed, ties=4):
    """Vectors of which many are the same."""
    r = np.random.default_rng(seed)
    rows = np.round(r.normal(size=(max(1, n // ties), 6)), 1)[r.integers(0, max(1, n // ties), n)]
    return rows.tolist()


def test_closest_pairs_in_tiles(spark, monkeypatch):
    """The walk over all pairs and the one over what tiles pass on choose the same, with equal scores and blocks of a few rows."""
    monkeypatch.setattr(tiles, "CELLS", 64)
    monkeypatch.setattr(tiles.tiled, "__defaults__", (7, ([], [])))
    a = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(vectors(60, 1))], "g int, a long, x array<double>")
    b = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(vectors(50, 2))], "g int, b long, y array<double>")
    for most in (1, 3, 8):
        pairs = a.join(b, "g").select("g", "a", "b", F.round(S.dot(F.col("x"), F.col("y")), 6).alias("score"))
        expected = sorted(map(tuple, studies.greedy_pairs(pairs, "g", 0.1, most).collect()))
        assert sorted(map(tuple, studies.closest_pairs(a, b, "g", 0.1, most).collect())) == expected and len(expected) == 2 * most


def test_walkable_is_few():
    r = random.Random(3)
    a, b = (np.array([r.randrange(40) for _ in range(3000)]) for _ in range(2))
    score = np.array([r.randrange(5) / 5 for _ in range(3000)])
    assert len(studies.walkable(a, b, score, 4)) == 2 * 4 * 3 + 1


def test_premises_join_abbreviations(spark):
    """Sentences as by joining parts one by one, whatever abbreviations follow each other."""
    r = random.Random(5)
    words = ["One", "e.g.", "E.G.", "xe.g.", "No.", "no.", "end.", "Why?", "Dr.", "al.", "(cf.", "cf.", "fig.\t", "...", "!", "a"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 25))) for _ in range(200)] + ["", " ", "no.", "e.g. no. x"]
    for text, got in ((x.t, x.p) for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.premises(F.col("t")).alias("p")).collect()):
        out, waiting = [], None
        for part in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text).strip(" ")):
            part = part if waiting is None else f"{waiting} {part}"
            waiting = part if part.split(" ")[-1].lower() in T.ABBREVIATIONS else None
            out += [part] if waiting is None else []
        assert got == [s for s in [*out, waiting] if s], text


def test_quoted_from_all_meets_few_sentences(spark, monkeypatch):
    """Sentences of all units, in small parts, as by every question with every unit; no join on terms is left."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice([".", "", ""]) for _ in range(n))
    units = spark.createDataFrame([(i // 2, f"u{i}", text(r.randrange(60))) for i in range(80)] + [(0, "none", None)], "rank long, id string, content string")
    questions = spark.createDataFrame([(q, text(4)) for q in range(12)] + [(99, None), (98, "zzz")], "qid long, question string")
    cut = evidence._parts
    monkeypatch.setattr(evidence, "_parts", lambda batch, column, most: cut(batch, column, 3))
    got = evidence.quoted_from_all(units, questions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evidence.quoted_answers(units.crossJoin(questions.select("qid")), questions).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_document_gate_in_tiles(spark, monkeypatch):
    """Gates from tiles are those from all pairs, with a vector of no length too."""
    from lumenspan.operators import links

    monkeypatch.setattr(tiles, "CELLS", 64)
    rows = [(f"d{i % 3}", f"f{i}", v) for i, v in enumerate([*vectors(40, 3), [0.0] * 6])]
    figures = spark.createDataFrame(rows, "source_file string, id string, embedding array<double>")
    texts = spark.createDataFrame([(f"d{i % 4}", f"t{i}", v) for i, v in enumerate(vectors(30, 4))], "source_file string, id string, embedding array<double>")
    nulls = spark.createDataFrame([(f"d{i % 4}", k, v) for k in range(2) for i, v in enumerate(vectors(30, 5 + k))], "source_file string, shuffle int, embedding array<double>")
    cosine = lambda a, b: np.dot(a, b) / max(np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)), 1e-9)
    own = {(r.source_file, -1): [] for r in texts.collect()} | {(r.source_file, r.shuffle): [] for r in nulls.collect()}
    for r in texts.collect():
        own[r.source_file, -1].append(r.embedding)
    for r in nulls.collect():
        own[r.source_file, r.shuffle].append(r.embedding)
    for size in (7, 1 << 15):
        monkeypatch.setattr(links, "GATE_ROWS", size)
        got = {(r.src_file, r.dst_file): r.z for r in links.document_gate(figures, texts, nulls, 1.0).collect()}
        assert set(got) == {(f"d{a}", f"d{b}") for a in range(3) for b in range(4) if a != b}
        for (a, b), z in got.items():
            mean = {k: np.mean([max(cosine(x, y) for y in own[b, k]) for d, _, x in rows if d == a]) for k in (-1, 0, 1)}
            assert abs(z - (mean[-1] - (mean[0] + mean[1]) / 2) / np.std([mean[0], mean[1]])) < 1e-6


def test_first_fit_goes_through_few_batches():
    """Batches as by looking through all open ones; the time of many prompts grows with their number, not its square."""
    import time

    from lumenspan.operators import segments

    r = random.Random(11)
    for most, items, prompts in ((100, 3, None), (50, 2, "ab"), (10, 1, "a"), (7, 4, "abc")):
        sizes, told = [r.choice([0, 1, 5, 9, 30, 60, 120]) for _ in range(700)], [r.choice(prompts) if prompts else None for _ in range(700)]
        batches, expected = [], []
        for n, p in zip(sizes, told, strict=True):
            b = next((i for i, (held, q) in enumerate(batches) if q == p and sum(held) + n <= most and len(held) < items), len(batches))
            batches[b:b] = [([], p)] if b == len(batches) else []
            batches[b][0].append(n)
            expected.append(b)
        assert segments.fitted(sizes, told, most, items).tolist() == expected
    began = time.perf_counter()
    segments.fitted([11_000] * 200_000, [None] * 200_000, 20_000, 10)
    assert time.perf_counter() - began < 30


def _place(source=None, page=None, start=None, end=None):
    return (source, page, start, end)


def test_gold_places_by_equal_keys(spark):
    """Units at gold places as by every pair, without a nested or file-wide comparison; null keys and ends meet nothing."""
    from lumenspan.functions import places as P
    from lumenspan.operators import intervals

    r = random.Random(13)
    some = lambda x: x if r.random() < 0.9 else None
    location = lambda: (None, None, None, None) if r.random() < 0.05 else ((some(r.randrange(4)), None, None, None) if r.random() < 0.6 else (None, None, some(float(r.randrange(200))), some(float(r.randrange(200)))))
    kind = "struct<page:int,bbox:array<double>,start_s:double,end_s:double>"
    units = spark.createDataFrame([(some(r.randrange(3)), f"u{i}", r.choice(["in/a.pdf", "b.mp3"]), location()) for i in range(150)], f"qid int, id string, source_file string, location {kind}")
    gold = spark.createDataFrame([(some(r.randrange(4)), i, (r.choice(["a.pdf", "x/b.mp3", "c"]), *(p := location())[:1], *p[2:])) for i in range(120)], "qid int, n int, place struct<source:string,page:int,start_s:double,end_s:double>")
    match = P.matches_locator(F.col("u.source_file"), F.col("u.location"), F.col("g.place"))
    both = units.alias("u").crossJoin(gold.alias("g")).where(match)
    want = sorted(map(tuple, both.select("g.n", "u.id").collect()))
    pairs = intervals.gold_pairs(units, gold.withColumn("qid", F.col("n")))
    assert sorted(map(tuple, pairs.select("qid", "id").collect())) == want and len(want) > 100
    hit = {x.n for x in both.where("u.qid = g.qid").select("g.n").collect()}
    found, missed = intervals.gold_hits(units, gold)
    assert found.columns == missed.columns == gold.columns
    assert {x.n for x in found.collect()} == hit and sorted(x.n for x in missed.collect()) == sorted(set(range(120)) - hit)


def test_first_json_object_by_pieces(spark):
    """The object that a walk over all characters finds, of replies with any marks in any order."""
    r = random.Random(17)
    texts = ["".join(r.choice(['{', '}', '"', "\\", "a", " ", "\n", "é", "{}"]) for _ in range(r.randrange(1, 30))) for _ in range(600)] + ['{"a": "' + "x" * 100_000 + "\\n" * 50_000 + '"} b']

    def first(text):
        at = text.find("{")
        depth, quoted, escaped = 0, False, False
        for n, c in enumerate(text[at:] if at >= 0 else "", 1):
            depth += (c == "{") - (c == "}") if not quoted else 0
            quoted, escaped = (not quoted if c == '"' and not escaped else quoted), quoted and not escaped and c == "\\"
            if depth == 0:
                return text[at : at + n]
        return None

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.json_object(F.col("t")).alias("j")).collect()
    assert all(x.j == first(x.t) for x in got) and sum(x.j is not None for x in got) > 50


def test_boxes_merge_in_turn():
    from lumenspan.operators import regions

    r = random.Random(19)
    for _ in range(200):
        boxes = [[x, y, x + r.randint(1, 30), y + r.randint(1, 30)] for x, y in ((r.randint(0, 200), r.randint(0, 200)) for _ in range(r.randint(1, 25)))]
        assert sorted(regions.fused_in_turn([list(map(float, b)) for b in boxes], 5.0)) == sorted(regions.fused(np.array(boxes, float), 5.0).tolist())


def test_regions_of_many_pages_are_batches(spark):
    """Pages aren't groups of their own in Python."""
    from lumenspan.operators import regions

    d = spark.createDataFrame([(p, [float(k), 0.0, k + 1.0, 1.0]) for p in (None, *range(50)) for k in (0, 5, 40)], "page long, box array<double>")
    m = regions.merged(d)
    assert m.count() == 102 and "FlatMapGroups" not in m._jdf.queryExecution().executedPlan().toString()


def test_distinctive_terms_by_ties(spark):
    """Terms at equal counts are told by how they are written; a text in several rows counts once."""
    from lumenspan.operators import speech

    r = random.Random(23)
    words = ["alpha", "Alpha", "ALPHA", "gpu-9", "beta", "beTa", "gamma", "the", "x1y", "delta", "Delta", "omega"]
    once = [(r.choice(["a", "b", None]), i, " ".join(r.choice(words) for _ in range(r.randrange(6)))) for i in range(30)]
    for rows in (once, [*once, *once[:7], *(("a", i, "extra delta") for i in (1, 2))]):
        found = {}
        for by, nth, text in rows:
            for place, w in enumerate(re.findall(speech.TERM, text)):
                if w.lower() not in speech.EVERYDAY:
                    found.setdefault((by, w.lower()), []).append((-sum(c.isupper() for c in w), nth, place, w))
        for most in (2, 3, 50):
            expected = set()
            for by in ("a", "b", None):
                terms = [(-len({n for _, n, _, _ in ways}), -bool(re.search("[0-9-]|^.+[A-Z]", min(ways)[3])), -len(k), k, min(ways)[3]) for (b, k), ways in found.items() if b == by]
                expected |= {(by, i, t[-1]) for i, t in enumerate(sorted(terms)[:most], 1)}
            got = speech.distinctive_terms(spark.createDataFrame(rows, "source string, nth long, text string"), "source", most).collect()
            assert set(map(tuple, got)) == expected and len(got) == len(expected)


def test_nearest_in_blocks(spark, monkeypatch):
    """The nearest by small blocks of queries, units and tiles, with ties by place, are those of all pairs."""
    from lumenspan.operators import ranking

    monkeypatch.setattr(ranking, "QUERIES", 3)
    monkeypatch.setattr(tiles.tiled, "__defaults__", (7, ([], [])))
    rows = [(i, i % 3, v) for i, v in enumerate(vectors(60, 8))]
    d = spark.createDataFrame(rows, "pos long, label int, vector array<double>")
    score = {(a, b): round(float(np.dot(x, y)), 6) for a, _, x in rows for b, _, y in rows}
    nearest = lambda a, others: {(a, b, r) for r, b in enumerate(sorted(others, key=lambda b: (-score[a, b], b))[:4], 1)}
    own = set().union(*(nearest(a, [b for b, m, _ in rows if m == l and b != a]) for a, l, _ in rows))
    got = ranking.nearest_in_group(d.withColumnRenamed("pos", "qid"), d, "label", 4).collect()
    assert {(r.qid, r.pos, r.rank) for r in got} == own and len(got) == 240
    every = set().union(*(nearest(a, [b for b, _, _ in rows]) for a, _, _ in rows[:10]))
    got = ranking.dense_top_k(d, d.where("pos < 10").withColumnRenamed("pos", "qid"), 4, "vector").collect()
    assert {(r.qid, r.pos, r.rank) for r in got} == every and len(got) == 40


def test_overlap_of_repeated_documents(spark):
    """Documents in one row each give what the join of terms gives, without it."""
    from lumenspan.operators import ranking

    r = random.Random(29)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n)) if n else None
    docs = spark.createDataFrame([(i, text(r.randrange(6))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(5)) for i in range(6)] + [(6, "zzz"), (7, None)], "item_id long, text string")
    plain = {}
    idf = {t: np.log(1 + 40 / (1 + n)) for t in "abcdefgh" if (n := docs.where(F.contains("text", F.lit(t))).count())}
    for i, words in ((x.item_id, {w for w in (x.text or "").split() if w in idf}) for x in items.collect()):
        scored = [(-round(min(1.0, sum(idf[w] for w in both) / sum(idf[w] for w in words)), 6), d.doc_id) for d in docs.collect() if (both := words & set((d.text or "").split()))]
        plain |= {(i, doc, n): -s for n, (s, doc) in enumerate(sorted(scored)[:5], 1)}
    got = {(x.item_id, x.doc_id, x.rank): x.overlap for x in ranking.overlap_top_k(docs, items, 5).collect()}
    assert got == plain and len(got) > 20
    assert ranking.overlap_top_k(docs.unionByName(docs.where("doc_id < 3")), items, 5).count() == len(got)


def test_expanded_scores_are_those_of_expand(spark):
    from lumenspan.operators import graph

    r = random.Random(31)
    links = spark.createDataFrame([(f"n{r.randrange(30)}", f"n{r.randrange(34)}", r.choice(["deictic", "figure_text", "same_slide"]), r.randrange(1, 9) / 10) for _ in range(150)], "src_id string, dst_id string, link_type string, score double")
    units = spark.createDataFrame([(f"n{i}",) for i in range(30)], "id string")
    seeds = spark.createDataFrame([(q, f"n{r.randrange(30)}", float(q)) for q in range(6) for _ in range(2)], "qid int, id string, score double").distinct()
    for hops in (1, 2, 3):
        for normalise in (True, False):
            want = graph.expand(seeds, graph.neighbours(links), units, hops, normalise=normalise).select("qid", "id", "score", "origin")
            got = graph.expanded_scores(seeds, graph.sides(links), units, hops, normalise=normalise)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_corpus_stats_meet_ends_once(spark):
    """Links are joined with each of their ends once; unknown ends, units in two rows and files that are null count as before."""
    from lumenspan.operators import views

    r = random.Random(37)
    files = [(f"n{i % 14}", r.choice(["a", "b", None])) for i in range(18)]
    rows = [(f"n{r.randrange(17)}", f"n{r.randrange(17)}", r.choice("xyz")) for _ in range(80)]
    stats = views.corpus_stats(spark.createDataFrame(rows, "src_id string, dst_id string, link_type string"), spark.createDataFrame(files, "id string, source_file string"))
    known = {i for i, _ in files}
    kept = [x for x in rows if x[0] in known and x[1] in known]
    crossing = sum(a is not None and b is not None and a != b for s, d, _ in rows for i, a in files if i == s for j, b in files if j == d)
    expected = {"total": len(kept), "dropped": len(rows) - len(kept), "links": len(rows), "cross_file": crossing} | {f"type {t}": sum(x[2] == t for x in kept) for t in "xyz"}
    assert {x.name: x.n for x in stats.collect()} == expected and stats.count() == len(expected)
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") == 2
    empty = views.corpus_stats(spark.createDataFrame([], "src_id string, dst_id string, link_type string"), spark.createDataFrame(files, "id string, source_file string"))
    assert {x.name: x.n for x in empty.collect()} == {"total": 0, "dropped": 0, "links": 0, "cross_file": 0}


def test_quoted_spans_leave_texts_where_they_are(spark):
    """Passages go to the texts; with exact, case and marks count too."""
    docs = spark.createDataFrame([(1, "The Quick, brown fox."), (1, "other words"), (2, "the quick brown fox"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quick, brown"), (2, "quick brown fox"), (3, "the zebra fox"), (4, None)], "item_id long, text string")
    spans = evidence.quoted_spans(docs, items)
    assert sorted(map(tuple, spans.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert sorted(map(tuple, evidence.quoted_spans(docs, items, exact=True).collect())) == [(1, 1), (2, 2)]
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert not any("_hay" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
