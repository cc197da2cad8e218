"""Operators that SQL can't express, against plain restatements of what they do."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lumenspan.functions import stats as S
from lumenspan.functions import text as T
from lumenspan.operators import alignment, evidence, links, regions, studies
from lumenspan.plans.catalogue import catalogue

QUERIES = catalogue()


def rows(spark, name):
    return QUERIES[name][0](spark, SMALL).toPandas()


def pairwise_merged(boxes, gap):
    """Two boxes that are near become one, again and again."""
    boxes = [tuple(b) for b in boxes]
    while True:
        near = next(((a, b) for a, b in itertools.combinations(boxes, 2) if all(a[k] - gap <= b[k + 2] and b[k] - gap <= a[k + 2] for k in (0, 1))), None)
        if near is None:
            return sorted(boxes)
        a, b = near
        boxes.remove(a)
        boxes.remove(b)
        boxes.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


def test_boxes_merge_until_none_are_near():
    r = random.Random(2)
    for _ in range(120):
        boxes = [(x, y, x + r.randint(1, 30), y + r.randint(1, 30)) for x, y in ((r.randint(0, 150), r.randint(0, 150)) for _ in range(r.randint(1, 14)))]
        got = sorted(map(tuple, regions.fused(np.array(boxes, float), 5.0).tolist()))
        assert got == pairwise_merged(boxes, 5.0)


def test_figure_regions(spark):
    drawn = [(1, [100.0, 100.0, 300.0, 250.0]), (1, [305.0, 100.0, 400.0, 250.0]), (1, [0.0, 0.0, 700.0, 690.0]), (1, [5.0, 5.0, 5.0, 80.0]), (1, [600.0, 10.0, 690.0, 105.0]), (1, [500.0, 600.0, 520.0, 620.0])]
    pages = spark.createDataFrame([(1, 700.0, 700.0)], "page long, width double, height double")
    got = {(tuple(x.box), x.kind) for x in regions.figures(spark.createDataFrame(drawn, "page long, box array<double>"), pages).collect()}
    assert got == {((100.0, 100.0, 400.0, 250.0), "kept"), ((600.0, 10.0, 690.0, 105.0), "logo"), ((500.0, 600.0, 520.0, 620.0), "small")}


def test_region_counts_add_up(spark):
    whole = rows(spark, "figure_regions").groupby(["page", "kind"]).size().unstack(fill_value=0).sort_index()
    counts = rows(spark, "region_counts").set_index("page").sort_index()
    assert (counts.clusters == whole.sum(axis=1)).all() and (counts.kept == whole.get("kept", 0)).all()


def test_greedy_pairs(spark):
    r = random.Random(7)
    pairs = [(g, a, b, round(r.random(), 3)) for g in range(3) for a in range(6) for b in range(6)]
    got = sorted(map(tuple, studies.greedy_pairs(spark.createDataFrame(pairs, "g int, a int, b int, score double"), "g", 0.3, 4).collect()))
    expected = []
    for g in range(3):
        left, right, n = set(), set(), 0
        for _, a, b, s in sorted((p for p in pairs if p[0] == g and p[3] >= 0.3), key=lambda p: (-p[3], p[1], p[2])):
            if n < 4 and a not in left and b not in right:
                left.add(a)
                right.add(b)
                n += 1
                expected.append((g, a, b, s))
    assert got == sorted(expected)


def test_paths_through_builds(spark):
    """Groups of builds by the path over groups, then forwards through what each adds: by trying every way."""
    r = np.random.default_rng(4)
    texts = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "f", "g"], ["h", "i", "j", "k", "l"], ["m"]]
    groups = [0, 0, 0, 1, 2]
    said = [[str(x) for x in r.choice(list("abcdefghijklm"), 4)] for _ in range(6)]
    s = np.round(r.random((6, 5)), 4)
    matrix = spark.createDataFrame([(0, i, j, float(s[i, j])) for i in range(6) for j in range(5)], "pair long, i long, j long, s double")
    pages = spark.createDataFrame([(0, j, t) for j, t in enumerate(texts)], "pair long, j long, tokens array<string>")
    sentences = spark.createDataFrame([(0, i, t) for i, t in enumerate(said)], "pair long, i long, tokens array<string>")
    got = {x.i: x.j for x in studies.build_paths(matrix, pages, sentences).collect()}
    p = alignment.Penalties()
    coarse = alignment.best_path(np.stack([s[:, [j for j, g in enumerate(groups) if g == k]].max(axis=1) for k in range(3)], axis=1), p)
    idf = {t: math.log(1 + 5 / (1 + sum(t in x for x in texts))) for x in texts for t in x}
    for g in range(3):
        inside, own = [j for j in range(5) if groups[j] == g], [i for i in range(6) if coarse[i] == g]
        if not own:
            continue
        adds = [set(texts[j]) if k == 0 else set((Counter(texts[j]) - Counter(texts[j - 1])).keys()) or set(texts[j]) for k, j in enumerate(inside)]
        value = [[sum(idf[t] for t in set(said[i]) & a) / sum(idf[t] for t in a) for a in adds] for i in own]
        ways = list(itertools.combinations_with_replacement(range(len(inside)), len(own)))
        best = max(sum(value[n][k] for n, k in enumerate(w)) for w in ways)
        chosen = [inside.index(got[i]) for i in own]
        assert chosen == sorted(chosen)
        assert sum(value[n][k] for n, k in enumerate(chosen)) == pytest.approx(best)


def test_pages_that_build(spark):
    got = rows(spark, "page_builds").sort_values(["doc_id", "page"])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.transform(F.split("text", "\n"), T.tokens).alias("t")).collect()
    told = {d: list(x.island) for d, x in got.groupby("doc_id")}
    for d in docs:
        lines, island, expected, before = d.t, -1, [], None
        for k, line in enumerate(lines):
            words = (lines[k - 1] if k else []) + line if k % 3 == 1 else line
            if before is None or len(before) < 5 or Counter(before) - Counter(words):
                island += 1
            expected.append(island)
            before = words
        assert told[d.doc_id] == expected


def plain_meteor(pred, ref):
    free, met = list(range(len(ref))), []
    for i in range(len(pred) - 1, -1, -1):
        hit = max((k for k in free if ref[k] == pred[i]), default=None)
        if hit is not None:
            free.remove(hit)
            met.append((i, hit))
    if not met:
        return 0.0
    met.sort()
    chunks = 1 + sum(a[0] + 1 != b[0] or a[1] + 1 != b[1] for a, b in itertools.pairwise(met))
    p, r = len(met) / len(pred), len(met) / len(ref)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(met)) ** 3)


def test_meteor(spark):
    r = random.Random(9)
    pairs = [([r.choice("abcde") for _ in range(r.randint(0, 8))], [r.choice("abcde") for _ in range(r.randint(0, 8))]) for _ in range(60)]
    got = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n long, a array<string>, b array<string>").select("n", S.meteor(F.col("a"), F.col("b")).alias("m")).collect()
    for x in got:
        assert x.m == pytest.approx(plain_meteor(*pairs[x.n]))


def test_facts(spark):
    text = "The model is fast; it uses e.g. caching. No. See fig. 2 for the rest"
    got = spark.createDataFrame([(text,)], "t string").select(T.facts(F.col("t")).alias("a"), T.facts(F.col("t"), F.lit("Why?")).alias("b")).first()
    assert got.a == ["The model is fast", "it uses e.g. caching.", "No. See fig. 2 for the rest"]
    assert got.b == [f"Why? {x}" for x in got.a]


def test_entailment(spark):
    pairs = [(1, "Cats sleep all day long. Dogs run in the green park today.", "dogs run in the park"), (2, "Nothing of that sort is said here.", "dogs run"), (3, "Any text at all stands here.", " "), (4, "Short. Dogs run.", "dogs run")]
    got = {x.key: x for x in evidence.entailment(spark.createDataFrame(pairs, "key long, premise string, hypothesis string"), evidence.word_overlap, margin=0.2).collect()}
    assert got[1].entailed and got[1].span.startswith("Dogs run") and not got[2].entailed and not got[3].entailed and got[3].span == ""
    assert got[4].entailed and got[4].span == "Dogs run."
    facts = spark.createDataFrame([(1, 0, False, "a"), (1, 1, True, "b"), (2, 0, True, "c"), (2, 1, True, "d")], "doc long, nth long, entailed boolean, span string")
    assert {(x.doc, x.entailed, x.span) for x in evidence.entails_any(facts, "doc").collect()} == {(1, True, "b"), (2, True, "c")}
    assert {(x.doc, x.entailed) for x in evidence.entails_all(facts, "doc").collect()} == {(1, False), (2, True)}


def test_quoted_spans(spark):
    """Passages in documents by their rarest inner word are those of trying every passage in every document."""
    docs = [(1, "The quick, brown fox jumps!"), (2, "aquick brown foxes jump"), (3, "nothing"), (4, None), (5, "quick brown")]
    items = [(1, "quick brown fox"), (2, "brown"), (3, "no such words here"), (4, "quick ... jumps"), (5, "")]
    norm = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())

    def holds(text, passage):
        at, pieces = 0, [p for p in map(norm, passage.split("...")) if p]
        for p in pieces:
            at = norm(text).find(p, at)
            if at < 0:
                return False
            at += len(p)
        return bool(pieces)

    got = {tuple(x) for x in evidence.quoted_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, p in items if holds(t, p)}


def test_figure_links_reach_across_pages(spark):
    """No link is lost to the pages that are looked at: the same as from all pairs."""
    from lumenspan.operators import ranking
    from lumenspan.operators import units as U

    texts = [(i, f"see figure {i % 4}. shared words number {i % 3}", "s") for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    u = U.chunked(docs)
    u = u.join(ranking.hash_bag(u), "pos")
    figures = u.withColumn("content", F.concat(F.lit("Figure "), (F.col("location.page") % 4).cast("string"), F.lit(": shared words")))
    keep = ("src_id", "dst_id", "score")
    near = links.figure_text(links.figure_text_scores(figures, u, reach=links.farthest_page(0.45)), 0.45).select(*keep)
    far = links.figure_text(links.figure_text_scores(figures, u), 0.45).select(*keep)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect())) and near.count() > 12


def test_expansion_reasons(spark):
    got = rows(spark, "expansion_reasons")
    assert got[got.why == "seed"].n.sum() > 0 and got.why.str.match(r"^(seed|expanded from o via \w+ \(0\.\d{3}\))$").all()


def test_page_units(spark):
    """Texts of every page with words, and figures of one kind in each file."""
    got = rows(spark, "page_units")
    assert set(got.modality) == {"text", "figure"} and got.id.is_unique
    files = defaultdict(set)
    for x in got.itertuples():
        files[x.id.split(":")[0]].add(x.deck)
    assert all(len(v) == 1 for v in files.values()) and {d for v in files.values() for d in v} == {True, False}


def test_first_json_object(spark):
    """What follows the first whole object is of no account, braces in strings included."""
    cases = {'{"a":1} and {x}': '{"a":1}', 'so: {"a":{"b":"}"}} {"c":2}': '{"a":{"b":"}"}}', "```json\n{\"a\": \"\\\"}\"}\n```": '{"a": "\\"}"}', "none": None, "{open": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.json_object(F.col("t")).alias("j")).collect()
    assert {x.t: x.j for x in got} == cases
