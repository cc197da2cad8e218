"""Operators that walk rows in order, against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import alignment, segments, selection


def brute_path_value(s, p):
    """Greatest value of any path, trying every previous slide for each slide."""
    n, m = s.shape
    value = [s[0, j] - (p.skip + p.start) * j for j in range(m)]
    for i in range(1, n):
        new = []
        for j in range(m):
            options = []
            for k in range(m):
                if k <= j:
                    options.append(value[k] - (p.jump * (j - k) + p.skip * (j - k - 1) if j - k > 1 else 0))
                elif k - j <= p.max_back:
                    options.append(value[k] - p.back * (k - j))
            new.append(s[i, j] + max(options))
        value = new
    return max(v - p.skip * (m - 1 - j) for j, v in enumerate(value))


def own_value(s, path, p):
    total = s[np.arange(len(path)), path].sum() - (p.skip + p.start) * path[0] - p.skip * (s.shape[1] - 1 - path[-1])
    for a, b in zip(path, path[1:]):
        total -= p.jump * (b - a) + p.skip * (b - a - 1) if b - a > 1 else p.back * (a - b) if b < a else 0
        assert a - b <= p.max_back
    return total


@pytest.mark.parametrize("seed", range(8))
def test_monotone_path_is_the_best(seed):
    s, p = np.random.default_rng(seed).random((9, 7)), alignment.Penalties()
    assert own_value(s, alignment.best_path(s, p), p) == pytest.approx(brute_path_value(s, p))


@pytest.mark.parametrize("shape", [(1, 1), (4, 1), (1, 4), (3, 2), (0, 3)])
def test_small_matrices(shape):
    s, p = np.random.default_rng(1).random(shape), alignment.Penalties()
    path = alignment.best_path(s, p)
    assert len(path) == shape[0]
    if shape[0]:
        assert own_value(s, path, p) == pytest.approx(brute_path_value(s, p))


def test_gate_tells_ordered_from_shuffled(spark):
    draw = np.random.default_rng(3)
    ordered = np.eye(12)[np.repeat(np.arange(12), 3)] * 0.5 + draw.random((36, 12)) * 0.2
    noise = draw.random((36, 12)) * 0.2
    rows = [(name, i, j, float(m[i, j])) for name, m in (("deck", ordered), ("other", noise)) for i in range(36) for j in range(12)]
    got = {r.pair: r for r in alignment.related(spark.createDataFrame(rows, "pair string, i long, j long, s double")).collect()}
    assert got["deck"].related and got["deck"].z > 3
    assert got["other"].z < got["deck"].z


def words(rows):
    return [("a", i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)]


def test_packing(spark):
    rows = words([(0, 10, "a"), (10, 20, "b."), (20, 31, "c"), (31, 40, "d."), (40, 70, "e."), (70, 71, "f")])
    w = spark.createDataFrame(rows, "by string, nth long, start double, end double, text string")
    fixed = {r.nth: r.bucket for r in segments.fixed_spans(w, "by", 30.0).collect()}
    assert [fixed[i] for i in range(6)] == [0, 0, 1, 1, 2, 3]
    s = segments.sentences_of_words(w, ["by"])
    assert [(r.sentence, r.text) for r in s.orderBy("sentence").collect()] == [(0, "a b."), (1, "c d."), (2, "e."), (3, "f")]
    packed = {r.sentence: r.bucket for r in segments.packed(s, "by", 45.0).collect()}
    assert [packed[i] for i in range(4)] == [0, 0, 1, 1]


def test_repeats_are_compared_with_kept_rows_only(spark):
    rows = [(0, i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate((0.0, 0.4, 0.8, 0.05))]
    got = segments.without_repeats(spark.createDataFrame(rows, "g long, n long, v array<double>"), "g", "n", "v", 0.9)
    assert {r.n: r.kept for r in got.collect()} == {0: 1, 1: 0, 2: 1, 3: 0}


def test_slides_merge_short_ones_and_revisits(spark):
    far = (1 << 40) - 1
    hashes = [0] * 5 + [far] * 4 + [0] * 3 + [-1] * 1 + [0] * 2
    frames = spark.createDataFrame([("v", float(i), h) for i, h in enumerate(hashes)], "v string, t double, hash long")
    got = {r.slide: [list(x) for x in r.spans] for r in segments.slides(frames, "v").collect()}
    assert got == {0: [[0.0, 5.0], [9.0, 15.0]], 1: [[5.0, 9.0]]}


def test_runs_and_next(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(["x", "x", None, "x", "y", "y"])], "u long, t long, v string")
    assert sorted((r.v, r.first, r.last) for r in segments.runs(d, ["u"], "t", "v").collect()) == [("x", 0, 1), ("x", 3, 3), ("y", 4, 5)]
    nxt = segments.spans_to_next(d, ["u"], "t", 9.0)
    assert [r.end for r in nxt.orderBy("t").collect()] == [1, 2, 3, 4, 5, 14]


POOL = [(1, f"a{i}", "audio", 0.9 - i / 100, [1.0, 0.0], i) for i in range(5)] + [(1, "f1", "figure", 0.5, [0.0, 1.0], 5)]


def pool(spark):
    return spark.createDataFrame(POOL, "qid long, id string, modality string, score double, embedding array<double>, nth long")


def ids(frame):
    return [r.id for r in frame.orderBy("rank").collect()]


def test_selection(spark):
    p = pool(spark)
    assert ids(selection.select(p, 3, "none")) == ["a0", "a1", "a2"]
    assert ids(selection.select(p, 2, "complementarity")) == ["a0", "f1"]
    assert ids(selection.select(p, 2, "mmr")) == ["a0", "f1"]
    edges = spark.createDataFrame([(1, "a0", "a3"), (1, "a3", "a0")], "qid long, a string, b string")
    assert ids(selection.select(p, 2, "complementarity", edges, alpha=0.0, gamma=0.0, beta=0.2)) == ["a0", "a3"]
    assert ids(selection.select(p, 2, "complementarity", gate=True, gamma=0.0)) == ["a0", "a1"]
    with pytest.raises(ValueError):
        selection.select(p, 2, "best")


def test_first_fit(spark):
    d = spark.createDataFrame([("m", i, n) for i, n in enumerate((60, 50, 40, 30, 20))], "g string, i long, n long")
    got = {r.i: r.batch for r in segments.first_fit(d, "g", "i", "n", 100, 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}


def test_quietest_bucket(spark):
    levels = spark.createDataFrame([("v", t / 2, abs(t - 21) + 1.0) for t in range(80)], "v string, t double, level double")
    targets = spark.createDataFrame([("v", 10.0), ("v", 900.0)], "v string, target double")
    got = {r.target: r.offset for r in segments.quietest(levels, targets, "v", 5.0).collect()}
    assert got == {10.0: 10.5, 900.0: 900.0}
    assert F is not None
