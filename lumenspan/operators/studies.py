"""Studies over many runs: sweeps of parameters, paired comparisons, report tables, floors that know nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from . import alignment, evaluation, ranking, tiles


def swept(grid: DataFrame, cells: DataFrame, on: list[str], value: Column) -> DataFrame:
    """(grid..., value): a setting's mean value over cells. The grid is a short, given table that goes to every task."""
    rows = cells.crossJoin(F.broadcast(grid))
    return rows.groupBy(*grid.columns).agg(F.round(F.avg(value), 9).alias("value")) if not on else rows.groupBy(*on, *grid.columns).agg(F.round(F.avg(value), 9).alias("value"))


def best_setting(scores: DataFrame, settings: list[str], part: str = "tune") -> DataFrame:
    """scores(part, lecture, settings..., value) of the setting with the best mean over the tune part, of equals the least."""
    means = scores.where(F.col("part") == part).groupBy(*settings).agg(F.round(F.avg("value"), 9).alias("_m"))
    best = means.orderBy(F.desc("_m"), *settings).limit(1).drop("_m")
    return scores.join(F.broadcast(best), settings)


def kept_if_better(scores: DataFrame, setting: str, none: str) -> DataFrame:
    """(setting, mean) of the best of scores(setting, value), or of ``none`` unless another truly beats it."""
    means = scores.groupBy(setting).agg(F.round(F.avg("value"), 9).alias("mean"))
    return means.orderBy(F.desc("mean"), (F.col(setting) != none).cast("int"), setting).limit(1)


def fused_many(parts: list[DataFrame], weights: list[float], by: list[str]) -> DataFrame:
    """(by..., i, j, s): the weighted sum of matrices in long form, each scaled over the whole first."""
    scaled = [ranking.min_max(p, "s", by).select(*by, "i", "j", (w * F.col("s")).alias("s")) for p, w in zip(parts, weights, strict=True)]
    every = scaled[0]
    for p in scaled[1:]:
        every = every.unionByName(p)
    return every.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def blinded(matrix: DataFrame, frames: DataFrame, by: list[str], min_words: int, min_margin: float) -> DataFrame:
    """The matrix with a constant row, its least value, where no slide is seen: frames(by..., i, words, margin) with few words and a small margin."""
    hidden = frames.where(~visible(F.col("words"), F.col("margin"), min_words, min_margin)).select(*by, "i", F.lit(True).alias("_hidden"))
    least = F.min("s").over(Window.partitionBy(*by))
    return matrix.withColumn("_least", least).join(hidden, [*by, "i"], "left").withColumn("s", F.when(F.col("_hidden"), F.col("_least")).otherwise(F.col("s"))).drop("_least", "_hidden")


def visible(words: Column, margin: Column, min_words: int, min_margin: float) -> Column:
    """Whether a frame shows a slide: it reads enough words, or its image picks a page clearly."""
    return (words >= min_words) | (margin > min_margin)


def rows_of_shown(midpoints: DataFrame, slides: DataFrame, frames: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by..., a, j, s): each midpoint(by..., a, t) takes the row of frames(by..., k, j, s) of the slide(by..., b, b0, b1) then shown; 0 where none is."""
    from .intervals import point_join

    shown = point_join(midpoints, slides, by, width)
    columns = frames.select(*by, "j").distinct()
    cells = shown.join(columns, by)
    return cells.join(frames.withColumnRenamed("k", "b"), [*by, "b", "j"], "left").select(*by, "a", "j", F.coalesce("s", F.lit(0.0)).alias("s"))


def position_floor(rows: DataFrame, by: str, order: str, pages: Column) -> DataFrame:
    """rows with floor: the page that the place alone gives, the nth of n rows mapped to the pages in proportion."""
    w = Window.partitionBy(by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("floor", F.least(F.floor(i * pages / n).cast("long"), pages - 1))


def decoder_table(paths: DataFrame, truth: DataFrame) -> DataFrame:
    """(matrix, decoder, f1): mean over lectures of the micro F1 of each matrix and decoder; paths(matrix, decoder, lecture, i, pred), truth(lecture, i, truth)."""
    joined = paths.join(truth, ["lecture", "i"])
    f1 = evaluation.micro_f1(joined, ["matrix", "decoder", "lecture"])
    return f1.groupBy("matrix", "decoder").agg(F.avg("f1").alias("f1"))


def wins(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(n, wins, ties, diff): over lectures, how often variant a beats b, and the mean difference. scores(lecture, variant, value)."""
    wide = scores.where(F.col("variant").isin(a, b)).groupBy("lecture").pivot("variant", [a, b]).agg(F.first("value")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.col(a) - F.col(b)
    return wide.agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("diff"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(n, plus, minus): Wilcoxon's sums of mean ranks of the absolute differences(diff), zeros left out.

    Ranks come from counts of equal differences, so that equal ones are one row in the one ordered pass.
    """
    sizes = pairs.where("diff != 0").groupBy(F.abs("diff").alias("d")).agg(F.count("*").alias("k"), F.count_if(F.col("diff") > 0).alias("up"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_r", before + (F.col("k") + 1) / 2)
    return ranked.agg(F.sum("k").alias("n"), F.sum(F.col("_r") * F.col("up")).alias("plus"), F.sum(F.col("_r") * (F.col("k") - F.col("up"))).alias("minus"))


def by_granularity(gates: DataFrame, names: list[str]) -> DataFrame:
    """(lecture, z of each granularity...) of gates(lecture, granularity, z)."""
    return gates.groupBy("lecture").pivot("granularity", names).agg(F.first("z"))


def answer_table(answers: DataFrame, by: str = "level", mode: str = "mode", refusals: tuple[str, ...] = (), metrics: tuple[str, ...] = ("f1",)) -> DataFrame:
    """(by, mode, n, <metric>, <metric>_std, refusals) of answers(by, mode, rep, answer, metrics...), and rows over all levels, by 'overall'.

    Means of each repeat, then their mean and population deviation. n and refusals, by
    phrases, are those of repeat 0.
    """
    refused = F.lit(False)
    for phrase in refusals:
        refused = refused | F.contains(F.lower("answer"), F.lit(phrase.lower()))
    marked = answers.withColumn("_refused", refused & (F.col("rep") == 0)).withColumn("_first", F.col("rep") == 0)
    both = marked.unionByName(marked.withColumn(by, F.lit("overall")))
    runs = both.groupBy(by, mode, "rep").agg(*(F.avg(m).alias(m) for m in metrics), F.count_if("_first").alias("_n"), F.count_if("_refused").alias("_r"))
    return runs.groupBy(by, mode).agg(F.max("_n").alias("n"), *(c for m in metrics for c in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"))), F.max("_r").alias("refusals"))


def echo_floor(questions: DataFrame, by: str = "level") -> DataFrame:
    """(by, n, f1): the token F1 of questions(by, question, ref) given back as their own answers, and a row 'overall'."""
    from ..functions import text as T

    # sets, and then their sizes, are columns of their own: inside one expression each use would cut the texts again
    sets = questions.select(by, F.array_distinct(T.ascii_tokens(F.col("question"))).alias("_q"), F.array_distinct(T.ascii_tokens(F.col("ref"))).alias("_r"))
    met = sets.select(by, F.size("_q").alias("_p"), F.size("_r").alias("_n"), F.size(F.array_intersect("_q", "_r")).alias("_both"))
    p, r = (F.when(F.col(n) > 0, F.col("_both") / F.col(n)).otherwise(0.0) for n in ("_p", "_n"))
    sums = met.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("_f"))
    both = sums.withColumn(by, F.explode(F.array(F.col(by), F.lit("overall"))))
    return both.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("_f") / F.sum("n")).alias("f1"))


def share_reached(scores: DataFrame, a: str, b: str, by: str = "level") -> DataFrame:
    """(by, share): mean of mode a over that of mode b."""
    return scores.groupBy(by).agg(F.try_divide(F.avg(F.when(F.col("mode") == a, F.col("f1"))), F.avg(F.when(F.col("mode") == b, F.col("f1")))).alias("share"))


def greedy_pairs(pairs: DataFrame, by: str, least: float, most: int) -> DataFrame:
    """pairs(by, a, b, score) chosen one after the other, the best first, each a and b once, up to ``most`` of a group.

    Only pairs of at least a score go into a group's walk.
    """

    def over(group: pd.DataFrame) -> pd.DataFrame:
        left, right, rows = set(), set(), []
        for row in group.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            if len(rows) == most:
                break
            if row.a not in left and row.b not in right:
                left.add(row.a)
                right.add(row.b)
                rows.append(row)
        return pd.DataFrame(rows, columns=group.columns)

    chosen = pairs.where(F.col("score") >= least).select(by, "a", "b", "score")
    return chosen.groupBy(by).applyInPandas(over, chosen.schema)


def walkable(a: np.ndarray, b: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the pairs that a walk over them, and any others, can choose, in its order.

    Before a pair is chosen at most ``most`` - 1 others are. A better pair of its own a was
    passed over for its b, so that the pair is among the first ``most`` of its a, and so of its b; and
    each pair chosen before takes at most ``most`` of either kind out of the order.
    """
    at = np.arange(len(score))
    for one, other in ((a, b), (b, a)):
        at = at[np.lexsort((other[at], -score[at], one[at]))]
        heads = np.flatnonzero(np.r_[True, one[at][1:] != one[at][:-1]])
        at = at[np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)])) < most] if len(at) else at
    return at[np.lexsort((b[at], a[at], -score[at]))][: 2 * most * (most - 1) + 1]


def closest_pairs(left: DataFrame, right: DataFrame, by: str, least: float, most: int) -> DataFrame:
    """greedy_pairs of all pairs of left(by, a, x) and right(by, b, y), scored by their inner product with six decimals.

    Every pair is scored, tile by tile; of a tile only the few pairs that the walk can reach are passed on.
    """

    def over(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.sort_by("a"), two.sort_by("b")
        a, b = (t.column(c).to_numpy() for t, c in ((one, "a"), (two, "b")))
        x, y = tiles.vectors(one.column("x")), tiles.vectors(two.column("y"))
        kept = a[:0], b[:0], np.empty(0)
        full, step, start, width = 2 * most * (most - 1) + 1, max(1, tiles.CELLS // len(b)), 0, 16
        while start < len(a):
            rows = slice(start, start + min(step, width))
            scores = np.round(x[rows] @ y.T, ranking.DECIMALS)
            # once as many are kept as can matter, others must reach the last of them
            bar = kept[2][-1] if len(kept[2]) == full else least
            i, j = np.nonzero(scores >= max(bar, least))
            found = tuple(np.concatenate(p) for p in zip(kept, (a[rows][i], b[j], scores[i, j]), strict=True))
            at = walkable(*found, most)
            kept = tuple(p[at] for p in found)
            start, width = rows.stop, width * 2
        return pa.table({by: pa.array([one.column(by)[0].as_py()] * len(kept[0]), one.schema.field(by).type), "a": kept[0], "b": kept[1], "score": kept[2]})

    kinds = dict(left.dtypes) | dict(right.dtypes)
    some = lambda d, key, v: d.select(by, key, v).where(F.col(v).isNotNull() & F.col(key).isNotNull())
    reached = tiles.tiled(some(left, "a", "x"), some(right, "b", "y"), [by], over, f"{by} {kinds[by]}, a {kinds['a']}, b {kinds['b']}, score double")
    return greedy_pairs(reached, by, least, most)


def timed_context(chunks: DataFrame, questions: DataFrame, scored: DataFrame, k: int = 10, least: float = 0.6, around: float = 3.0, gap: float = 2.0, pool: int = 5, keep: int = 4, rescore=None) -> DataFrame:
    """(qid, nth, ids, start_s, end_s, score): retrieval that keeps to a question's time.

    Of scored(qid, pos, score) the first k above a similarity; those that touch the
    question's interval(qid, low, high; null: all) with so much around it; runs with
    gaps under ``gap`` become one, with the best score of its chunks(pos, id, start_s,
    end_s); the best ``pool`` are scored again, by ``rescore`` (a function of the rows'
    columns) if given, and the best ``keep`` told in the order of time.
    """
    top = ranking.top_k(scored, "qid", k, F.desc("score"), "pos").where(F.col("score") > least).join(chunks, "pos").join(questions, "qid")
    low, high = F.col("low") - around, F.col("high") + around
    inside = top.where(F.col("low").isNull() | ((F.col("start_s") <= high) & (F.col("end_s") >= low)))
    w = Window.partitionBy("qid").orderBy("start_s", "pos")
    fresh = inside.withColumn("_new", F.coalesce((F.col("start_s") - F.lag("end_s").over(w) >= gap).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    runs = fresh.groupBy("qid", "_g").agg(F.max("score").alias("score"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.transform(F.array_sort(F.collect_list(F.struct("start_s", "pos", "id"))), lambda x: x["id"]).alias("ids"))
    best = ranking.top_k(runs, "qid", pool, F.desc("score"), "start_s")
    again = best if rescore is None else best.withColumn("score", rescore(best))
    last = ranking.top_k(again.drop("rank"), "qid", keep, F.desc("score"), "start_s")
    return last.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("start_s")).alias("nth"), "ids", "start_s", "end_s", "score")


def scaled_scores(raw: DataFrame) -> DataFrame:
    """raw(qid, id, score) of a pair scorer, scaled to [0, 1] for each question; equal ones become 1. A question with a missing score has none."""
    w = Window.partitionBy("qid")
    low, high, known = F.min("score").over(w), F.max("score").over(w), F.count("score").over(w) == F.count("*").over(w)
    return raw.withColumn("score", F.when(known, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)))


def unit_vectors(results: DataFrame, vectors: DataFrame) -> DataFrame:
    """results(qid, id) with the embedding of each unit at length 1; none for a question that lacks one."""
    rows = results.join(vectors.select("id", "embedding"), "id", "left")
    w = Window.partitionBy("qid")
    known = F.count("embedding").over(w) == F.count("*").over(w)
    n = F.greatest(S.norm(F.col("embedding")), F.lit(1e-9))
    return rows.withColumn("_k", known).withColumn("embedding", F.when(F.col("_k"), F.transform("embedding", lambda x: x / n))).drop("_k")


def build_paths(matrix: DataFrame, pages: DataFrame, sentences: DataFrame, penalties: alignment.Penalties = alignment.Penalties(), least: float | None = None, min_tokens: int = 5) -> DataFrame:
    """(pair, i, j, s): alignment where pages(pair, j, tokens) may build on each other.

    Pages that each hold all of the one before are one column, by the greatest value.
    The path over those is found first; inside a group of builds, a sentence(pair, i,
    tokens) is held against what each build adds, by the idf of shared terms, and the
    builds are gone through forwards only.
    """
    from .segments import build_groups

    grouped = build_groups(pages.withColumnRenamed("j", "page"), "pair", min_tokens).withColumnRenamed("page", "j").withColumnRenamed("island", "g")
    columns = alignment.grouped_columns(matrix, grouped.select("pair", "j", "g"))
    coarse = alignment.monotone(columns, penalties).select("pair", "i", F.col("j").alias("g"))
    # what a build adds to the one before, as a set of terms: counts of terms decide
    before = F.lag("tokens").over(Window.partitionBy("pair", "g").orderBy("j"))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    own = F.array_distinct("tokens")
    more = F.filter(own, lambda x: count(F.col("tokens"), x) > count(F.col("_before"), x))
    added = grouped.withColumn("_before", before).withColumn("adds", F.when(F.col("_before").isNull() | (F.size(more) == 0), own).otherwise(more))
    terms = pages.select("pair", "j", F.explode(F.array_distinct("tokens")).alias("term"))
    n = pages.groupBy("pair").agg(F.count("*").alias("n"))
    idf = terms.groupBy("pair", "term").agg(F.count("*").alias("df")).join(n, "pair").select("pair", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    told = added.select("pair", "g", "j", F.explode("adds").alias("term")).join(idf, ["pair", "term"])
    mass = told.groupBy("pair", "j").agg(F.greatest(F.sum("idf"), F.lit(1e-9)).alias("mass"))
    said = coarse.join(sentences, ["pair", "i"]).select("pair", "i", "g", F.explode(F.array_distinct("tokens")).alias("term"))
    shared = said.join(told, ["pair", "g", "term"]).groupBy("pair", "i", "j").agg(F.sum("idf").alias("shared"))
    cells = coarse.join(added.select("pair", "g", "j"), ["pair", "g"]).join(shared, ["pair", "i", "j"], "left").join(mass, ["pair", "j"], "left")
    cells = cells.select("pair", "g", "i", "j", F.coalesce(F.col("shared") / F.col("mass"), F.lit(0.0)).alias("v"))

    def over(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot_table(index="i", columns="j", values="v", aggfunc="first").sort_index().sort_index(axis=1)
        # forwards only and free of charge: the best sum up to each build, then back from the last sentence
        values = wide.to_numpy()
        total, back = values[0].copy(), np.zeros(values.shape, np.int64)
        for t in range(1, len(values)):
            reach = np.maximum.accumulate(total)
            back[t] = np.maximum.accumulate(np.where(total == reach, np.arange(len(total)), 0))
            total = reach + values[t]
        at, path = int(total.argmax()), []
        for t in range(len(values) - 1, -1, -1):
            path.append(at)
            at = int(back[t, at])
        return pd.DataFrame({"pair": group["pair"].iloc[0], "i": wide.index, "j": wide.columns.to_numpy()[path[::-1]]})

    kind = dict(cells.dtypes)["pair"]
    fine = cells.groupBy("pair", "g").applyInPandas(over, f"pair {kind}, i long, j long")
    path = fine.join(matrix, ["pair", "i", "j"])
    return alignment.abstained(path.select("pair", "i", "j", "s"), matrix, least)


def decoded(matrix: DataFrame, owners: DataFrame, variant: str = "dp", penalties: alignment.Penalties = alignment.Penalties(), least: float | None = None) -> DataFrame:
    """(pair, sentence, j): the path of a variant (naive, dp, with '+abstain') over windows, given to the sentences of owners(pair, sentence, i)."""
    path = alignment.naive(matrix) if variant.startswith("naive") else alignment.monotone(matrix, penalties)
    path = alignment.abstained(path, matrix, least) if "abstain" in variant else path
    return owners.join(path, ["pair", "i"]).select("pair", "sentence", "j")
