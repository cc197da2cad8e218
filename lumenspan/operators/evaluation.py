"""Evaluation: retrieval and answer metrics, agreement, resampling, threshold choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places as P

SEED = 20260923


def recall_precision(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recall, precision) of retrieved(qid, id) against gold(qid, id), as sets; recall is NaN without gold."""
    r, g = retrieved.select("qid", "id").distinct(), gold.select("qid", "id").distinct()
    hits = r.join(g, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    n = r.groupBy("qid").agg(F.count("*").alias("n")).join(g.groupBy("qid").agg(F.count("*").alias("m")), "qid", "full").join(hits, "qid", "left")
    hit = F.coalesce("hits", F.lit(0))
    return n.select("qid", F.when(F.coalesce("m", F.lit(0)) == 0, float("nan")).otherwise(hit / F.col("m")).alias("recall"), F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(hit / F.col("n")).alias("precision"))


def hits_at(ranked: DataFrame, cuts: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """(qid, hit@k..., best_iou) of ranked(qid, rank, s0, s1, g0, g1): whether, and how well, the first k meet the gold span."""
    meets = P.overlaps_strictly(F.col("s0"), F.col("s1"), F.col("g0"), F.col("g1"))
    cells = [F.max(F.when(meets & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in cuts]
    return ranked.groupBy("qid").agg(*cells, F.max(F.when(F.col("rank") <= max(cuts), P.iou(F.col("s0"), F.col("s1"), F.col("g0"), F.col("g1"))).otherwise(0.0)).alias("best_iou"))


def micro_f1(rows: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(by..., f1): rows whose truth is -1 aren't scored, but -1 is a label if the truth has it, so that abstaining counts against."""
    labels = rows.groupBy(*by).agg(F.collect_set(truth).alias("_labels"))
    joined = rows.join(labels, by).where(F.col(truth) != -1)
    hit = F.col(truth) == F.col(pred)
    known = F.array_contains("_labels", F.col(pred))
    sums = joined.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(~hit & known).alias("fp"), F.count_if(~hit).alias("fn"))
    return sums.select(*by, F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))


def answered(rows: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(by..., precision, coverage): of the scored rows those not abstained, and how many of them are right."""
    scored = rows.where(F.col(truth) != -1)
    gave = F.col(pred) != -1
    return scored.groupBy(*by).agg(F.avg(F.when(gave, (F.col(pred) == F.col(truth)).cast("double"))).alias("precision"), F.avg(gave.cast("double")).alias("coverage"))


def macro_prf(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(n, accuracy, p, r, f1): macro means over the labels that occur, null predictions apart, which count against recall."""
    parts = rows.select(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.col(truth).eqNullSafe(F.col(pred)).cast("int").alias("tp"))
    guess = rows.where(F.col(pred).isNotNull()).select(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp"))
    by = parts.unionByName(guess).groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    prec, rec = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t"))).otherwise(0.0)
    return by.agg(F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(prec).alias("p"), F.avg(rec).alias("r"), F.avg(f1).alias("f1"))


def change_rate(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., changes, absent): changes of value for each distinct one, and the share of -1."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    marked = rows.withColumn("_c", F.coalesce((before != F.col(value)).cast("int"), F.lit(0)))
    return marked.groupBy(*by).agg((F.sum("_c") / F.countDistinct(value)).alias("changes"), F.avg((F.col(value) == -1).cast("double")).alias("absent"))


def tolerant_accuracy(rows: DataFrame, tolerance: int = 0) -> DataFrame:
    """(accuracy, n) of rows(pred, accept array): a prediction within tolerance of an accepted value is right."""
    near = F.array_min(F.transform("accept", lambda a: F.abs(a - F.col("pred"))))
    return rows.agg(F.avg((near <= tolerance).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mean_of_runs(cells: DataFrame, by: list[str], value: str = "value", population: bool = False) -> DataFrame:
    """(by..., mean, std): the mean over questions of each run, then the mean and deviation over runs."""
    runs = cells.groupBy(*by, "run").agg(F.avg(value).alias("_v"))
    return runs.groupBy(*by).agg(F.avg("_v").alias("mean"), (F.stddev_pop("_v") if population else F.stddev_samp("_v")).alias("std"), F.count("*").alias("runs"))


def buckets(question_type: Column) -> Column:
    """The reporting buckets of a question's type; a pointing question is cross-modal too."""
    return F.when(question_type == "deictic", F.array(F.lit("cross_modal"), F.lit("deictic"))).when(question_type == "cross_modal", F.array(F.lit("cross_modal"))).when(question_type.isNotNull(), F.array(F.lit("single_modality"))).otherwise(F.array().cast("array<string>"))


def paired(results: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, topic, diff): each question's mean over runs in cell a less that in cell b. results(qid, topic, cell, run, value)."""
    means = results.where(F.col("cell").isin(a, b)).groupBy("qid", "topic", "cell").agg(F.avg("value").alias("v"))
    wide = means.groupBy("qid", "topic").pivot("cell", [a, b]).agg(F.first("v"))
    return wide.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("qid", "topic", (F.col(a) - F.col(b)).alias("diff"))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, by: str | None = None, draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """(by, mean, low, high, n): a mean's interval with clusters drawn again, whole, with replacement.

    Only each cluster's count and sum go into the draws, so that their cost follows the
    number of clusters and not of rows.
    """
    sums = rows.groupBy(*([by] if by else []), cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("k"))
    sums = sums.withColumnRenamed(by, "_by") if by else sums.withColumn("_by", F.lit("all"))

    def over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(cluster, kind="stable")
        s, k = group["s"].to_numpy(), group["k"].to_numpy(np.float64)
        draw = np.random.default_rng(seed)
        means = np.empty(draws)
        step = max(1, 2_000_000 // max(1, len(s)))
        for i in range(0, draws, step):
            picks = draw.integers(0, len(s), (min(step, draws - i), len(s)))
            means[i : i + len(picks)] = s[picks].sum(axis=1) / np.maximum(k[picks].sum(axis=1), 1)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"_by": [group["_by"].iloc[0]], "mean": [s.sum() / max(k.sum(), 1)], "low": [low], "high": [high], "n": [int(k.sum())]})

    kind = dict(sums.dtypes)["_by"]
    out = sums.groupBy("_by").applyInPandas(over, f"_by {kind}, mean double, low double, high double, n long")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def false_accept_threshold(scores: DataFrame, fixed: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0), most: float = 0.05) -> DataFrame:
    """(threshold, accepts, rejects): the least candidate at which at most a share of unrelated scores(z, related) passes.

    Candidates are all scores, and fixed points, rounded to two decimals. Shares are
    running counts in the order of z: one sort instead of a pass for each candidate.
    """
    spark = scores.sparkSession
    points = spark.createDataFrame([(float(x),) for x in fixed], "t double")
    candidates = scores.select(F.round("z", 2).alias("t")).unionByName(points).distinct()
    # events: a score counts as passing for all candidates not above it
    events = scores.select(F.col("z").alias("x"), F.col("related").cast("int").alias("r"), F.lit(1).alias("score")).unionByName(candidates.select(F.col("t").alias("x"), F.lit(0).alias("r"), F.lit(0).alias("score")))
    above = Window.orderBy(F.desc("x"), F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = scores.agg(F.sum(F.col("related").cast("int")).alias("yes"), F.sum(1 - F.col("related").cast("int")).alias("no"))
    passed = events.withColumn("yes_in", F.sum("r").over(above)).withColumn("no_in", F.sum(F.col("score") - F.col("r")).over(above)).where("score = 0").crossJoin(F.broadcast(whole))
    rates = passed.select(F.col("x").alias("threshold"), F.try_divide("no_in", "no").alias("accepts"), (1 - F.try_divide("yes_in", "yes")).alias("rejects"))
    return rates.where(F.coalesce("accepts", F.lit(0.0)) <= most).orderBy("threshold").limit(1)


def leave_one_out(scores: DataFrame) -> DataFrame:
    """(held, setting, value): for each held-out lecture the setting best on the mean of the others, and its value there.

    scores(lecture, setting, value). The others' mean is the whole sum less the lecture's own.
    """
    total = scores.groupBy("setting").agg(F.sum("value").alias("_s"), F.count("*").alias("_n"))
    rest = scores.join(total, "setting").where("_n > 1").withColumn("_m", (F.col("_s") - F.col("value")) / (F.col("_n") - 1))
    best = rest.groupBy(F.col("lecture").alias("held")).agg(F.max(F.struct(F.round("_m", 9).alias("m"), F.col("setting"), F.col("value"))).alias("b"))
    return best.select("held", "b.setting", "b.value")


def constrained_best(grid: DataFrame, least: float) -> DataFrame:
    """The setting of greatest precision among those whose coverage is at least so much; of equals the greatest setting."""
    return grid.where(F.col("coverage") >= least).agg(F.max_by(F.struct("setting", "precision", "coverage"), F.struct("precision", "setting")).alias("m")).select("m.*")


def agreement_of_runs(runs: DataFrame) -> DataFrame:
    """(a, b, n, agreement) of every two of runs(run, qid, unit, verdict), on what both judged."""
    x = runs.select(F.col("run").alias("a"), "qid", "unit", F.col("verdict").alias("va"))
    y = runs.select(F.col("run").alias("b"), "qid", "unit", F.col("verdict").alias("vb"))
    return x.join(y, ["qid", "unit"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("agreement"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rho) of two columns by mean ranks."""
    n = F.count("*").over(Window.partitionBy())

    def mean_rank(c: str) -> Column:
        first = F.rank().over(Window.orderBy(c))
        ties = F.count("*").over(Window.partitionBy(c))
        return first + (ties - 1) / 2

    ranked = rows.withColumn("_a", mean_rank(a)).withColumn("_b", mean_rank(b)).withColumn("_n", n)
    return ranked.agg(F.corr("_a", "_b").alias("rho"))


def audit_marks(answers: DataFrame) -> DataFrame:
    """(type, options, first..., longest): where the right option stands, and how often it is the one longest."""
    from ..functions.text import longest_option

    right = F.element_at("options", F.col("gold") + 1)
    letter = F.char(F.col("gold") + 65)
    return answers.withColumn("_r", right).groupBy("level").agg(
        *(F.avg((letter == x).cast("double")).alias(f"share_{x}") for x in "ABCD"),
        F.avg((longest_option(F.col("options")) == letter).cast("double")).alias("longest"), F.count("*").alias("n"),
    )
