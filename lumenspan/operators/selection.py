"""Choosing k of a question's results: by score, by marginal relevance, by complementarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("none", "mmr", "complementarity")
PICKED = "qid long, id string, rank long"


def by_score(results: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank) of the k best of each question, by (-score, id)."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return results.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "id", "rank")


def greedy(pool: pd.DataFrame, k: int, method: str, linked: set[tuple[str, str]], alpha: float, beta: float, gamma: float, mmr_lambda: float) -> list[str]:
    """Ids in the order of choice. First the most relevant (of equals the one with the smaller first letter, then the earlier), then the greatest gain (of equals the smaller id)."""
    ids, kinds = pool["id"].tolist(), pool["modality"].to_numpy()
    relevance = pool["score"].to_numpy(np.float64)
    vectors = np.array(pool["embedding"].tolist(), np.float64)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    likeness = vectors @ vectors.T
    edge = np.array([[(a, b) in linked for b in ids] for a in ids], float) if method == "complementarity" else None
    chosen = [min(range(len(ids)), key=lambda i: (-relevance[i], ids[i][:1], i))]
    while len(chosen) < min(k, len(ids)):
        if method == "mmr":
            gain = mmr_lambda * relevance - (1 - mmr_lambda) * likeness[:, chosen].max(axis=1)
        else:
            new = ~np.isin(kinds, kinds[chosen])
            same = (likeness[:, chosen] * (kinds[:, None] == kinds[chosen][None, :])).sum(axis=1)
            gain = relevance + alpha * new + beta * edge[:, chosen].sum(axis=1) - gamma * same
        gain[chosen] = -np.inf
        top = np.flatnonzero(gain == gain.max())
        chosen.append(int(min(top, key=lambda i: ids[i])))
    return [ids[i] for i in chosen]


def select(results: DataFrame, k: int, method: str = "complementarity", edges: DataFrame | None = None, alpha: float = 0.3, beta: float = 0.2, gamma: float = 0.4, mmr_lambda: float = 0.5, gate: bool = False) -> DataFrame:
    """(qid, id, rank): k of results(qid, id, score, modality, embedding, nth) for each question.

    edges(qid, a, b) are links among a question's results. With gate, the bonus for a
    new modality is off where the evidence is concentrated in one. A question's pool is
    small and chosen in one task; questions are spread.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {METHODS}")
    if method == "none":
        return by_score(results, k)
    pool = results
    if gate and method == "complementarity":
        pool = pool.join(concentration(results).select("qid", "concentrated"), "qid", "left")
    if edges is None:
        pool = pool.withColumn("_links", F.array().cast("array<string>"))
    else:
        near = edges.groupBy("qid", F.col("a").alias("id")).agg(F.collect_set("b").alias("_links"))
        pool = pool.join(near, ["qid", "id"], "left")

    def over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth", kind="stable").reset_index(drop=True)
        linked = {(a, b) for a, bs in zip(group["id"], group["_links"], strict=True) if bs is not None for b in bs}
        bonus = 0.0 if "concentrated" in group and bool(group["concentrated"].iloc[0]) else alpha
        ids = greedy(group, k, method, linked, bonus, beta, gamma, mmr_lambda)
        return pd.DataFrame({"qid": group["qid"].iloc[0], "id": ids, "rank": range(1, len(ids) + 1)})

    return pool.groupBy("qid").applyInPandas(over, PICKED)


def concentration(results: DataFrame, k: int = 8) -> DataFrame:
    """(qid, share, margin, dominant, concentrated) of each question's first k results(qid, nth, modality, score)."""
    top = results.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("nth"))).where(F.col("_n") <= k)
    kinds = top.groupBy("qid", "modality").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("_n").alias("first"))
    lead = kinds.groupBy("qid").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "modality", "best")).alias("d"), F.sum("n").alias("total"), F.max("best").alias("best"))
    other = kinds.join(lead.select("qid", F.col("d.modality").alias("_d")), "qid").where("modality != _d").groupBy("qid").agg(F.max("best").alias("other"))
    rows = lead.join(other, "qid", "left")
    share = F.col("d.n") / F.col("total")
    margin = F.when(F.col("best") > 0, (F.greatest(F.col("d.best"), F.lit(0.0)) - F.coalesce(F.col("other"), F.lit(0.0))) / F.col("best")).otherwise(1.0)
    return rows.select("qid", share.alias("share"), margin.alias("margin"), F.col("d.modality").alias("dominant"), ((share >= 0.75) | (margin >= 0.5)).alias("concentrated"))
