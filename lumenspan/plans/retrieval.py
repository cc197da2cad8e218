"""Retrieval plans: hybrid ranking, link following, several rounds, and the choice among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, ranking, selection

MODES = ("baseline", "linked", "iterative", "linked_iter")


@dataclass(frozen=True)
class Settings:
    """How much is ranked, fused, followed and kept."""

    top_k: int = 8
    candidates: int = 50
    rrf_k: int = 60
    k_seed: int = 5
    expansion: str = "additive"
    hops: int = 1
    decay: float = 0.5
    min_link_score: float = 0.0
    normalise: bool = True
    pool: int = 20
    rounds: int = 2


class Corpus:
    """Units(pos, id, modality, content, source_file, location, embedding) and links, ready to be asked."""

    def __init__(self, units: DataFrame, links: DataFrame | None = None) -> None:
        duplicate = units.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
        if duplicate:
            raise ValueError(f"units with one id: {[r.id for r in duplicate]}")
        self.units, self.links = units, links
        self.bm25 = ranking.Bm25(units)

    def hybrid(self, questions: DataFrame, s: Settings, k: int) -> DataFrame:
        """(qid, pos, id, score, nth): reciprocal-rank fusion of exact vector search and BM25 for questions(qid, text, embedding)."""
        dense = ranking.dense_top_k(self.units, questions, s.candidates)
        sparse = self.bm25.top_k(questions, s.candidates)
        fused = ranking.reciprocal_rank_fusion([dense, sparse], s.rrf_k)
        best = ranking.top_k(fused, "qid", k, F.desc("score"), "pos", name="nth")
        return best.join(self.units.select("pos", "id"), "pos").select("qid", "pos", "id", "score", "nth")

    def followed(self, seeds: DataFrame, s: Settings) -> DataFrame:
        """Seeds and what links lead to, in order nth; all of it, or the first top_k where expansions evict."""
        edges = graph.neighbours(self.links, min_score=s.min_link_score)
        final = s.top_k if s.expansion == "evict" else None
        grown = graph.expand(seeds.select("qid", "id", "score"), edges, self.units, s.hops, s.decay, s.normalise, final)
        return ranking.top_k(grown, "qid", 1 << 30, F.desc("score"), "id", name="nth")

    def iterative(self, questions: DataFrame, s: Settings, propose) -> DataFrame:
        """(qid, id, score, round, nth): several rounds, each after the first with a query proposed from what was found.

        propose(questions, found) gives questions(qid, text, embedding) for the next
        round; a question that it leaves out is done. A unit keeps its best score and
        the first round that has it.
        """
        found = self.hybrid(questions, s, s.top_k).select("qid", "id", "score").withColumn("round", F.lit(1))
        asked = questions.select("qid", F.lower(F.trim("text")).alias("_t"))
        for n in range(2, s.rounds + 1):
            following = propose(questions, found)
            new = following.withColumn("_t", F.lower(F.trim("text"))).where("_t != ''").join(asked, ["qid", "_t"], "left_anti")
            asked = asked.unionByName(new.select("qid", "_t"))
            found = found.unionByName(self.hybrid(new.drop("_t"), s, s.top_k).select("qid", "id", "score").withColumn("round", F.lit(n)))
        best = found.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("round").alias("round"))
        return ranking.top_k(best, "qid", s.top_k, F.desc("score"), "id", name="nth")

    def pool(self, mode: str, questions: DataFrame, s: Settings = Settings(), propose=None) -> DataFrame:
        """(qid, id, score, nth) of a mode, cut to the pool's size."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}: one of {MODES}")
        k = s.k_seed if s.expansion == "evict" and mode.startswith("linked") else s.top_k
        if mode.endswith("iter") or mode == "iterative":
            seeds = self.iterative(questions, s, propose)
        else:
            seeds = self.hybrid(questions, s, k if mode == "linked" else s.pool)
        out = self.followed(seeds, s) if mode.startswith("linked") else seeds
        return out.where(F.col("nth") <= s.pool).select("qid", "id", "score", "nth")

    def chosen(self, mode: str, method: str, questions: DataFrame, s: Settings = Settings(), propose=None, gate: bool = False) -> DataFrame:
        """(qid, id, rank): a mode's pool after set selection. Only link modes let selection see links."""
        pool = self.pool(mode, questions, s, propose)
        described = pool.join(self.units.select("id", "modality", "embedding"), "id")
        edges = graph.candidate_edges(pool, self.links) if mode.startswith("linked") and self.links is not None else None
        return selection.select(described, s.top_k, method, edges, gate=gate)


def matrix(corpus: Corpus, questions: DataFrame, gold: DataFrame, modes=MODES[:2], methods=selection.METHODS, s: Settings = Settings()) -> DataFrame:
    """(mode, method, qid, recall, precision) of every mode and method, all questions at once."""
    from ..operators.evaluation import recall_precision

    cells = [recall_precision(corpus.chosen(m, how, questions, s), gold).select(F.lit(m).alias("mode"), F.lit(how).alias("method"), "qid", "recall", "precision") for m in modes for how in methods]
    return graph.union_all(cells)
