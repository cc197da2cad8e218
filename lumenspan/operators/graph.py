"""Links between units as an edge table: checks, neighbours, expansion, subgraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Link types that retrieval follows unless told otherwise.
FOLLOWED = ("audio_slide", "figure_text", "deictic")


def checked(links: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): links whose ends are both units, and those with an unknown end. Parallel links all stay."""
    ids = units.select("id").distinct()
    source = links.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    kept = source.join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    dropped = links.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_anti").unionByName(source.join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti"))
    return kept.select(*links.columns), dropped.select(*links.columns)


def followed(links: DataFrame, types: tuple[str, ...] | None = FOLLOWED, min_score: float = 0.0) -> DataFrame:
    wanted = links if types is None else links.where(F.col("link_type").isin(list(types)))
    return wanted.where(F.col("score") >= min_score)


def neighbours(links: DataFrame, types: tuple[str, ...] | None = FOLLOWED, min_score: float = 0.0, direction: str = "both") -> DataFrame:
    """(id, neighbour, link_type, score): the best link of each type to each neighbour; order by (-score, neighbour)."""
    return sides(links, types, min_score, direction).groupBy("id", "neighbour", "link_type").agg(F.max("score").alias("score"))


def sides(links: DataFrame, types: tuple[str, ...] | None = FOLLOWED, min_score: float = 0.0, direction: str = "both") -> DataFrame:
    """(id, neighbour, link_type, score): every link from the ends that it is followed from, parallel ones too."""
    some = followed(links, types, min_score)
    out = some.select(F.col("src_id").alias("id"), F.col("dst_id").alias("neighbour"), "link_type", "score")
    back = some.select(F.col("dst_id").alias("id"), F.col("src_id").alias("neighbour"), "link_type", "score")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def _ranked(seeds: DataFrame) -> DataFrame:
    """seeds(qid, id, score) with a score by their place among those of the question."""
    w = Window.partitionBy("qid")
    place = F.row_number().over(w.orderBy(F.desc("score"), F.col("id")))
    return seeds.withColumn("score", (F.count("*").over(w) - place + 1) / F.count("*").over(w))


def expanded_scores(seeds: DataFrame, links: DataFrame, units: DataFrame, hops: int = 1, decay: float = 0.5, normalise: bool = True) -> DataFrame:
    """(qid, id, score, origin) as by expand(), without the ways: links are sides(), parallel ones too.

    The greatest score is all that is kept of the ways to a unit, so that links are dealt
    out once, by the unit that they lead from, and aren't aggregated before.
    """
    chosen = (_ranked(seeds) if normalise else seeds).select("qid", "id", F.col("score").cast("double").alias("score"), F.lit("seed").alias("origin"))
    frontier, known = chosen, units.select("id").distinct()
    steps = links.select(F.col("id").alias("_via"), F.col("neighbour").alias("id"), F.col("score").alias("_link"))
    for _ in range(hops):
        ways = frontier.select("qid", F.col("id").alias("_via"), F.col("score").alias("_from")).join(steps, "_via").join(known, "id", "left_semi")
        best = ways.groupBy("qid", "id").agg(F.max(F.col("_from") * F.col("_link") * decay).alias("score")).withColumn("origin", F.lit("expanded"))
        old = chosen.select("qid", "id", F.col("score").alias("_old"), F.col("origin").alias("_origin"))
        better = best.join(old, ["qid", "id"], "left").where("_origin IS NULL OR (_origin = 'expanded' AND score > _old)").select("qid", "id", "score", "origin")
        chosen = chosen.join(better.select("qid", "id"), ["qid", "id"], "left_anti").unionByName(better)
        frontier = better
    return chosen


def expand(seeds: DataFrame, edges: DataFrame, units: DataFrame, hops: int = 1, decay: float = 0.5, normalise: bool = True, final: int | None = None) -> DataFrame:
    """(qid, id, score, origin, via_seed, via_link, link_score): seeds(qid, id, score) and what their links lead to.

    A link leads from a chosen unit to its neighbour with score * link score * decay. A
    seed is never replaced; of several ways to a unit the best one stays, and of equal
    ones the first, as the frontier and the neighbours are ordered. With final, only so
    many of each question stay, by (-score, id).
    """
    w = Window.partitionBy("qid")
    seeds = _ranked(seeds) if normalise else seeds
    none = F.lit(None)
    chosen = seeds.select("qid", "id", F.col("score").cast("double").alias("score"), F.lit("seed").alias("origin"), none.cast("string").alias("via_seed"), none.cast("string").alias("via_link"), none.cast("double").alias("link_score"))
    frontier = chosen
    known = units.select(F.col("id").alias("neighbour")).distinct()
    for _ in range(hops):
        reached = (
            frontier.select("qid", F.col("id").alias("via_seed"), F.col("score").alias("_from"))
            .join(edges.withColumnRenamed("id", "via_seed").withColumnRenamed("score", "link_score"), "via_seed")
            .join(known, "neighbour", "left_semi")
            .select("qid", F.col("neighbour").alias("id"), (F.col("_from") * F.col("link_score") * decay).alias("score"), F.lit("expanded").alias("origin"), "via_seed", F.col("link_type").alias("via_link"), "link_score", F.col("_from"))
        )
        way = Window.partitionBy("qid", "id").orderBy(F.desc("score"), F.desc("_from"), "via_seed", F.desc("link_score"), "via_link")
        best = reached.withColumn("_n", F.row_number().over(way)).where("_n = 1").drop("_n", "_from")
        old = chosen.select("qid", "id", F.col("score").alias("_old"), F.col("origin").alias("_origin"))
        better = best.join(old, ["qid", "id"], "left").where("_origin IS NULL OR (_origin = 'expanded' AND score > _old)").drop("_old", "_origin")
        chosen = chosen.join(better.select("qid", "id"), ["qid", "id"], "left_anti").unionByName(better)
        frontier = better
    if final is None:
        return chosen
    return chosen.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("_n") <= final).drop("_n")


def ego(links: DataFrame, roots: DataFrame, hops: int = 1, types: tuple[str, ...] | None = None, min_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes(root, id), edges(root, links...)) within hops of each of roots(root), over links either way."""
    some = followed(links, types, min_score)
    steps = some.select(F.col("src_id").alias("id"), F.col("dst_id").alias("to")).unionByName(some.select(F.col("dst_id").alias("id"), F.col("src_id").alias("to"))).distinct()
    nodes = roots.select("root", F.col("root").alias("id"))
    for _ in range(hops):
        nodes = nodes.unionByName(nodes.join(steps, "id").select("root", F.col("to").alias("id"))).distinct()
    inside = some.join(nodes.withColumnRenamed("id", "src_id"), "src_id").join(nodes.withColumnRenamed("id", "dst_id"), ["root", "dst_id"])
    return nodes, inside.select("root", *links.columns)


def candidate_edges(results: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, a, b): pairs of a question's results(qid, id) with a link of any type either way."""
    r = results.select("qid", "id")
    pairs = links.select("src_id", "dst_id").distinct()
    met = pairs.join(r.withColumnRenamed("id", "src_id"), "src_id").join(r.withColumnRenamed("id", "dst_id"), ["qid", "dst_id"])
    one, back = met.select("qid", F.col("src_id").alias("a"), F.col("dst_id").alias("b")), met.select("qid", F.col("dst_id").alias("a"), F.col("src_id").alias("b"))
    return one.unionByName(back).distinct()


def expansion_report(results: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, expanded, linked_seeds): units that links added, and seeds with any link."""
    ends = links.select(F.col("src_id").alias("id")).unionByName(links.select(F.col("dst_id").alias("id"))).distinct().withColumn("_linked", F.lit(1))
    rows = results.join(ends, "id", "left")
    return rows.groupBy("qid").agg(F.count_if(F.col("origin") == "expanded").alias("expanded"), F.count_if((F.col("origin") == "seed") & F.col("_linked").isNotNull()).alias("linked_seeds"))


def round_robin(cited: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """(qid, neighbour, nth): uncited neighbours of cited(qid, n, id), each citation's best first, then its second best."""
    met = cited.join(edges, "id").join(cited.select("qid", F.col("id").alias("neighbour")), ["qid", "neighbour"], "left_anti")
    depth = F.row_number().over(Window.partitionBy("qid", "n").orderBy(F.desc("score"), "neighbour", "link_type"))
    first = F.row_number().over(Window.partitionBy("qid", "neighbour").orderBy("depth", "n"))
    distinct = met.withColumn("depth", depth).withColumn("_f", first).where("_f = 1")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("depth", "n"))
    return distinct.withColumn("nth", nth).where(F.col("nth") <= limit).select("qid", "neighbour", "nth")


def file_pairs(links: DataFrame, units: DataFrame) -> DataFrame:
    """links with the unordered pair of files (file_a, file_b) of their ends, null within one file or with an unknown end."""
    files = units.select("id", "source_file")
    joined = links.join(files.select(F.col("id").alias("src_id"), F.col("source_file").alias("_x")), "src_id", "left").join(files.select(F.col("id").alias("dst_id"), F.col("source_file").alias("_y")), "dst_id", "left")
    crosses = F.col("_x") != F.col("_y")
    return joined.select(*links.columns, F.when(crosses, F.least("_x", "_y")).alias("file_a"), F.when(crosses, F.greatest("_x", "_y")).alias("file_b"))


def with_overrides(links: DataFrame, ungated: DataFrame, overrides: DataFrame) -> DataFrame:
    """links(file_a, file_b, ...) without pairs set unrelated, and the ungated links of pairs set related. overrides(file_a, file_b, related)."""
    key = ["file_a", "file_b"]
    off, on = (overrides.where(F.col("related") == v).select(*key) for v in (False, True))
    kept = links.join(off, key, "left_anti").join(on, key, "left_anti")
    return kept.unionByName(ungated.join(on, key, "left_semi").select(*links.columns).select(*kept.columns))


def apply_verdicts(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """links with passed from verdicts(src_id, dst_id, link_type, nth, passed); the last verdict of an edge counts, for all its parallels."""
    key = ["src_id", "dst_id", "link_type"]
    last = verdicts.groupBy(*key).agg(F.max_by("passed", "nth").alias("passed"))
    return links.join(last, key, "left")


def gated(links: DataFrame) -> DataFrame:
    """Links that were judged related or never judged."""
    return links.where(F.coalesce(F.col("passed"), F.lit(True)))


def type_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("link_type").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """(link_type, n, passed), and a row of all with a null type."""
    return verdicts.rollup("link_type").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def set_diagnostics(results: DataFrame) -> DataFrame:
    """(qid, units, modalities, redundancy): redundancy is the mean cosine of results(qid, id, modality, embedding) of one modality."""
    from ..functions.stats import cosine

    a = results.select("qid", "modality", F.col("id").alias("a"), F.col("embedding").alias("x"))
    b = results.select("qid", "modality", F.col("id").alias("b"), F.col("embedding").alias("y"))
    pairs = a.join(b, ["qid", "modality"]).where("a < b").groupBy("qid").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("redundancy"))
    counts = results.groupBy("qid").agg(F.count("*").alias("units"), F.countDistinct("modality").alias("modalities"))
    return counts.join(pairs, "qid", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
