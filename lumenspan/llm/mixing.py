"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size. It should receive the share of the total
that its weight gives, but never more than ``max_epochs`` times its own size; the
excess of the sources that reach that cap is shared out again by weight among the
others, until none is above its cap. The result is the level at which
``sum(min(cap, level * weight))`` equals the total, found in closed form: sources
are sorted by cap / weight, and the level follows from the running sums of the
caps before and of the weights after each place.

A source's target, divided by its size, gives whole repetitions of every document
and a fraction. The fraction is filled with documents in the order of a seeded
digest of their ids, up to the one whose middle reaches the missing words, so that
what is taken differs from the target by half a document at most. The order is cut
into ranges of digests first; only the one range a source's border falls into is
sorted, so no source's rows ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Hexadecimal digits that name a range of digests: 4096 ranges per source.
RANGE_DIGITS = 3


def cyclic_weights(sources: DataFrame, pattern: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights that repeat a pattern over the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(pattern) + 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), place.cast("int")))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight).

    Sources without words get a target of 0. A weight must be positive.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", total)
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    # the first place at which the level is below the cap: all from here on get level * weight
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), (-F.col("level")).alias("minus"))))
    open_level = -first.over(Window.partitionBy())["minus"]
    return levels.withColumn("open_level", open_level).select(
        "source", "source_size", "weight",
        F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap")))).alias("target"),
    )


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 17, weights=cyclic_weights, size: Column | None = None) -> DataFrame:
    """One row per document of docs(doc_id, text, source): what the mix takes of it.

    Returns doc_id, source, size, source_size, target, repeats and taken, where
    taken = repeats * size. ``weights`` maps a table of sources to one with a
    positive ``weight``. Null texts have size 0; null sources are a source of their
    own; rows repeated exactly, and null ids, are documents like others; further
    columns are left out. An empty table gives an empty result.
    """
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), digits.alias("digest"))
    sized = sized.withColumn("range", F.substring("digest", 1, RANGE_DIGITS))
    sized = materialise(sized, "sizes")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("below", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    epochs = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs))))
    share = water_fill(weights(sources), max_epochs).withColumn("epochs", epochs).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.floor("epochs").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("source_size")).alias("missing"),
    )
    # what each range of each source gets; documents join by source and range, so that a large source is dealt over many tasks
    plan = ranges.join(share, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", F.col("range").alias("_range"), "source_size", "target", "whole", "missing", "below",
        (F.col("below") + F.col("range_size") < F.col("missing")).alias("inside"), (F.col("below") >= F.col("missing")).alias("outside"),
    )
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["_source"]) & (sized["range"] == plan["_range"]))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    clear = rows.where("inside OR outside").select(*columns, (F.col("whole") + F.col("inside").cast("long")).alias("repeats"))
    running = Window.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("below") + F.sum("size").over(running) - F.col("size") / 2
    border = rows.where("NOT (inside OR outside)").select(*columns, (F.col("whole") + (middle <= F.col("missing")).cast("long")).alias("repeats"))
    return clear.unionByName(border).withColumn("taken", (F.col("repeats") * F.col("size")).cast("long"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it.

    Rows that the mix takes no time go. Rows with the same id and source (repeated
    rows) get the repetitions that all of them have in common.
    """
    counts = mix(docs, **options).groupBy("doc_id", "source").agg(F.min("repeats").cast("int").alias("_repeats"))
    counts = counts.withColumnsRenamed({"doc_id": "_doc_id", "source": "_source_of"})
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    same = F.col("row")["doc_id"].eqNullSafe(F.col("_doc_id")) & F.col("row")["source"].eqNullSafe(F.col("_source_of"))
    rows = whole.join(counts, same).where("_repeats > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("_repeats"))))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
