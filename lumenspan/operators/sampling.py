"""Samples of stated size, drawn by digests so that a rerun draws the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str | int, *key: Column) -> Column:
    """A number in [0, 1) from a seed and a key."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def strata(position: Column, total: Column, n: int) -> Column:
    """0-based stratum of a 0-based position when a total is cut into n equal ones with rounded edges."""
    return F.least(F.floor((position * n + n - 1) / total).cast("long"), F.lit(n - 1)) if n else F.lit(0)


def stratum_edges(total: Column, n: int) -> Column:
    """The n + 1 edges of equal strata, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.bround(k * total / n).cast("long"))


def systematic(rows: DataFrame, by: str, position: str, n: int, seed: str = "0") -> DataFrame:
    """One row of each of n strata by position of each group, drawn by seed; all rows where n is 0 or not under their number."""
    w = Window.partitionBy(by)
    counted = rows.withColumn("_t", F.count("*").over(w))
    if n == 0:
        return rows
    edges = counted.withColumn("_e", stratum_edges(F.col("_t"), n))
    place = F.size(F.filter("_e", lambda e: e <= F.col(position))) - 1
    placed = edges.withColumn("_k", F.least(place, F.lit(n - 1)))
    low, high = F.col("_e")[F.col("_k")], F.col("_e")[F.col("_k") + 1]
    pick = low + F.floor(draw(seed, F.col(by), F.col("_k")) * (high - low))
    return placed.where((F.col("_t") <= n) | (F.col(position) == pick)).drop("_t", "_e", "_k")


def stratified(rows: DataFrame, by: str, key: str, fraction: float, minimum: int, seed: str | int) -> DataFrame:
    """Of each stratum max(minimum, round(fraction * n)) rows."""
    n = F.count("*").over(Window.partitionBy(by))
    order = F.row_number().over(Window.partitionBy(by).orderBy(draw(seed, F.col(by), F.col(key)), key))
    return rows.withColumn("_n", n).withColumn("_o", order).where(F.col("_o") <= F.greatest(F.lit(minimum), F.bround(F.col("_n") * fraction))).drop("_n", "_o")


def topped_up(sample: DataFrame, rows: DataFrame, key: str, prefixes: list[str], minimum: int, seed: str | int) -> DataFrame:
    """sample with rows added until each prefix of the key has at least a minimum, or all there are."""
    out = sample
    for p in prefixes:
        have = out.where(F.col(key).startswith(p)).agg(F.count("*").alias("_have"))
        rest = rows.where(F.col(key).startswith(p)).join(out.select(key), key, "left_anti")
        order = F.row_number().over(Window.orderBy(draw(seed, F.lit(p), F.col(key)), key))
        added = rest.withColumn("_o", order).crossJoin(F.broadcast(have)).where(F.col("_o") <= minimum - F.col("_have")).drop("_o", "_have")
        out = out.unionByName(added.select(*out.columns))
    return out


def halves(keys: DataFrame, key: str, seed: str | int) -> DataFrame:
    """(key, part): tune and test halves by a seeded order."""
    place = F.row_number().over(Window.orderBy(draw(seed, F.col(key)), key))
    total = F.count("*").over(Window.partitionBy())
    return keys.select(key).distinct().withColumn("part", F.when(place <= F.floor(total / 2), "tune").otherwise("test"))


def shuffled_options(options: Column, gold: Column, *key: Column, seed: str | int = 0) -> Column:
    """{options, gold}: options in a seeded order, and where the right one went."""
    drawn = F.array_sort(F.transform(options, lambda o, i: F.struct(draw(seed, *key, i).alias("d"), i.alias("i"), o.alias("o"))))
    return F.struct(F.transform(drawn, lambda x: x["o"]).alias("options"), (F.array_position(F.transform(drawn, lambda x: x["i"]), gold.cast("int")) - 1).alias("gold"))


def one_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), parts)
