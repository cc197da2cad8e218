"""Cutting ordered rows into segments.

What depends only on neighbouring rows is a window function: islands, runs, spans from
one row to the next. What starts anew from the row at which the last segment closed
must be walked in order; these take one group (a recording, a video, a batch of
requests) at a time through applyInPandas, and groups are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TERMINAL

WORDS = "by string, nth long, start double, end double, text string"


def islands(rows: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """rows numbered by island: a new one begins where starts is true, the first is 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn(name, F.sum(F.when(~first & F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sentences_of_words(words: DataFrame, by: list[str], order: str = "nth") -> DataFrame:
    """(by..., sentence, start, end, n, text): words(by..., nth, start, end, text) cut after '.', '!' or '?'."""
    before = F.lag("text").over(Window.partitionBy(*by).orderBy(order))
    cut = islands(words.withColumn("_ends", before.rlike(TERMINAL)), by, [order], F.col("_ends"), "sentence")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return cut.groupBy(*by, "sentence").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), line.alias("text"))


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., run, value, first, last, n): consecutive rows of one value; a null value breaks a run and has none."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = islands(rows.withColumn("_new", ~F.lag(value).over(w).eqNullSafe(F.col(value))), by, [order], F.col("_new"), "run")
    return numbered.where(F.col(value).isNotNull()).groupBy(*by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def spans_to_next(rows: DataFrame, by: list[str], t: str, last: float) -> DataFrame:
    """rows with end: the time of the next row, or last after its own."""
    return rows.withColumn("end", F.coalesce(F.lead(t).over(Window.partitionBy(*by).orderBy(t)), F.col(t) + last))


def spans_from_previous(rows: DataFrame, by: list[str], t: str, first: float) -> DataFrame:
    """rows with start: the time of the row before, or first before its own, not under 0."""
    return rows.withColumn("start", F.coalesce(F.lag(t).over(Window.partitionBy(*by).orderBy(t)), F.greatest(F.lit(0.0), F.col(t) - first)))


def _walk(rows: DataFrame, by: str, order: str, assign: Callable[[pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """rows with the segment that a walk in order gives each, one group at a time."""

    def over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        group[name] = assign(group)
        return group

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != name)
    return rows.groupBy(by).applyInPandas(over, f"{fields}, {name} long")


def fixed_spans(words: DataFrame, by: str, seconds: float = 30.0, order: str = "nth", start: str = "start", end: str = "end") -> DataFrame:
    """words with bucket: a new one begins at the word that ends more than seconds after the bucket's first began."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        out, bucket, anchor = np.empty(len(group), np.int64), 0, None
        for i, (a, b) in enumerate(zip(group[start], group[end], strict=True)):
            if anchor is not None and b - anchor > seconds:
                bucket, anchor = bucket + 1, a
            anchor = a if anchor is None else anchor
            out[i] = bucket
        return out

    return _walk(words, by, order, assign, "bucket")


def packed(groups: DataFrame, by: str, seconds: float = 30.0, order: str = "sentence", start: str = "start", end: str = "end") -> DataFrame:
    """Whole groups (sentences) with bucket: as many as fit seconds from the bucket's first start to the last end."""
    return fixed_spans(groups, by, seconds, order, start, end)


def closing_spans(rows: DataFrame, by: str, seconds: float, order: str = "nth", t: str = "t", start: str = "start") -> DataFrame:
    """rows with bucket: one closes with the row whose time is seconds or more after the bucket's start."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        out, bucket, anchor = np.empty(len(group), np.int64), 0, None
        for i, (a, b) in enumerate(zip(group[start], group[t], strict=True)):
            anchor = a if anchor is None else anchor
            out[i] = bucket
            if b - anchor >= seconds:
                bucket, anchor = bucket + 1, None
        return out

    return _walk(rows, by, order, assign, "bucket")


def without_repeats(rows: DataFrame, by: str, order: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """rows with kept (1 or 0): one too similar to any row kept before it goes. Compared with kept rows only, in order."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        kept: list[np.ndarray] = []
        out = np.zeros(len(group), np.int64)
        for i, v in enumerate(group[vector]):
            x = np.asarray(v, np.float64)
            x = x / max(float(np.linalg.norm(x)), 1e-9)
            if not kept or float(np.max(np.stack(kept) @ x)) <= threshold:
                kept.append(x)
                out[i] = 1
        return out

    return _walk(rows, by, order, assign, "kept")


def changed_frames(frames: DataFrame, by: str, t: str, value: str, change: float = 0.08) -> DataFrame:
    """frames with kept: the first, and each that differs from the last kept one by more than change on the mean."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        last, out = None, np.zeros(len(group), np.int64)
        for i, v in enumerate(group[value]):
            x = np.asarray(v, np.float64)
            if last is None or float(np.abs(x - last).mean()) > change:
                last, out[i] = x, 1
        return out

    return _walk(frames, by, t, assign, "kept")


def sampled_ticks(frames: DataFrame, by: str, t: str, step: float) -> DataFrame:
    """frames with kept: the first at or after each tick, where the next tick is a step after the kept frame's."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        due, out = None, np.zeros(len(group), np.int64)
        for i, x in enumerate(group[t]):
            if due is None or x + 1e-9 >= due:
                out[i], due = 1, (x if due is None else due) + step
        return out

    return _walk(frames, by, t, assign, "kept")


def differing(a: int, b: int) -> int:
    """Bits by which two signed 64-bit hashes differ."""
    return ((int(a) ^ int(b)) & (2**64 - 1)).bit_count()


def slides(frames: DataFrame, by: str, max_dist: int = 10, min_dur: float = 2.0, step: float = 1.0, dedup: bool = True) -> DataFrame:
    """(by, slide, hash, spans): frames(by, t, hash) cut where the hash changes by more than max_dist bits.

    Segments under min_dur join the one before; a segment like an earlier slide is a
    visit to it; spans of a slide that touch become one.
    """

    def over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable")
        segments: list[list] = []
        last = None
        for t, h in zip(group["t"], group["hash"], strict=True):
            if last is None or differing(last, h) > max_dist:
                segments.append([t, t + step, h])
            segments[-1][1] = t + step
            last = h
        merged: list[list] = []
        for s in segments:
            if merged and s[1] - s[0] < min_dur:
                merged[-1][1] = s[1]
            else:
                merged.append(s)
        found: list[tuple[int, list]] = []
        for a, b, h in merged:
            home = next((spans for g, spans in found if dedup and differing(g, h) <= max_dist), None)
            if home is None:
                found.append((h, [[a, b]]))
            elif home[-1][1] >= a:
                home[-1][1] = b
            else:
                home.append([a, b])
        return pd.DataFrame({by: group[by].iloc[0], "slide": range(len(found)), "hash": [h for h, _ in found], "spans": [s for _, s in found]})

    kind = dict(frames.dtypes)[by]
    return frames.groupBy(by).applyInPandas(over, f"{by} {kind}, slide long, hash long, spans array<array<double>>")


def build_groups(pages: DataFrame, by: str, min_tokens: int = 5) -> DataFrame:
    """pages(by, page, tokens) with island: a page that holds all tokens of the one before (five or more) builds on it."""
    before = F.lag("tokens").over(Window.partitionBy(by).orderBy("page"))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    holds = F.forall(F.array_distinct(F.col("_before")), lambda x: count(F.col("tokens"), x) >= count(F.col("_before"), x)) & (F.size("_before") >= min_tokens)
    return islands(pages.withColumn("_before", before), [by], ["page"], ~F.coalesce(holds, F.lit(False)), "island").drop("_before")


def quietest(levels: DataFrame, targets: DataFrame, by: str, search: float = 30.0, bucket: float = 0.5) -> DataFrame:
    """targets(by, target) with offset: the quietest bucket of levels(by, t, level) within search of it, else the target."""
    means = levels.groupBy(by, (F.floor(F.col("t") / bucket) * bucket).alias("at")).agg(F.avg("level").alias("level"))
    near = targets.join(means, by, "left").where(F.col("at").isNull() | (F.abs(F.col("at") - F.col("target")) <= search))
    best = near.groupBy(by, "target").agg(F.min(F.struct("level", "at")).alias("m"))
    joined = targets.join(best, [by, "target"], "left")
    return joined.select(by, "target", F.coalesce("m.at", "target").alias("offset"))


class _Room:
    """The room of one prompt's batches as a tree of maxima: the first with room is found on the way down."""

    def __init__(self, most: int, leaves: int = 64) -> None:
        self.most, self.leaves, self.numbers, self.held = most, leaves, [], []
        self.tree = [most] * (2 * leaves)

    def grow(self) -> None:
        own, self.leaves = self.tree[self.leaves :], self.leaves * 2
        self.tree = [self.most] * self.leaves + own + [self.most] * len(own)
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, n: int, items: int, number: int) -> int:
        """The batch that n goes to; number is that of a new one."""
        if len(self.numbers) == self.leaves:
            self.grow()
        tree, i = self.tree, 1
        if n <= self.most:
            while i < self.leaves:
                i *= 2
                i += tree[i] < n
        else:
            i = self.leaves + len(self.numbers)
        place = i - self.leaves
        if place == len(self.numbers):
            self.numbers.append(number)
            self.held.append(0)
        self.held[place] += 1
        # what is over the limit, or not a number, or of as many items as go in, is closed
        tree[i] = tree[i] - n if n <= self.most and self.held[place] < items else -1
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return self.numbers[place]


def fitted(sizes: list, prompts: list, most: int, items: int) -> np.ndarray:
    """The batch of each of the sizes in turn, by first fit, in a time of n log n."""
    rooms, out, new = {}, np.empty(len(sizes), np.int64), 0
    for k, (n, p) in enumerate(zip(sizes, prompts, strict=True)):
        room = rooms.get(p)
        if room is None:
            room = rooms[p] = _Room(most)
        out[k] = room.put(n, items, new)
        new += out[k] == new
    return out


def first_fit(rows: DataFrame, by: str, order: str, size: str, most: int, items: int, prompt: str | None = None) -> DataFrame:
    """rows with batch: each goes to the first batch of its group with room, at most items of most size, one prompt each if asked."""

    def assign(group: pd.DataFrame) -> np.ndarray:
        return fitted(group[size].tolist(), group[prompt].tolist() if prompt else [None] * len(group), most, items)

    return _walk(rows, by, order, assign, "batch")
