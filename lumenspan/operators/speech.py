"""What is said: terms that help a recogniser, punctuation put back, counts, levels, image hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T

# Everyday words of slides that no recogniser needs help with, and what a term is.
EVERYDAY = """the and for with that this from are can you our all not but how why who when where what which was have has his her
its one two use using used each more most than then they them there these those will would could should may might must into over
under also such some any per via based different same other only time cost low high new old first second third page""".split()
TERM = r"[A-Za-z][A-Za-z0-9\-]{2,}"
PROMPT = "A technical conference talk. Terminology used: %s."
MOST_TERMS = 75
#: Terms that a task counts before it passes them on.
MOST_COUNTED = 200_000
#: Tokens ahead that a spoken word is looked for.
AHEAD = 4


def distinctive_terms(texts: DataFrame, by: str, most: int = MOST_TERMS) -> DataFrame:
    """(by, rank, term): terms of texts(by, nth, text) by how many of them have it, then jargon, then length.

    A term is written with the most capitals it comes with, of equals the first way;
    jargon has a digit, a hyphen or a capital inside.
    """
    # a text has a term once: rows are counted where they are read, unless a text comes in several
    repeated = texts.groupBy(by, "nth").count().where("count > 1").limit(1).count() > 0
    pattern, everyday, kinds = re.compile(TERM), frozenset(EVERYDAY), dict(texts.dtypes)
    schema = f"`{by}` {kinds[by]}, key string, n long, capitals int, nth {kinds['nth']}, place int, written string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ways = {}, {}

        def told() -> pa.RecordBatch:
            rows = [(*k, n, -ways[k][0], ways[k][1][1], *ways[k][2:]) for k, n in counts.items()]
            counts.clear()
            ways.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            for group, nth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, first = {}, {}
                for i, w in enumerate(pattern.findall(text or "")):
                    if w not in places:
                        places[w] = i
                for w, i in places.items():
                    key = w.lower()
                    if key not in everyday:
                        way = (-sum(c.isupper() for c in w) if key != w else 0, (nth is not None, nth), i, w)
                        if key not in first or way < first[key]:
                            first[key] = way
                for key, way in first.items():
                    k = (group, key)
                    counts[k] = counts.get(k, 0) + 1
                    if k not in ways or way < ways[k]:
                        ways[k] = way
                if counts and (repeated or len(counts) > MOST_COUNTED):
                    yield told()
        if counts:
            yield told()

    found = texts.select(by, "nth", "text").mapInArrow(over, schema)
    n = F.countDistinct("nth") if repeated else F.sum("n")
    counted = found.groupBy(by, "key").agg(n.alias("n"), F.min_by("written", F.struct(-F.col("capitals"), F.col("nth"), F.col("place"))).alias("term"))
    jargon = F.col("term").rlike("[0-9-]|^.+[A-Z]").cast("int")
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.desc(jargon), F.desc(F.length("key")), "key"))
    return counted.withColumn("rank", order).where(F.col("rank") <= most).select(by, "rank", "term")


def recogniser_prompt(terms: DataFrame, by: str) -> DataFrame:
    """(by, prompt): what a recogniser is told of the terms."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ")
    return terms.groupBy(by).agg(F.format_string(PROMPT, listed).alias("prompt"))


def phrase_counts(text: Column, phrases: dict[str, tuple[str, ...]]) -> list[Column]:
    """How often each label's phrases stand in a text, case, hyphens and runs of space apart."""
    plain = T.collapsed(F.replace(F.lower(text), F.lit("-"), F.lit(" ")))
    count = lambda p: (F.length(plain) - F.length(F.replace(plain, F.lit(p), F.lit("")))) / F.lit(len(p))
    return [sum((count(p.lower().replace("-", " ")) for p in variants[1:]), count(variants[0].lower().replace("-", " "))).cast("long").alias(label) for label, variants in phrases.items()]


def punctuated(words: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """words(by, nth, text) with their punctuation, from segments(by, nth, text) that tell the same with it.

    Both are walked in step: a word takes the first of the next four tokens whose
    letters and digits are its own; one without such a token stays as it is.
    """
    core = lambda s: "".join(c for c in s if c.isalnum() or c in "_'").lower()

    def over(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth", kind="stable")
        tokens = " ".join(t or "" for t in told.sort_values("nth", kind="stable")["text"]).split()
        keys, at, out = [core(t) for t in tokens], 0, []
        for word in group["text"]:
            key = core(word)
            hit = next((k for k in range(at, min(at + AHEAD, len(keys))) if keys[k] == key), None)
            out.append(word if hit is None else tokens[hit])
            at = at if hit is None else hit + 1
        return group.assign(text=out)

    schema = words.select(by, "nth", "text").schema
    return words.select(by, "nth", "text").groupBy(by).cogroup(segments.select(by, "nth", "text").groupBy(by)).applyInPandas(over, schema)


def cut_inside(buckets: DataFrame, by: str) -> DataFrame:
    """(by, share) of buckets(by, bucket, nth, text): the share of buckets but the last that don't end a sentence."""
    last = buckets.groupBy(by, "bucket").agg(F.max_by("text", "nth").alias("_w"))
    final = F.max("bucket").over(Window.partitionBy(by))
    marked = last.withColumn("_final", final).withColumn("_cut", (~F.trim("_w").rlike(r"[.?!]$") & (F.col("bucket") < F.col("_final"))).cast("int"))
    return marked.groupBy(by).agg((F.sum("_cut") / F.greatest(F.count("*") - 1, F.lit(1))).alias("share"))


def level_profile(levels: DataFrame, by: str, bins: int) -> DataFrame:
    """(by, bin, level) of levels(by, nth, level): peaks of equal runs, the first ones longer by one if they don't divide, over the greatest."""
    w = Window.partitionBy(by)
    rows = levels.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("nth")) - 1)
    parts = F.least(F.lit(bins), F.col("_n"))
    small, extra = F.floor(F.col("_n") / parts), F.col("_n") % parts
    place = F.when(F.col("_i") < extra * (small + 1), F.floor(F.col("_i") / (small + 1))).otherwise(extra + F.floor((F.col("_i") - extra * (small + 1)) / small))
    peaks = rows.withColumn("bin", place.cast("long")).groupBy(by, "bin").agg(F.max("level").alias("level"))
    top = F.max("level").over(w)
    return peaks.withColumn("level", F.round(F.col("level") / F.when(top == 0, 1.0).otherwise(top), 3))


def difference_hash(pixels: Column, size: int = 8) -> Column:
    """64-bit hash of grey pixels, rows of size + 1 one after the other: whether each is darker than the one to its right, the first in the highest bit."""
    places = [(r * (size + 1) + c, size * size - 1 - (r * size + c)) for r in range(size) for c in range(size)]
    bit = lambda i, k: F.when(pixels[i + 1] > pixels[i], F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    out = bit(*places[0])
    for p in places[1:]:
        out = out.bitwiseOR(bit(*p))
    return out


def described(images: DataFrame, describe, words: int = 60) -> DataFrame:
    """images(digest, content) with a description, cut to so many words: each distinct image is described once; a failed call gives ''."""

    @F.pandas_udf("string")
    def call(content: pd.Series) -> pd.Series:
        def one(x: bytes) -> str:
            try:
                return describe(x)
            except OSError:
                return ""

        return content.map(one)

    once = images.dropDuplicates(["digest"]).select("digest", F.array_join(F.slice(T.words(call(F.col("content"))), 1, words), " ").alias("description"))
    return images.join(once, "digest")


def embedded(texts: DataFrame, encode, text: str = "text") -> DataFrame:
    """texts with an embedding: each distinct text goes to the encoder once. encode maps a list of texts to vectors."""

    @F.pandas_udf("array<double>")
    def call(column: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float64) for v in encode(column.tolist())])

    once = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("embedding", call(F.col("_text")))
    return texts.join(once, F.col(text) == F.col("_text"), "left").drop("_text")
