"""Evidence units: schema, ids and the ways texts are cut into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LOCATION = "struct<page:int,bbox:array<double>,start_s:double,end_s:double>"
UNITS = f"pos bigint, id string, modality string, content string, source_file string, location {LOCATION}"
#: Words for each token of a size in tokens.
WORDS_PER_TOKEN = 0.75
#: Places of a document's units in the order of all: enough for any document.
PER_DOCUMENT = 1 << 20


def location(page: Column | None = None, bbox: Column | None = None, start_s: Column | None = None, end_s: Column | None = None) -> Column:
    void = F.lit(None)
    parts = ((page, "page", "int"), (bbox, "bbox", "array<double>"), (start_s, "start_s", "double"), (end_s, "end_s", "double"))
    return F.struct(*((void if c is None else c).cast(kind).alias(name) for c, name, kind in parts))


def word_windows(words: Column, chunk_tokens: int = 300, overlap_tokens: int = 60) -> Column:
    """Array of windows over an array of words: a later window that only repeats the overlap is dropped."""
    size, lap = int(chunk_tokens * WORDS_PER_TOKEN), int(overlap_tokens * WORDS_PER_TOKEN)
    n, step = F.size(words), max(1, size - lap)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (n - s > lap)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, size).alias("words")))


def chunked(docs: DataFrame, key: str = "doc_id", chunk_tokens: int = 300, overlap_tokens: int = 60) -> DataFrame:
    """Units of docs(doc_id, text, source): sliding windows of words, placed by document and window."""
    # the words are a column of their own: inside the windows' expression each window would split the text again
    split = docs.select(F.col(key).alias("_doc"), "source", T.words(F.col("text")).alias("_words"))
    windows = split.select("_doc", "source", F.posexplode(word_windows(F.col("_words"), chunk_tokens, overlap_tokens)).alias("chunk", "window"))
    return windows.select(
        (F.col("_doc") * PER_DOCUMENT + F.col("chunk")).alias("pos"),
        F.concat(F.col("source"), F.lit(":p"), F.col("_doc").cast("string"), F.lit(":t"), F.col("chunk").cast("string")).alias("id"),
        F.lit("text").alias("modality"),
        F.array_join("window.words", " ").alias("content"),
        F.col("source").alias("source_file"),
        location(page=F.col("_doc")).alias("location"),
    )


def suffixed_ids(units: DataFrame) -> DataFrame:
    """Units with distinct ids: the nth unit of an id, in order, gets '#n' from the second on."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return units.withColumn("_nth", nth).withColumn("id", F.when(F.col("_nth") > 1, F.concat_ws("#", "id", "_nth")).otherwise(F.col("id"))).drop("_nth")


def role_sentences(units: DataFrame, role: Column, min_words: int = 5) -> DataFrame:
    """(role, sentence, id): distinct sentences of each role by their normal form, the first in order kept."""
    cut = units.withColumn("role", role).select("role", "id", "pos", F.posexplode(T.split_sentences(F.col("content"), min_words=min_words)).alias("nth", "sentence"))
    keyed = cut.withColumn("_key", T.normal(F.col("sentence")))
    first = F.row_number().over(Window.partitionBy("role", "_key").orderBy("pos", "nth"))
    return keyed.withColumn("_n", first).where("_n = 1").select("role", "sentence", "id")


def exclusive_terms(units: DataFrame, role: Column, min_length: int = 3) -> DataFrame:
    """(term, role, n) of terms that only one role has."""
    terms = units.select(role.alias("role"), F.explode(T.tokens(F.col("content"))).alias("term")).where((F.length("term") >= min_length) & ~F.col("term").rlike(r"^\d+$"))
    counted = terms.groupBy("term").agg(F.min("role").alias("role"), F.max("role").alias("_last"), F.count("*").alias("n"))
    return counted.where(F.col("role") == F.col("_last")).drop("_last")


def file_summary(units: DataFrame) -> DataFrame:
    """(source_file, units, pages, seconds) of each file."""
    return units.groupBy("source_file").agg(F.count("*").alias("units"), F.max("location.page").alias("pages"), F.max("location.end_s").alias("seconds"))


def reading_order() -> list[Column]:
    """Sort key of units as they are read: by time, then page, then id."""
    return [F.coalesce(F.col("location.start_s"), F.lit(-1.0)), F.coalesce(F.col("location.page"), F.lit(-1)), F.col("id")]


def full_context(units: DataFrame, source: Column) -> DataFrame:
    """(source, context): each source's units in reading order under their places."""
    line = F.concat(F.lit("["), T.locator(F.col("source_file"), F.col("location")), F.lit("] "), F.col("content"))
    placed = units.withColumn("_source", source).withColumn("_line", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(reading_order())), line.alias("line")))
    return placed.groupBy(F.col("_source").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["line"]), "\n").alias("context"))
