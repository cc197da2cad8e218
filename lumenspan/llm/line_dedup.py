"""Removal of lines that are spread over many sites.

Each distinct line is known by a digest of its trimmed text. A HyperLogLog sketch of
the sites it occurs on is built per map task and merged by aggregation, so a line
that a third of all documents share costs one sketch per task. A line estimated well
above the threshold is boilerplate, one well below is not; for lines whose estimate
is near the threshold the distinct sites are counted exactly. The sketches' relative
error is about 1.6 % at the default size, the band is 25 % either way (15 deviations),
and small counts are exact in the sketch itself, so the result is that of exact
counting.

The texts are split into lines once, into a table of places and digests. A line that a
third of all documents hold is one key with a third of all rows: where lines join the
few that are spread, keys are salted, so that such a line is dealt over many tasks.

Up to ``SENT`` digests of spread lines are sent to the texts, which stay where they are
read: no text is shuffled or sorted. Beyond, places of lines are joined with the digests
and the documents with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: log2 of the number of sketch registers: a relative error of 1.04 / sqrt(4096).
LOG_K = 12
#: Estimates within this share of the threshold are counted exactly.
BAND = 0.25
#: Parts that the rows of one line are dealt over.
SALTS = 32
#: Digests of spread lines, of 16 bytes each, that are sent to the texts.
SENT = 200_000
#: Texts that a worker cleans at once.
ROWS = 500


def line_key(line: Column) -> Column:
    """Digest of a line without the spaces around it."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def salted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows(_id, _hash, pos, key, ...) whose key is among keys(key); the rows of one key are dealt over SALTS parts."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("_id", "_hash", "pos"), F.lit(SALTS)).cast("int"))
    every = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return dealt.join(every, ["key", "salt"], "left_semi")


def spread_lines(rows: DataFrame, min_sites: int) -> DataFrame:
    """The keys of rows(_id, _hash, pos, key, site) that occur on min_sites distinct sites or more. Null sites don't count."""
    sketched = rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site"), F.lit(LOG_K))).alias("sites"))
    sketched = materialise(sketched.where(F.col("sites") >= min_sites * (1 - BAND)), "sites")
    sure = sketched.where(F.col("sites") > min_sites * (1 + BAND)).select("key")
    near = sketched.where(F.col("sites") <= min_sites * (1 + BAND)).select("key")
    exact = salted(rows, near).select("key", "site").distinct().groupBy("key").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("key")
    return sure.unionByName(exact)


def without_lines(docs: DataFrame, spread: set[bytes], spare_copies: bool) -> DataFrame:
    """docs without the lines whose digests are given, text by text: what ``remove_spread_lines`` returns."""
    sent = docs.sparkSession.sparkContext.broadcast(spread)
    blank = b"\t\n\v\f\r "

    def cleaned(text: bytes | None, known: set[bytes]) -> tuple[bytes | None, int, int]:
        if text is None:
            return None, 0, 0
        # lines are those that Spark splits: it replaces what isn't UTF-8
        lines = text.decode("utf-8", "replace").encode().split(b"\n")
        trimmed = [line.strip(b" ") for line in lines]
        hit = [bool(t) and hashlib.md5(t).digest() in known for t in trimmed]
        n_lines, n_removed = sum(map(bool, trimmed)), sum(hit)
        if n_removed:
            kept = b"\n".join(line for line, h in zip(lines, hit, strict=True) if not h)
            if kept.strip(blank) or not spare_copies:
                return kept, n_lines, n_removed
        return text, n_lines, 0

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # few rows at a time, so that a worker holds few texts twice
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                done = (cleaned(text, sent.value) for text in batch.column("text").cast(pa.binary()).to_pylist())
                text, n_lines, n_removed = zip(*done, strict=True)
                columns = [pa.array(text, pa.binary()).view(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "text", "n_lines", "n_removed"])

    rows = docs.select(*(docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_removed")), docs["text"])
    return rows.mapInArrow(over, T.StructType([*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, site: str = "source", spare_copies: bool = False) -> DataFrame:
    """docs(text, ...) with boilerplate lines removed; adds n_lines and n_removed.

    Lines end at a line feed; lines of spaces only are never boilerplate and stay where
    they are. n_lines counts the others. A null text has no lines and stays null, an
    empty table stays empty. All other columns are kept as they are, repeated rows
    included; columns named n_lines or n_removed are replaced. A document of
    boilerplate alone is left empty, unless ``spare_copies`` asks that documents
    without a word outside spread lines be left whole, as copies for near-duplicate
    removal to decide on.
    """
    lines = F.split(F.col("text"), "\n", -1)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col(site).alias("site"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.where(F.trim("line") != "").select("_id", "_hash", "site", "pos", line_key(F.col("line")).alias("key"))
    rows = materialise(rows, "lines")
    spread = materialise(spread_lines(rows.select("_id", "_hash", "pos", "key", "site"), min_sites), "spread")
    if spread.count() <= SENT:
        return without_lines(docs, {bytes(r.key) for r in spread.collect()}, spare_copies)
    hits = salted(rows.select("_id", "_hash", "pos", "key"), spread)
    hits = hits.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("pos")).alias("_hits"))
    # the row as one value: no column of docs can meet one of these steps
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    doc_id, text = F.col("row")["doc_id"], F.col("row")["text"]
    found = whole.join(hits, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left").select("row", "_hits")
    found = found.withColumn("lines", F.split(text, "\n", -1))
    # what stands between one removed line and the next
    stops = F.concat(F.array(F.lit(-1)), F.col("_hits"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_hits")), lambda k: F.slice(F.col("lines"), stops[k] + 2, stops[k + 1] - stops[k] - 1)))
    found = found.withColumn("kept", F.when(F.col("_hits").isNotNull(), F.array_join(kept, "\n")))
    use = F.col("kept").isNotNull()
    if spare_copies:
        use = F.coalesce(F.col("kept").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return found.select(
        *others,
        F.when(use, F.col("kept")).otherwise(text).alias("text"),
        F.coalesce(F.size(F.filter(F.col("lines"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(use, F.size("_hits")).otherwise(0).cast("long").alias("n_removed"),
    )
