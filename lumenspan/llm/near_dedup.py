"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document is the set of its distinct shingles of four words (A-Z in lower case); two
documents are linked if their sets have a Jaccard similarity of 0.8 or more. Links are
found between distinct sets only; equal sets are one class.

1. One pass over the texts: each set's digest, a MinHash signature of ``BANDS * ROWS``
   samples, the keys of its bands, and its odd sketch. The odd sketch folds the
   samples (place, value) into a bitmap by parity: each sample flips the bit it is
   hashed to. Bits of samples that two sets share cancel in the XOR of their sketches,
   so its population count estimates how many differ, sharply where few do:
   |difference| = -m/2 ln(1 - 2 p/m) for p bits of m.
2. Two sets with a similarity of 0.8 miss all of 32 bands of 5 rows once in 300,000.
   A bucket's pivot is the set with most company, counted over all its buckets: in a
   group of edited copies that is what they were copied from. Every set is paired with
   one other, of its buckets' pivots the one it shares most bands with, so a group of
   a thousand copies makes a thousand pairs. The pairs that the sketches allow are
   confirmed on the full sets, and components of the confirmed links are formed.
3. Buckets that still hold more than one component are looked at again: the sets
   outside the bucket's largest component are compared with all sets of the bucket, in
   tiles of bounded size, by their odd sketches. Of the pairs that these allow, a
   second bitmap, of the parity of all shingles, tells similarities near 0.8 apart.
   First each set's closest likely links are confirmed and components formed anew,
   then every pair of different components that both bitmaps allow. No link between components is left: a pair inside one
   component would change nothing, and any other with a shared band is compared.

The thresholds of both bitmaps lie about five deviations below what a link gives, so
they spare confirmations and decide nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise
from .graph import components

SHINGLE = 4
#: In hundredths, so that the comparison is one of whole numbers.
SIMILARITY = 80
BANDS, ROWS = 32, 5
SKETCH_BITS = 256
#: Estimated similarity below which a pair isn't confirmed.
ESTIMATE = 0.6
#: Bits of the parity bitmap of all shingles, and deviations by which it may exceed what a link's differing shingles give.
PARITY_BITS, DEVIATIONS = 1024, 5.0
#: Rows of ids, 16 bytes each, up to which they are sent to the texts; more of them, and the texts, are dealt by document.
SENT = 1_000_000
#: What is compared of two band keys to find the first that two sets share.
MARK = 0x7FFFFFFF
#: Sets of a bucket that are compared in one task at a time.
TILE = 1024
#: Likely links of a set to other components that are confirmed before all possible ones.
CLOSEST = 3
#: Words whose digests a task remembers.
MEMO = 1_000_000
#: Odd 64-bit multipliers, one for each MinHash sample.
MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of a 64-bit hash: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """Digest of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, digests: Digests) -> np.ndarray:
    """The sorted digests of a text's distinct shingles.

    bytes.lower() and bytes.split() know ASCII letters and white space only.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(digests.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total = mixed(total ^ h[i : i + n])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """The least product of the set's digests with each multiplier."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, np.multiply.outer(MULTIPLIERS, found[i : i + 2048]).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band, which holds the band's number as well."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = mixed(key ^ column)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as four 64-bit words."""
    bits = mixed(samples ^ (np.arange(len(samples), dtype=np.uint64) << np.uint64(56))) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of all shingles of a set, as 64-bit words."""
    odd = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def estimate_floor_bits(similarity: float) -> int:
    """The most bits by which two sketches may differ for an estimate of at least so much."""
    differing = 2 * BANDS * ROWS * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, text_key, n_shingles, digest, bands, sketch, parity).

    Documents without words have none of the last four.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = memos.setdefault("words", Digests())
        n, digest, bands, sketch, whole = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, memo)
            n.append(len(found))
            if len(found):
                samples = signature(found)
                digest.append(set_digest(found))
                bands.append(band_keys(samples))
                sketch.append(odd_sketch(samples))
                whole.append(parity(found))
            else:
                for column in (digest, bands, sketch, whole):
                    column.append(None)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs), pa.array(whole, longs)],
            ["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch", "parity"],
        )

    memos: dict[str, Digests] = {}
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, over, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) for the classes in wanted(doc_id, text_key), read from the texts of their first documents.

    wanted is a table of 16 bytes a row. Counted first, it is sent to the texts if it has
    no more than SENT rows; a larger one, and the texts, are dealt by document. Left to the
    optimiser's own bound, the texts were dealt at half a GB and not at a tenth.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = memos.setdefault("words", Digests())
        found = [shingles(text, memo) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(map(set_digest, found), pa.binary()), pa.array((x.tobytes() for x in found), pa.binary())], ["digest", "shingles"])

    memos: dict[str, Digests] = {}
    first = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    first = F.broadcast(first) if wanted.count() <= SENT else first
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (F.xxhash64("text") == first["_key"]), "left_semi")
    return map_batches(rows.select("text"), over, "digest binary, shingles binary").dropDuplicates(["digest"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, one = [], None, None
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
            if a != last:
                last, one = a, np.frombuffer(x.as_py(), np.uint64)
            other = np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate((one, other))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= SIMILARITY * (len(both) - shared))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
    with_sets = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return map_batches(with_sets, over, "a binary, b binary")


def differing(a: Column, b: Column, bits: int = SKETCH_BITS) -> Column:
    """Bits by which two sketches of so many bits differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def links(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, component) of the classes of equal sets that have a link; classes go by their digest."""
    some = sketched.where("digest IS NOT NULL")
    first = some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    first = first.select(F.col("digest").alias("_d"), F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    same = (some["digest"] == first["_d"]) & some["doc_id"].eqNullSafe(first["_id"]) & (some["text_key"] == first["_key"])
    classes = materialise(some.join(first, same, "left_semi").dropDuplicates(["digest"]), "classes")
    rows = classes.select("digest", F.explode("bands").alias("key"))
    shared_keys = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(rows.join(shared_keys, "key"), "members")
    # a set that many others resemble is in large buckets with most of its bands, one of those others is not
    central = members.groupBy("digest").agg(F.sum("n").alias("company"))
    pivots = members.join(central, "digest").groupBy("key").agg(F.max(F.struct("company", "digest"))["digest"].alias("pivot"))
    bits = estimate_floor_bits(ESTIMATE)
    # of the pivots of its buckets, each set is measured against the one it shares most bands with
    shared = members.join(pivots, "key").where("pivot != digest").groupBy("digest", "pivot").agg(F.count("*").alias("n"))
    nearest = shared.groupBy("digest").agg(F.max(F.struct("n", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("digest").alias("b"))
    best = with_sketches(nearest, classes).where(may_link(bits)).select("a", "b")
    edges = confirmed_links(docs, classes, best)
    grouped = materialise(components(edges), "components")
    # of the likely links to other components, each set's closest; then whatever is possible between those that are left
    likely = across(classes, members, grouped, 0.0)
    closest = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
    close = likely.withColumn("nth", closest).where(F.col("nth") <= CLOSEST).select("a", "b")
    grouped = merged(grouped, confirmed_links(docs, classes, close))
    return merged(grouped, confirmed_links(docs, classes, across(classes, members, grouped, DEVIATIONS).select("a", "b")))


def merged(grouped: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) with more links (a, b) taken in."""
    if more.isEmpty():
        return grouped
    return materialise(components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")


def confirmed_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are links, as a table."""
    pairs = materialise(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = materialise(classes.join(ends, "digest", "left_semi").select("doc_id", "text_key"), "wanted")
    return materialise(confirmed(pairs, full_sets(docs, wanted)), "links")


def with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with sketch_a, size_a, sketch_b and size_b."""
    for end in ("a", "b"):
        described = classes.select(F.col("digest").alias(end), F.col("sketch").alias(f"sketch_{end}"), F.col("n_shingles").alias(f"size_{end}"))
        pairs = pairs.join(described, end)
    return pairs


def similar_size() -> Column:
    """False for pairs whose sizes alone rule a link out."""
    return F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * SIMILARITY


def may_link(bits: int) -> Column:
    """False for pairs whose sizes or sketches rule a link out."""
    return similar_size() & (differing(F.col("sketch_a"), F.col("sketch_b")) <= bits)


def allowed_bits(members: np.ndarray, deviations: float) -> np.ndarray:
    """Most bits by which the parity bitmaps of linked sets with so many members together differ, so many deviations allowed.

    Of two sets with s members together, a link differs by s * (1 - j) / (1 + j) at most.
    n of them set m/2 (1 - (1 - 2/m)^n) bits on the mean; their variance is the known
    one of cells with an odd number of n balls thrown into m.
    """
    m = float(PARITY_BITS)
    n = members * ((100 - SIMILARITY) / (100 + SIMILARITY))
    once, twice = (1 - 2 / m) ** (2 * n), (1 - 4 / m) ** n
    variance = m / 4 * (1 - once) + m * (m - 1) / 4 * (twice - once)
    return m / 2 * (1 - np.sqrt(once)) + deviations * np.sqrt(np.maximum(variance, 0.0)) + 0.5


def compared(group: pa.Table, deviations: float) -> pa.Table:
    """Pairs (a, b, bits) of one tile of a bucket that differ in component and may be linked."""
    side = group["side"].to_numpy()
    digest = np.array(group["digest"].to_pylist(), dtype="S16")
    component = np.array(group["component"].to_pylist(), dtype="S16")
    largest = component == np.array(group["largest"].to_pylist(), dtype="S16")
    rank = np.unique(digest, return_inverse=True)[1]
    home = np.unique(component, return_inverse=True)[1]
    size = group["size"].to_numpy()
    sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(side), -1)
    words = group["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(side), -1)
    marks = group["marks"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
    mark = group["key"][0].as_py() & MARK
    ones, others = np.flatnonzero((side != 1) & ~largest), np.flatnonzero(side != 0)
    found = []
    for part in (ones[i : i + 128] for i in range(0, len(ones), 128)):
        x, y = part[:, None], others[None, :]
        # two sets outside the largest component would meet in either order: one is enough
        open_ = (home[x] != home[y]) & (largest[y] | (rank[x] < rank[y]))
        open_ &= np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * SIMILARITY
        at, to = np.nonzero(open_)
        at, to = part[at], others[to]
        alike = np.bitwise_count(sketch[at] ^ sketch[to]).sum(axis=1) <= estimate_floor_bits(ESTIMATE)
        at, to = at[alike], to[alike]
        bits = np.bitwise_count(words[at] ^ words[to]).sum(axis=1)
        near = bits <= allowed_bits(size[at] + size[to], deviations)
        at, to, bits = at[near], to[near], bits[near]
        # a pair that shares several buckets is told of in the first
        first = (marks[at] == marks[to]).argmax(axis=1)
        here = marks[at, first] == mark
        found.append((at[here], to[here], bits[here]))
    at, to, bits = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    column = group["digest"].combine_chunks()
    return pa.table({"a": column.take(pa.array(at)), "b": column.take(pa.array(to)), "bits": pa.array(bits.astype(np.int32))})


def across(classes: DataFrame, members: DataFrame, grouped: DataFrame, deviations: float) -> DataFrame:
    """Pairs (a, b, bits) of different components that share a bucket and whose sizes and bitmaps allow a link; bits tells how far apart they are."""
    labels = grouped.select(F.col("node").alias("digest"), "component")
    rows = members.select("key", "digest").join(labels, "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("component"))
    # a bucket whose sets are all of one component has nothing to add
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_keys = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("total")).where("parts > 1")
    marks = F.transform("bands", lambda key: key.bitwiseAND(F.lit(MARK)).cast("int")).alias("marks")
    described = classes.select("digest", "sketch", "parity", marks, F.col("n_shingles").alias("size"))
    tiles = mixed_keys.select("key", F.col("largest.component").alias("largest"), F.ceil(F.col("total") / TILE).cast("int").alias("tiles"))
    open_rows = rows.join(tiles, "key").join(described, "digest")
    # a bucket of up to TILE sets is one tile; a larger one is cut, and each tile of sets outside the largest component meets each tile of all
    own = F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    outside = F.when(F.col("component") != F.col("largest"), F.transform(every, lambda j: place(own, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    places = F.when(F.col("tiles") == 1, F.array(place(F.lit(0), F.lit(0), 2))).otherwise(F.concat(outside, F.transform(every, lambda i: place(i, own, 1))))
    dealt = open_rows.withColumn("place", F.explode(places)).select("key", "place.i", "place.j", "place.side", "digest", "component", "largest", "size", "sketch", "parity", "marks")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles follow each other; the last of a batch may go on in the next."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tile = np.stack([held[c].to_numpy() for c in ("key", "i", "j")])
            ends = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
            done = [compared(held.slice(x, y - x), deviations) for x, y in zip([0, *ends[:-1]], ends, strict=False)]
            held = held.slice(ends[-1]) if len(ends) else held
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held is not None:
            yield from compared(held, deviations).combine_chunks().to_batches()

    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInArrow(over, "a binary, b binary, bits int").distinct()


def resolved(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the hash of each row's text, text_key."""
    sketched = materialise(sketches(docs), "sketches")
    grouped = links(docs, sketched)
    ids = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    classed = ids.join(grouped.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    lowest = classed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classed.join(lowest, "component").select("digest", "component_id")
    out = sketched.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id of the documents that can be reached over
    links, the document's own included; kept marks the document that has it. A null or
    blank text has no shingles and is linked with nothing. Rows that repeat an id and
    text are copies of each other and have the same result. A null doc_id is larger
    than any other: such a document is in a component like others, and kept only in a
    component without an id. Further columns are not read.
    """
    return resolved(docs).drop("text_key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, and one of each set of repeated rows."""
    kept = resolved(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64("text") == kept["_key"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])
