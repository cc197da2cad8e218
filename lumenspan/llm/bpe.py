"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by Spark, at ASCII white space. The tokenizer's own rules
never join anything across such white space (its normaliser composes no character with
it and its splitting pattern matches none), so the ids of a text are those of its words,
one after the other, and a word's ids don't depend on where it stands.

1. Each block of texts (about ``BLOCK_BYTES`` of words of one map task) lists its distinct
   words once, sorted, dealt by hash into buckets.
2. The distinct-word table is dealt by bucket: the lists of one bucket, of all blocks,
   meet in one task, one after the other, and every distinct word is encoded once.
3. Decoding: the ids of these words are joined with the id-to-piece table, which is as
   large as the vocabulary at any scale, and a word's pieces put together by position.
   Each list then goes back to its block with its words' ids and pieces.
4. The words of the texts travel to their block compressed. There each position of a
   text is joined with its word, and takes its ids and pieces: a join by position.

What moves is the distinct words of each block, not all its words, and the texts once,
all compressed. The join with the pieces runs on Arrow tables where the words are
encoded: as a join of Spark it took the table of distinct words through two more
shuffles, and more disk than the texts have. No task holds more than one block, or the
distinct words of one bucket; there are about as many buckets as the square root of the
number of blocks, with ``BUCKETS`` of them at least, so that buckets and the lists of a
block both stay small. A word that a third of all texts hold is one entry per block.
Should a lost task cut its blocks in another way when it runs again, a block's lists may
lack some of its words; those are encoded on the spot.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_thread, words

BLOCK_BYTES = 32_000_000
#: Texts are packed into rows of about so many bytes.
PACK_BYTES = 2_000_000
#: Least number of buckets, and how many there are where the size of the texts isn't known.
BUCKETS = 128
#: Distinct words that are encoded at a time; lists of ten times as many words at most wait for them.
AT_ONCE = 50_000


class WordEncoder:
    """Encodes words with a tokenizer that is given as its JSON text."""

    def __init__(self, definition: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def pieces_of(definition: str) -> list[str]:
    """The id-to-piece table: the piece of id i at place i."""
    parts = json.loads(definition)
    table = {i: piece for piece, i in parts["model"]["vocab"].items()} | {x["id"]: x["content"] for x in parts["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def read_definition(path: str) -> str:
    """The tokenizer file as text, read by the driver and sent with the tasks: a few MB at any scale."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def piece_table(spark, definition: str) -> DataFrame:
    """(id, piece), a row for each id of the vocabulary."""
    return spark.createDataFrame(list(enumerate(pieces_of(definition))), "id int, piece string")


def buckets_for(docs: DataFrame) -> int:
    """Buckets by the optimiser's estimate of the size of docs: four for each side of the square that the blocks fill."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return BUCKETS if size >= 2**60 else max(BUCKETS, min(2**16, 4 * math.isqrt(3 * size // BLOCK_BYTES)))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], pa.ListArray]]:
    """(block, keys, words) packs of a task's rows of (key, words); a block is a run of packs of BLOCK_BYTES together."""
    task, block, in_block = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.list_(pa.string()))
        # the bytes of all words before each row
        ends = texts.offsets.to_numpy()
        sizes = pc.binary_length(texts.values).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes + 1)))[ends] + 16 * np.arange(len(ends))
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(before, before[a] + PACK_BYTES)))
            b = min(b, len(keys))
            yield (task << 24) + block, keys[a:b], texts.slice(a, b - a)
            in_block += int(before[b] - before[a])
            if in_block >= BLOCK_BYTES:
                block, in_block = block + 1, 0
            a = b


def word_lists(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words): each block's distinct words, one sorted and compressed list for each bucket.

    No word has a line feed, so that one can end each word.
    """

    def lists(block: int, parts: list[pa.Array]) -> pa.RecordBatch:
        found = pc.unique(pa.chunked_array(parts)).cast(pa.binary()).to_pylist()
        dealt: dict[int, list[bytes]] = {}
        for word in sorted(found):
            dealt.setdefault(zlib.crc32(word) % buckets, []).append(word)
        press = zstandard.ZstdCompressor(level=9)
        blobs = [press.compress(b"\n".join(part)) for part in dealt.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array([block] * len(dealt), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "words"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for block, _, texts in blocks_of(batches):
            if block != at and parts:
                yield lists(at, parts)
                parts = []
            at = block
            parts.append(pc.unique(texts.flatten()))
        if parts:
            yield lists(at, parts)
            parts = []
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(over, "bucket int, block long, words binary")


def packed(rows: DataFrame) -> DataFrame:
    """(block, texts): the words of the texts in order, compressed in packs."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for block, keys, texts in blocks_of(batches):
            joined = pc.binary_join(texts, "\n").cast(pa.large_string())
            table = pa.table({"key": pa.array(keys, pa.int64()), "size": texts.value_lengths(), "text": joined})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "texts"])

    return rows.mapInArrow(over, "block long, texts binary")


def joined_pieces(ids: list[list[int]], pieces: pa.Table) -> list[str]:
    """For each word's ids its pieces joined by spaces: every (word, position, id) meets its row of pieces(id, piece)."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    word = np.repeat(np.arange(len(ids)), sizes)
    placed = pa.table({"word": word, "pos": np.arange(len(word)) - ends[word], "id": pa.array(itertools.chain.from_iterable(ids), pa.int32(), size=len(word))})
    told = placed.join(pieces, "id", use_threads=False).sort_by([("word", "ascending"), ("pos", "ascending")])["piece"].combine_chunks()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told), " ").to_pylist()


def encoded_lists(lists: DataFrame, definition: Broadcast) -> DataFrame:
    """(block, coded): the lists of words with their words' ids and pieces.

    The lists of a bucket follow each other in one task, which encodes each distinct word
    when it first comes.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bucket, known = WordEncoder(definition.value), None, {}
        named = pieces_of(definition.value)
        pieces = pa.table({"id": pa.array(range(len(named)), pa.int32()), "piece": pa.array(named, pa.string())})
        press, unpack = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
        held: list[tuple[int, int, list[bytes]]] = []
        fresh: dict[bytes, None] = {}
        words_held = 0

        def flush() -> pa.RecordBatch:
            """The lists held, once their new words are encoded; of what is known, the last bucket's words stay."""
            new = list(fresh)
            ids = encoder(new)
            for word, coded, decoded in zip(new, ids, joined_pieces(ids, pieces) if new else [], strict=True):
                known[word] = word + f"\t{' '.join(map(str, coded))}\t{decoded}".encode()
            blobs = [press.compress(b"\n".join([known[w] for w in found])) for _, _, found in held]
            out = pa.RecordBatch.from_arrays([pa.array([block for _, block, _ in held], pa.int64()), pa.array(blobs, pa.binary())], ["block", "coded"])
            if held[0][0] != held[-1][0]:
                last = {w for at, _, found in held if at == held[-1][0] for w in found}
                for word in [w for w in known if w not in last]:
                    del known[word]
            held.clear()
            fresh.clear()
            return out

        for batch in batches:
            for at, block, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words")), strict=True):
                if bucket != at and not held:
                    known.clear()
                bucket = at
                found = unpack.decompress(blob).split(b"\n")
                fresh.update((w, None) for w in found if w not in known)
                held.append((at, block, found))
                words_held += len(found)
                if len(fresh) >= AT_ONCE or words_held >= 10 * AT_ONCE:
                    yield flush()
                    words_held = 0
        if held:
            yield flush()
        # a worker that waits for its next task shall not hold what this one took
        known.clear()
        del encoder, pieces
        pa.default_memory_pool().release_unused()

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(over, "block long, coded binary")


def digests(ids: str, pieces: str) -> tuple[int, str, str]:
    """Token count, and SHA-256 of the ids and of the decoded text."""
    return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(pieces.encode()).hexdigest()


def tokens(ids: str, pieces: str) -> tuple[list[int], str]:
    """The ids themselves and the decoded text."""
    return [int(x) for x in ids.split(" ")] if ids else [], pieces


DIGESTS = (digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
TOKENS = (tokens, "ids array<int>, decoded string")


def split(text: str, mark: str) -> pa.Array:
    """The parts of a text as an array, without an object for each."""
    return pc.split_pattern(pa.array([text], pa.string()), mark).flatten()


class Block:
    """A block's distinct words by place, with their ids and pieces as text."""

    def __init__(self, blobs: Iterable[bytes], definition: Broadcast) -> None:
        unpack = zstandard.ZstdDecompressor()
        parts = [split(unpack.decompress(b).decode(), "\n") for b in blobs]
        fields = pc.split_pattern(pa.concat_arrays(parts) if parts else pa.array([], pa.string()), "\t")
        self.definition = definition
        self.words, self.ids, self.pieces = (pc.list_element(fields, k) if len(fields) else pa.array([], pa.string()) for k in range(3))

    def add(self, missing: list[str]) -> None:
        """Encodes words that the lists lack."""
        piece = pieces_of(self.definition.value).__getitem__
        ids = WordEncoder(self.definition.value)([w.encode() for w in missing])
        more = missing, [" ".join(map(str, x)) for x in ids], [" ".join(map(piece, x)) for x in ids]
        self.words, self.ids, self.pieces = (pa.concat_arrays([old, pa.array(new, pa.string())]) for old, new in zip((self.words, self.ids, self.pieces), more, strict=True))

    def texts(self, pack: pa.Table) -> Iterator[tuple[int | None, str, str]]:
        """(key, ids, pieces) of each text of a pack: every position takes those of its word."""
        sizes = pack["size"].to_numpy()
        some = "\n".join(t for t, n in zip(pack["text"].to_pylist(), sizes.tolist(), strict=True) if n)
        flat = split(some, "\n") if some else pa.array([], pa.string())
        place = pc.index_in(flat, value_set=self.words)
        if place.null_count:
            self.add(pc.unique(flat.filter(place.is_null())).to_pylist())
            place = pc.index_in(flat, value_set=self.words)
        # a word of invisible characters alone may have no token
        told = pc.greater(pc.binary_length(self.ids), 0).take(place).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(told, dtype=np.int64)))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        place = place.filter(pa.array(told))
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column.take(place)), " ").to_pylist() for column in (self.ids, self.pieces)]
        yield from zip(pack["key"].to_pylist(), *joined, strict=True)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", finish=TOKENS) -> DataFrame:
    """One row per row of docs: its key and what ``finish`` makes of its ids and pieces.

    ``tokenizer`` is the path of a tokenizer file on the driver. A null or blank text
    has no tokens. Null keys and repeated rows are kept, one result row each; columns
    other than key and text are not read. The result's order is not defined.
    """
    make, fields = finish
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_definition(tokenizer))
    rows = docs.select(F.col(key).cast("long").alias("key"), words(F.col(text)).alias("words"))
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([("key", pa.int64()), *((f.split()[0], kinds[f.split()[1]]) for f in fields.split(", "))])

    def assemble(coded: pa.Table, packs: pa.Table) -> pa.Table:
        block, unpack, out = Block(coded["coded"].to_pylist(), sent), zstandard.ZstdDecompressor(), []
        for pressed in packs["texts"].to_pylist():
            pack = pa.ipc.open_stream(unpack.decompress(pressed)).read_all()
            out += [(name, *make(ids, pieces)) for name, ids, pieces in block.texts(pack)]
        del block
        pa.default_memory_pool().release_unused()
        columns = zip(*out, strict=True) if out else [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    coded = encoded_lists(word_lists(rows, buckets_for(docs)), sent)
    out = coded.groupBy("block").cogroup(packed(rows).groupBy("block")).applyInArrow(assemble, f"key long, {fields}")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, decoded) for rows of (key, ids): a join of every id with its piece, put together by position.

    The id-to-piece table is as large as the vocabulary, whatever the data, and is
    broadcast. Rows with equal keys are told apart by a hash of their ids; equal rows give one.
    An id outside the vocabulary, or a null one, gives no piece; null ids give null,
    empty ones an empty text; an empty table gives an empty result; further columns are
    not read.
    """
    table = piece_table(encoded.sparkSession, read_definition(tokenizer))
    rows = encoded.select(F.col(key).alias("key"), F.xxhash64("ids").alias("hash"), "ids").dropDuplicates(["key", "hash"])
    placed = rows.select("key", "hash", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    texts = placed.groupBy("key", "hash").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("placed"))
    texts = texts.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), F.array_join(F.transform("placed", lambda x: x["piece"]), " ").alias("decoded"))
    joined = rows.join(texts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select(F.col("key").alias(key), F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("decoded"))
