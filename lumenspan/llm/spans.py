"""Spans of several kinds in a text: order, digest and rendering shared by the scanners."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: (place of the kind in the scanner's list, start, end) in code points, end exclusive.
Span = tuple[int, int, int]


def in_order(spans: Iterable[Span]) -> list[Span]:
    """By start, then by kind as the scanner lists them."""
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def rendered(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in in_order(spans))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(rendered(spans, kinds).encode()).hexdigest()


def apart(found: Iterable[Span], taken: list[Span]) -> list[Span]:
    """Those of the found spans that overlap none of the taken ones nor an earlier one of their own. Linear but for sorting."""
    starts, reach = [], []
    for a, b in sorted((a, b) for _, a, b in taken):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    out: list[Span] = []
    last = 0
    for span in in_order(found):
        _, a, b = span
        before = bisect.bisect_left(starts, b)
        if b > a >= last and not (before and reach[before - 1] > a):
            out.append(span)
            last = b
    return out


def scan(docs: DataFrame, scanner: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, base, added): spans of base patterns, and those that the method adds.

    Each is an array of (kind, start, stop). A null text is an empty one.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [scanner(text) if text else ([], []) for text in batch.column(1).to_pylist()]
        columns = [[[{"kind": kinds[k], "start": a, "stop": b} for k, a, b in in_order(p[i])] for p in pairs] for i in (0, 1)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, kind) for c in columns)], ["doc_id", "text", "base", "added"])

    spans = "array<struct<kind:string,start:long,stop:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), over, f"doc_id long, text string, base {spans}, added {spans}")


def summary(docs: DataFrame, scanner: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    """One row per document: counts of base spans of each counted kind, their digest, and all spans as text."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [scanner(text) if text else ([], []) for text in batch.column(1).to_pylist()]
        counts = [pa.array((sum(s[0] == k for s in base) for base, _ in pairs), pa.int64()) for k in range(len(counted))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array((digest(base, kinds) for base, _ in pairs), pa.string()), pa.array((rendered([*base, *added], kinds) for base, added in pairs), pa.string())],
            ["doc_id", *(f"n_{k}" for k in counted), "base_sha256", "spans"],
        )

    fields = "".join(f"n_{k} long, " for k in counted)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), over, f"doc_id long, {fields}base_sha256 string, spans string")


def masked(docs: DataFrame, scanner: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...]) -> DataFrame:
    """docs(doc_id, text) with every span replaced by its kind in angle brackets.

    Null and empty texts stay as they are; null ids and repeated rows are kept, one
    result row each; further columns are not read.
    """

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            pieces, at = [], 0
            for k, a, b in in_order(s for part in scanner(text) for s in part) if text else ():
                if a >= at:
                    pieces += [text[at:a], f"<{kinds[k]}>"]
                at = max(at, b)
            out.append(text if text is None else "".join([*pieces, text[at:]]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), over, "doc_id long, text string")
