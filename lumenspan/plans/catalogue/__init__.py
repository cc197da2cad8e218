"""The query catalogue: every operator family over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accounts, joins, linking, measures, places, replies, search, stored, studies, texts

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def catalogue() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (texts, places, replies, search, joins, linking, measures, studies, stored, accounts):
        out |= module.QUERIES
    return out
