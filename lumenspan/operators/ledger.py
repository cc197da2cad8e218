"""Accounts of model use: prices, spending, limits, the reply cache and its queue, corpus manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("calls", "cached_calls", "prompt_tokens", "completion_tokens", "cached_prompt_tokens", "cached_completion_tokens", "reasoning_tokens", "failed_calls", "audio_seconds", "cached_audio_seconds", "estimated_tokens")


def price_for(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, ...) with price of the longest prefix(prefix, price) that its model begins with, null without one.

    Joined once for each distinct model. The price list is a short, given table.
    """
    models = usage.select("model").distinct()
    met = models.join(F.broadcast(prices), F.col("model").startswith(F.col("prefix")))
    best = met.groupBy("model").agg(F.max_by("price", F.length("prefix")).alias("price"))
    return usage.join(best, "model", "left")


def cost(price: Column, prompt: Column, completion: Column, cached_prompt: Column, cached_completion: Column, seconds: Column, charge_cached: bool = False) -> Column:
    """US dollars of tokens, without cached ones unless they are charged, and of minutes of audio; null without a price."""
    asked = prompt if charge_cached else prompt - cached_prompt
    said = completion if charge_cached else completion - cached_completion
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(price.isNotNull(), (asked * zero(price["input"]) + said * zero(price["output"])) / 1e6 + seconds / 60 * zero(price["per_minute"]))


def totals(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of all counters and of the cost, and how many rows have no price."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE if c in ledger.columns]
    return ledger.groupBy(*(by or [])).agg(*sums, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def budget(ledger: DataFrame, by: list[str], order: str, limit: float) -> DataFrame:
    """ledger with spent so far and refused: a priced row that would pass the limit, or an unpriced one under a limit."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.withColumn("spent", F.sum(F.coalesce("cost", F.lit(0.0))).over(w))
    return rows.withColumn("refused", F.when(F.col("cost").isNull(), F.lit(True)).when(F.col("cost") == 0, F.lit(False)).otherwise(F.col("spent") > limit))


def slot(system: Column, user: Column) -> Column:
    """Key of a reply: a digest of both prompts."""
    return F.sha2(F.concat(system, F.lit("\u0000"), user), 256)


def numbered_slots(calls: DataFrame, order: str) -> DataFrame:
    """calls with slot and nth: repeats of a prompt are calls of their own."""
    keyed = calls.withColumn("slot", slot(F.col("system"), F.col("user")))
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy(order)) - 1)


def cached(calls: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, queue): calls(slot, nth, ...) with their stored reply(slot, nth, reply), and the first of each slot that has none."""
    answered = calls.join(replies, ["slot", "nth"])
    missing = calls.join(replies, ["slot", "nth"], "left_anti")
    return answered, missing.dropDuplicates(["slot", "nth"])


def stem(digest: Column, model: Column, words: int) -> Column:
    """File stem of a cached description: part of the image's digest, the model and the word limit."""
    return F.concat_ws("-", F.substring(digest, 1, 24), model, F.lit(str(words)))


def manifest(units: DataFrame, files: DataFrame) -> DataFrame:
    """(name, bytes, sha256, units): each file(name, content) with its units by modality."""
    counts = units.groupBy("source_file", "modality").agg(F.count("*").alias("n")).groupBy("source_file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "n")))).alias("units"))
    listed = files.select("name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return listed.join(counts, listed["name"] == counts["source_file"], "left").drop("source_file")


def manifest_hash(described: dict) -> str:
    """First 16 digits of the digest of a manifest's sorted compact JSON, without when it was made and its own hash."""
    kept = {k: v for k, v in described.items() if k not in ("created_utc", "hash")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def manifest_warning(stamp: str | None, current: str | None) -> str | None:
    """What is wrong with a stored manifest hash, or nothing."""
    if stamp is None:
        return "the gold file has no manifest stamp"
    if current is None:
        return "no manifest to compare with"
    return None if stamp == current else f"made for manifest {stamp}, but the corpus has {current}"


class Refused(RuntimeError):
    """What a policy doesn't let a run do."""


def refuse_strong(blocks: dict[str, dict], cheap: list[str], allow: bool = False, cache_only: tuple[str, ...] = ()) -> None:
    """Batch runs use cheap models, by prefix, or free ones; others need leave. A block that only replays stored replies can't spend."""
    for where, block in blocks.items():
        model = str(block.get("model", ""))
        if where in cache_only or allow or not model or block.get("billing") == "free":
            continue
        if not any(model == c or model.startswith(f"{c}-") for c in cheap):
            raise Refused(f"{where}: {model} is not a cheap model")


def refuse_ablation(backend: str, frozen: list[str], paths: list[str]) -> None:
    """An entailment model may not write what is kept: neither under the folders of gold, nor the reports themselves."""
    kept = [p for p in paths if any(p.rstrip("/") == f or p.startswith(f"{f}/") for f in frozen)]
    if backend == "nli" and kept:
        raise Refused(f"an ablation may not write {', '.join(kept)}")


def refuse_billing(judge: dict, max_cost: float, cache_only: bool) -> None:
    """A judge that bills needs a budget."""
    if not (cache_only or max_cost > 0 or judge.get("billing") == "free"):
        raise Refused(f"judge {judge.get('model')} bills: nothing was sent")


def allowed(check, *args, **options) -> bool:
    """Whether a policy lets something pass."""
    try:
        check(*args, **options)
    except Refused:
        return False
    return True
