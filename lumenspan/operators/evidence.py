"""Answers from evidence and their checking, with models as callables on text columns.

A completer is a function from (system, user) columns to a reply column; ``python_completer``
makes one of a Python function over Arrow batches, and the offline ones here are native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import stats as S
from ..functions import text as T

ABSTENTION = "The evidence does not answer this question."


def python_completer(reply: Callable[[str, str], str]) -> Callable[[Column, Column], Column]:
    """A completer of a Python function, in Arrow batches."""

    @F.pandas_udf("string")
    def complete(system: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series([reply(a, b) for a, b in zip(system, user, strict=True)])

    return complete


def prompts(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, user): a question with its evidence(qid, rank, id, modality, source_file, location, content) in the order of rank."""
    place = F.concat_ws(" ", T.file_name(F.col("source_file")), T.cite(F.col("location")))
    block = evidence.groupBy("qid").agg(T.evidence_block(F.collect_list(F.struct("rank", "id", "modality", place.alias("place"), "content"))).alias("block"))
    return questions.join(block, "qid", "left").select("qid", F.concat(F.lit("Evidence:\n"), F.coalesce("block", F.lit("(none)")), F.lit("\n\nQuestion: "), F.col("question")).alias("user"))


def quoted_answers(evidence: DataFrame, questions: DataFrame, most: int = 3, chars: int = 220) -> DataFrame:
    """(qid, nth, text, id): up to three claims, each the sentence of a unit that shares most terms with the question.

    One sentence of a unit at most, none that shares no term; of equals the earlier.
    """
    asked = questions.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("_q"))
    rows = evidence.select("qid", "rank", "id", F.posexplode(T.premises(F.col("content"))).alias("_n", "sentence")).join(asked, "qid")
    scored = rows.withColumn("_s", F.size(F.array_intersect(T.tokens(F.col("sentence")), "_q"))).where("_s > 0")
    best = scored.withColumn("_b", F.row_number().over(Window.partitionBy("qid", "id").orderBy(F.desc("_s"), "_n"))).where("_b = 1")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_s"), "rank", "id"))
    return best.withColumn("nth", order).where(F.col("nth") <= most).select("qid", "nth", F.substring("sentence", 1, chars).alias("text"), "id")


def quoted_from_all(units: DataFrame, questions: DataFrame, most: int = 3, chars: int = 220) -> DataFrame:
    """quoted_answers of every question from all units(rank, id, content), with distinct ids.

    The questions are a stated set that every task gets; a task counts the terms that its
    sentences share with each, and passes on ``most`` sentences of a question.
    """
    asked = questions.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("tokens")).collect()
    ids, terms = list(dict.fromkeys(r.qid for r in asked)), sorted({t for r in asked for t in r.tokens or ()})
    column, row = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    met = sorted((row[t], column[r.qid]) for r in asked for t in r.tokens or ())
    first, askers = np.searchsorted([t for t, _ in met], np.arange(len(terms) + 1)), np.array([q for _, q in met], np.int64)
    vocabulary = pa.array(terms, pa.string())
    kinds = dict(units.dtypes) | dict(questions.dtypes)
    schema = f"qid {kinds['qid']}, shared long, rank {kinds['rank']}, id {kinds['id']}, sentence string"
    place = lambda x: (x is not None, x)  # noqa: E731  null goes first, as in SQL's order

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bar = [[] for _ in ids], np.ones(len(ids), np.int64)
        for part in (p for batch in batches for p in _parts(batch, "sentences", 4096)):
            ranks, names, texts = part.column("rank"), part.column("id"), part.column("sentences").flatten()
            lists = part.column("terms").flatten()
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            owner, term = np.repeat(np.arange(len(lengths)), lengths)[known], at.drop_null().to_numpy()
            # every known term of a sentence, with each question that has it
            times = first[term + 1] - first[term]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cells = np.repeat(owner, times) * len(ids) + askers[np.repeat(first[term], times) + nth]
            shared = np.bincount(cells, minlength=len(lengths) * len(ids)).reshape(len(lengths), len(ids))
            heads = np.r_[0, np.cumsum(pc.list_value_length(part.column("sentences")).to_numpy(zero_copy_only=False))]
            most_of = np.maximum.reduceat(shared, heads[:-1], axis=0)
            for u, q in zip(*np.nonzero(most_of >= bar), strict=True):
                n = heads[u] + int(shared[heads[u] : heads[u + 1], q].argmax())
                best[q].append((-int(shared[n, q]), place(ranks[u].as_py()), place(names[u].as_py()), texts[n].as_py()))
                if len(best[q]) > 8 * most:
                    best[q] = sorted(best[q])[:most]
                    bar[q] = -best[q][-1][0]
        rows = [(ids[q], -s, r[1], i[1], text) for q, found in enumerate(best) for s, r, i, text in sorted(found)[:most]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    out = to_arrow_schema(StructType.fromDDL(schema))
    cut = units.select("rank", "id", T.premises(F.col("content")).alias("sentences")).where(F.size("sentences") > 0)
    found = cut.select("rank", "id", "sentences", F.transform("sentences", lambda s: F.array_distinct(T.tokens(s))).alias("terms")).mapInArrow(over, schema)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("shared"), "rank", "id"))
    return found.withColumn("nth", order).where(F.col("nth") <= most).select("qid", "nth", F.substring("sentence", 1, chars).alias("text"), "id")


def _parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists have about so many items in all, or a row alone."""
    total, start = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def quotable(claim: Column, text: Column) -> Column:
    """The offline judge: a claim is supported if the text holds it word for word."""
    return T.span_in_text(claim, text)


def quoted_spans(docs: DataFrame, passages: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, item_id) of docs(doc_id, text) that hold a passage(item_id, text), as span_in_text() finds it.

    With exact, only those whose text has the passage as it stands. Passages are a stated
    set, which every task gets: texts aren't shuffled. A passage's inner words must all be
    words of the document, so documents are looked at by the one that comes least often. The first and last word may be parts of words: a
    passage without an inner word is held against every document.
    """
    inner = F.filter(F.flatten(F.transform(F.split("text", r"\.\.\.|…"), lambda p: F.slice(F.split(T.normal(p), " "), 2, F.greatest(F.size(F.split(T.normal(p), " ")) - 2, F.lit(0))))), lambda w: w != "")
    asked = passages.select("item_id", F.col("text").alias("passage"), F.array_distinct(inner).alias("words"))
    wanted = asked.select("item_id", F.explode("words").alias("word"))
    plain = docs.select("doc_id", *(["text"] if exact else []), T.normal(F.col("text")).alias("_hay"))
    held = plain.select(F.explode(F.split("_hay", " ")).alias("word")).join(F.broadcast(wanted.select("word").distinct()), "word")
    # a word that no document has makes its passage stand in none
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    sought = rarest.agg(F.collect_set("word").alias("_sought"))
    found = plain.crossJoin(F.broadcast(sought)).select(*plain.columns, F.explode(F.array_intersect(F.split("_hay", " "), "_sought")).alias("word"))
    near = found.join(F.broadcast(rarest.join(asked.select("item_id", "passage"), "item_id")), "word").select(*plain.columns, "item_id", "passage")
    bare = plain.crossJoin(F.broadcast(asked.where(F.size("words") == 0).select("item_id", "passage")))
    met = near.unionByName(bare).where(T.span_in_normal(F.col("passage"), F.col("_hay")))
    return (met.where(F.contains("text", F.col("passage"))) if exact else met).select("doc_id", "item_id").distinct()


def unit_votes(votes: DataFrame) -> DataFrame:
    """(claim, id, pos, supported) of votes(claim, id, pos, run, verdict, span, content): a yes without a span in the text is a no; strictly more yes than no."""
    yes = (F.col("verdict") == "yes") & T.span_in_text(F.coalesce("span", F.lit("")), F.col("content"))
    return votes.groupBy("claim", "id", "pos").agg((F.sum(yes.cast("int")) * 2 > F.count("*")).alias("supported"))


def claim_verdicts(claims: DataFrame, supported: DataFrame) -> DataFrame:
    """(qid, claim, verdict, id) of claims(qid, claim, cited array): weak without a citation, else supported by its first unit that does, else unsupported."""
    first = supported.where("supported").groupBy("claim").agg(F.min_by("id", "pos").alias("id"))
    verdict = F.when(F.size("cited") == 0, "weak").when(F.col("id").isNotNull(), "supported").otherwise("unsupported")
    return claims.join(first, "claim", "left").select("qid", "claim", verdict.alias("verdict"), F.when(F.size("cited") > 0, F.col("id")).alias("id"))


def answer_report(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """(qid, claims, supported, weak, unsupported, rate, abstains) of each answer."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    rows = verdicts.groupBy("qid").agg(F.count("*").alias("claims"), n("supported").alias("supported"), n("weak").alias("weak"), n("unsupported").alias("unsupported"))
    return rows.withColumn("rate", F.col("unsupported") / F.col("claims")).withColumn("abstains", (F.col("supported") == 0) if strict else F.lit(False))


def hallucination_rate(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unsupported claims over all claims, pooled."""
    return reports.groupBy(*(by or [])).agg(F.try_divide(F.sum("unsupported"), F.sum("claims")).alias("rate"))


def shown_answer(text: Column, surviving: Column, strict: bool) -> Column:
    return F.when(F.lit(strict) & (surviving == 0), ABSTENTION).otherwise(text) if strict else text


def citation_correctness(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, correct, cited, share): of the units that claims cite, with repeats, those among gold(qid, id)."""
    hit = gold.select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    rows = cited.join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.count("_hit").alias("correct"), F.count("*").alias("cited"))
    return rows.withColumn("share", F.col("correct") / F.col("cited"))


def relabelled(original: Column, audio: Column, deck: Column, paper: Column, together: Column) -> Column:
    """{type, reason}: a question's type by which sources alone answered it, each a pass flag; null drops it."""
    single = F.filter(F.array(F.when(audio, "audio"), F.when(deck, "deck"), F.when(paper, "paper")), lambda x: x.isNotNull())
    kind = F.when(~together & (F.size(single) == 0), None).when(F.size(single) == 1, F.concat(single[0], F.lit("_only"))).when(F.size(single) > 1, "single_modality").otherwise(F.when(original.isin("cross_modal", "deictic"), original).otherwise("cross_modal"))
    reason = F.when(kind.isNull(), "no source answers it").when(kind == original, "as proposed").otherwise(F.concat(F.lit("answered by "), F.when(F.size(single) > 0, F.array_join(single, ", ")).otherwise("all sources together")))
    return F.struct(kind.alias("type"), reason.alias("reason"))


def graded(votes: DataFrame) -> DataFrame:
    """(qid, passed, reason) of votes(qid, run, verdict, reason): passes by strict majority; the reason is the first of the side that won."""
    tally = votes.groupBy("qid").agg((F.count_if(F.col("verdict") == "PASS") * 2 > F.count("*")).alias("passed"))
    side = votes.join(tally, "qid").where((F.col("verdict") == "PASS") == F.col("passed"))
    return tally.join(side.groupBy("qid").agg(F.min_by("reason", "run").alias("reason")), "qid", "left")


def redundancy_summary(verdicts: DataFrame) -> DataFrame:
    """(source, target, n, entailed, share, low, high) of sentence verdicts, with a row of all where source is null."""
    rows = verdicts.groupingSets([("source", "target"), ()], "source", "target").agg(F.count("*").alias("n"), F.count_if("entailed").alias("entailed"))
    return rows.withColumn("share", F.col("entailed") / F.col("n")).withColumn("_w", S.wilson(F.col("entailed"), F.col("n"))).select("source", "target", "n", "entailed", "share", "_w.low", "_w.high")


def intake(share: Column, low: Column, high: Column, census: Column, bar: float) -> Column:
    """KEEP, REJECT or BORDERLINE: a census decides by its share, a sample must clear the bar with its whole interval."""
    return F.when(census, F.when(share < bar, "KEEP").otherwise("REJECT")).when(high < bar, "KEEP").when(low >= bar, "REJECT").otherwise("BORDERLINE")


def missing_evidence(linked: DataFrame, plain: DataFrame) -> DataFrame:
    """Evidence that only the linked run of a question has."""
    return linked.join(plain.select("qid", "id"), ["qid", "id"], "left_anti")


def entailment(pairs: DataFrame, score: Callable[[Column, Column], Column], margin: float = 0.0, min_words: int = 4) -> DataFrame:
    """(key, entailed, span, score) of pairs(key, premise, hypothesis), by a scorer of (sentence, hypothesis) that returns {yes, other}.

    The sentence of the premise with the greatest yes is the span; the first of equals.
    It must beat the greater of the other labels by the margin. Sentences of few words
    count only if there are no others. A blank hypothesis is never entailed.
    """
    cut = T.premises(F.col("premise"))
    long = F.filter(cut, lambda s: F.size(T.words(s)) >= min_words)
    rows = pairs.where(F.trim(F.coalesce("hypothesis", F.lit(""))) != "").select("key", F.posexplode(F.when(F.size(long) > 0, long).otherwise(cut)).alias("nth", "sentence"), T.collapsed(F.col("hypothesis")).alias("hypothesis"))
    scored = rows.withColumn("_s", score(F.col("sentence"), F.col("hypothesis")))
    best = scored.groupBy("key").agg(F.max_by(F.struct("sentence", "_s"), F.struct(F.col("_s")["yes"], -F.col("nth"))).alias("b"))
    out = pairs.select("key").distinct().join(best, "key", "left")
    carried = F.coalesce(F.col("b._s")["yes"] - F.col("b._s")["other"] > margin, F.lit(False))
    return out.select("key", carried.alias("entailed"), F.coalesce("b.sentence", F.lit("")).alias("span"), F.col("b._s")["yes"].alias("score"))


def entails_any(flags: DataFrame, by: str) -> DataFrame:
    """(by, entailed, span) of flags(by, nth, entailed, span): whether any fact is carried, and the span of the first that is."""
    return flags.groupBy(by).agg(F.bool_or("entailed").alias("entailed"), F.coalesce(F.min_by("span", F.when(F.col("entailed"), F.col("nth"))), F.lit("")).alias("span"))


def entails_all(flags: DataFrame, by: str) -> DataFrame:
    """(by, entailed): whether every fact is carried; none at all is no."""
    return flags.groupBy(by).agg(F.coalesce(F.bool_and("entailed"), F.lit(False)).alias("entailed"))


def word_overlap(sentence: Column, hypothesis: Column) -> Column:
    """An offline scorer for entailment(): the share of the hypothesis' terms that the sentence has, against the rest."""
    wanted = F.array_distinct(T.tokens(hypothesis))
    share = F.size(F.array_intersect(wanted, T.tokens(sentence))) / F.greatest(F.size(wanted), F.lit(1))
    return F.struct(share.alias("yes"), (1 - share).alias("other"))


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """A row for each unit of verdicts(qid, type, original_type, units: array<struct<unit_id, kept, span, reason, text>>), as an auditor sees it; a dropped question's type tells so."""
    kind = F.coalesce("type", F.concat(F.lit("dropped("), "original_type", F.lit(")")))
    rows = verdicts.select("qid", kind.alias("type"), F.explode("units").alias("u"))
    return rows.select("qid", "type", F.when(F.col("u.kept"), "kept").otherwise("dropped").alias("verdict"), "u.unit_id", T.collapsed(F.col("u.text")).alias("unit_text"), F.when(F.col("u.kept"), F.col("u.span")).otherwise(F.col("u.reason")).alias("span_or_reason"))


def gold_rows(verdicts: DataFrame, units: DataFrame, proposals: DataFrame) -> DataFrame:
    """(qid, type, gold_modalities, gold_unit_ids, gold_units, proposed, kept, topic) of questions that verification kept.

    Of their units only those kept are gold, in the order given; kinds come in the fixed
    order; what the proposal carried goes along.
    """
    from .views import in_modality_order

    listed = verdicts.where("type IS NOT NULL").select("qid", "type", F.size("units").alias("proposed"), F.posexplode("units").alias("nth", "u")).where("u.kept")
    found = listed.join(units.select(F.col("id").alias("_id"), "modality", T.locator_of(F.col("source_file"), F.col("location")).alias("place")), F.col("u.unit_id") == F.col("_id"))
    grouped = found.groupBy("qid", "type", "proposed").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("_id").alias("id"), "place"))).alias("g"), in_modality_order(F.collect_set("modality")).alias("gold_modalities"))
    rows = grouped.select("qid", "type", "gold_modalities", F.col("g")["id"].alias("gold_unit_ids"), F.col("g")["place"].alias("gold_units"), "proposed", F.size("g").alias("kept"))
    return rows.join(proposals.select("qid", "topic"), "qid", "left")


def source_runs(runs: DataFrame) -> DataFrame:
    """(qid, source, passed, reason) of runs(qid, source, context, run, verdict, reason): a source without text fails, others by strict majority."""
    some = F.trim(F.coalesce("context", F.lit(""))) != ""
    tally = runs.groupBy("qid", "source").agg(F.bool_or(some).alias("_some"), (F.count_if(F.col("verdict") == "PASS") * 2 > F.count("*")).alias("_won"))
    side = runs.join(tally, ["qid", "source"]).where((F.col("verdict") == "PASS") == F.col("_won")).groupBy("qid", "source").agg(F.min_by("reason", "run").alias("_why"))
    rows = tally.join(side, ["qid", "source"], "left")
    return rows.select("qid", "source", (F.col("_some") & F.col("_won")).alias("passed"), F.when(F.col("_some"), F.col("_why")).otherwise("no text from this source").alias("reason"))


def verified(proposed: DataFrame, runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(qid, type, reason, kept) of proposed(qid, type): relabelled by which sources alone answer it, and dropped, with a null type, without a kept unit.

    runs as for source_runs, with sources audio, deck, paper and all; kept(qid, n).
    """
    flags = source_runs(runs).groupBy("qid").agg(*(F.coalesce(F.bool_or((F.col("source") == s) & F.col("passed")), F.lit(False)).alias(s) for s in ("audio", "deck", "paper", "all")))
    rows = proposed.join(flags, "qid", "left").join(kept, "qid", "left").fillna({"audio": False, "deck": False, "paper": False, "all": False, "n": 0})
    told = relabelled(F.col("type"), F.col("audio"), F.col("deck"), F.col("paper"), F.col("all"))
    none = F.col("n") == 0
    return rows.select("qid", F.when(~none, told["type"]).alias("type"), F.when(none, "no proposed unit survived").otherwise(told["reason"]).alias("reason"), F.col("n").alias("kept"))


def grounding_table(answers: DataFrame) -> DataFrame:
    """(mode, method, claims, unsupported, rate, correctness, abstentions) of answers(mode, method, claims, unsupported, cited, correct, abstained)."""
    n = lambda c: F.sum(c).alias(c)
    return answers.groupBy("mode", "method").agg(n("claims"), n("unsupported"), F.try_divide(F.sum("unsupported"), F.sum("claims")).alias("rate"), F.try_divide(F.sum("correct"), F.sum("cited")).alias("correctness"), F.sum(F.col("abstained").cast("long")).alias("abstentions"))


def verdict_difference(a_type: Column, b_type: Column, a_kept: Column, b_kept: Column, n: Column, a_sources: Column, b_sources: Column, a_name: str, b_name: str) -> Column:
    """Why two verifications of a question type it differently, in a sentence."""
    word = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", ")).otherwise("none")
    return (
        F.when(b_type.isNull(), F.format_string(f"{b_name} kept %d of %d units, {a_name} %d", b_kept, n, a_kept))
        .when(a_type.isNull(), F.format_string(f"{a_name} dropped it, {b_name} kept %d of %d units", b_kept, n))
        .otherwise(F.format_string(f"answered by %s under {a_name}, by %s under {b_name}; kept %d and %d of %d units", word(a_sources), word(b_sources), a_kept, b_kept, n))
    )


def proposed_question(reply: Column) -> Column:
    """{question, answer} of a proposer's reply, null unless it has both."""
    read = F.from_json(T.json_object(reply), "struct<question:string,answer:string>")
    both = (F.trim(F.coalesce(read["question"], F.lit(""))) != "") & (F.trim(F.coalesce(read["answer"], F.lit(""))) != "")
    return F.when(both, read)
