"""Views of a corpus as its readers see it: units, files, pairs of files, answers and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from .evidence import ABSTENTION

#: Fixed order in which kinds of evidence are told of.
MODALITIES = ("text", "figure", "table", "audio")


def in_modality_order(names: Column) -> Column:
    """An array of kinds in the fixed order."""
    return F.filter(F.array(*map(F.lit, MODALITIES)), lambda m: F.array_contains(names, m))


def modality_mix(units: DataFrame, by: str) -> DataFrame:
    """(by, n, mix): how units are spread over kinds, like '8/8 audio' or 'text 2/8, audio 6/8'."""
    counts = units.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES))
    several = F.array_join(F.filter(F.array(*(F.when(F.col(m) > 0, F.format_string(f"{m} %d/%d", m, "n")) for m in MODALITIES)), lambda x: x.isNotNull()), ", ")
    only = F.coalesce(*(F.when(F.col(m) == F.col("n"), F.format_string(f"%d/%d {m}", "n", "n")) for m in MODALITIES))
    return counts.select(by, "n", F.coalesce(only, several).alias("mix"))


def unit_view(units: DataFrame) -> DataFrame:
    """(unit_id, kind, figure, file, start_s, end_s, page, bbox) of units(..., deck): times go before pages."""
    at = F.col("location")
    timed = at["start_s"].isNotNull()
    return units.select(
        F.col("id").alias("unit_id"), T.material_kind(F.col("modality"), F.col("deck")).alias("kind"), F.col("modality").isin("figure", "table").alias("figure"), T.file_name(F.col("source_file")).alias("file"),
        F.round(at["start_s"], 2).alias("start_s"), F.when(timed, F.round(F.coalesce(at["end_s"], at["start_s"]), 2)).alias("end_s"),
        F.when(~timed, at["page"]).alias("page"), F.when(~timed, F.transform(at["bbox"], lambda v: F.round(v, 1))).alias("bbox"),
    )


def of_topic(units: DataFrame, topic: str) -> DataFrame:
    """Units of files whose name begins with the topic and '_'."""
    return units.where(T.file_name(F.col("source_file")).startswith(f"{topic}_"))


def files_by_role(units: DataFrame) -> DataFrame:
    """(role, files): names of each role's files as they first come."""
    role = T.role_of(F.col("modality"), F.col("deck"))
    first = units.groupBy(role.alias("role"), T.file_name(F.col("source_file")).alias("file")).agg(F.min("pos").alias("pos"))
    return first.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"))


def main_recording(units: DataFrame) -> DataFrame:
    """Units of the recording whose name comes first."""
    audio = units.where("modality = 'audio'").withColumn("_file", T.file_name(F.col("source_file")))
    return audio.join(F.broadcast(audio.agg(F.min("_file").alias("_file"))), "_file", "left_semi").drop("_file")


def by_use(units: DataFrame, audio_file: str | None = None, deck_file: str | None = None) -> DataFrame:
    """units with use: 'audio', 'slide' (pages of decks; of any paged text where no unit is of a deck), 'text' (all paged text) and 'figure', a row for each use."""
    paged = (F.col("modality") == "text") & F.col("location.page").isNotNull()
    name = T.file_name(F.col("source_file"))
    some = units.where(paged).agg(F.coalesce(F.max(T.is_deck(F.col("deck")).cast("int")), F.lit(0)).alias("_decks"))
    slide = paged & (T.is_deck(F.col("deck")) | (F.col("_decks") == 0))
    uses = {
        "audio": (F.col("modality") == "audio") & (F.lit(audio_file is None) | (name == audio_file)),
        "slide": slide & (F.lit(deck_file is None) | (name == deck_file)),
        "text": paged,
        "figure": F.col("modality") == "figure",
    }
    told = F.filter(F.array(*(F.when(c, k) for k, c in uses.items())), lambda x: x.isNotNull())
    return units.crossJoin(F.broadcast(some)).withColumn("use", F.explode(told)).drop("_decks")


def corpus_stats(links: DataFrame, units: DataFrame) -> DataFrame:
    """(name, n): links by type, those kept, dropped, given and between files. What is kept and dropped must add up to what was given."""
    # every link meets its two ends once; of a unit in several rows one counts, and all may lie in another file
    n = F.row_number().over(Window.partitionBy("id").orderBy("source_file"))
    ends = units.where("id IS NOT NULL").select("id", "source_file", n.alias("_n"))
    side = lambda end, file, nth: ends.select(F.col("id").alias(end), F.col("source_file").alias(file), F.col("_n").alias(nth))
    met = links.select("src_id", "dst_id", "link_type").join(side("src_id", "_x", "_a"), "src_id", "left").join(side("dst_id", "_y", "_b"), "dst_id", "left")
    one = (F.coalesce("_a", F.lit(1)) == 1) & (F.coalesce("_b", F.lit(1)) == 1)
    kept = one & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = met.groupBy("link_type").agg(F.count_if(one).alias("all"), F.count_if(kept).alias("kept"), F.count_if(F.col("_x") != F.col("_y")).alias("crossing"))
    cell = lambda name, n: F.struct(name.alias("name"), n.alias("n"))
    k, a = F.col("kept"), F.col("all")
    told = counts.select(F.explode(F.array(cell(F.concat(F.lit("type "), "link_type"), k), *(cell(F.lit(c), v) for c, v in (("total", k), ("dropped", a - k), ("links", a), ("cross_file", F.col("crossing")))))).alias("c")).select("c.*")
    none = links.sparkSession.createDataFrame([(c, 0) for c in ("total", "dropped", "links", "cross_file")], "name string, n long")
    sums = told.unionByName(none).groupBy("name").agg(F.sum("n").alias("n")).where(F.coalesce(F.col("name").isin("total", "dropped", "links", "cross_file"), F.lit(False)) | (F.col("n") > 0))
    given = links.agg(F.count("*").alias("_given"))
    wrong = (F.col("name") == "links") & (F.col("n") != F.col("_given"))
    return sums.crossJoin(F.broadcast(given)).select("name", F.when(wrong, F.raise_error(F.lit("links kept and dropped don't add up")).cast("long")).otherwise(F.col("n")).alias("n"))


def pair_gates(gates: DataFrame) -> DataFrame:
    """(file_a, file_b, z, related) of gates(src_file, dst_file, z, related): the greater z of both directions, related if either is."""
    pair = T.pair_key(F.col("src_file"), F.col("dst_file"))
    return gates.groupBy(pair["a"].alias("file_a"), pair["b"].alias("file_b")).agg(F.max("z").alias("z"), F.bool_or("related").alias("related"))


def pair_rows(counts: DataFrame, gates: DataFrame, overrides: DataFrame, unsure_below: float) -> DataFrame:
    """(file_a, file_b, z, gate, setting, links, state) of all pairs that have links(n), a gate or an override.

    A pair that was linked by its recording's gate alone, with a z under the bar, is
    unsure.
    """
    key = ["file_a", "file_b"]
    rows = counts.select(*key, "n").join(gates, key, "full").join(overrides.select(*key, F.col("related").alias("_set")), key, "full")
    setting = F.when(F.col("_set").isNull(), "auto").when(F.col("_set"), "related").otherwise("unrelated")
    n, z = F.coalesce("n", F.lit(0)), T.finite(F.col("z"))
    unsure = F.col("_set").isNull() & (n > 0) & (F.col("kind") == "audio_slide") & (z < unsure_below)
    state = F.when(F.coalesce(unsure, F.lit(False)), "unsure").when(n > 0, "linked").otherwise("unlinked")
    return rows.select(*key, z.alias("z"), F.when(F.col("related").isNotNull(), F.when(F.col("related"), "related").otherwise("unrelated")).alias("gate"), setting.alias("setting"), n.alias("links"), state.alias("state"))


def explained(origin: Column, via_seed: Column, via_link: Column, link_score: Column) -> Column:
    """Why a unit was retrieved."""
    return F.when((origin == "expanded") & via_seed.isNotNull(), F.format_string("expanded from %s via %s (%.3f)", via_seed, via_link, link_score)).otherwise(origin)


def citations(replies: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, id, place) of replies(qid, reply): ids in brackets that are units, with their places."""
    cited = replies.select("qid", F.explode(T.cited_ids(F.col("reply"))).alias("id"))
    return cited.join(units.select("id", T.locator(F.col("source_file"), F.col("location")).alias("place")), "id").select("qid", "id", "place")


def packed_answers(claims: DataFrame, numbers: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, claims, summary, abstained) of claims(qid, nth, text, verdict, ids, answer): shown claims with the sorted numbers(qid, id, n) of what they cite."""
    shown = claims.where(~(F.lit(strict) & (F.col("verdict") == "unsupported")))
    cited = shown.select("qid", "nth", F.explode("ids").alias("id")).distinct().join(numbers, ["qid", "id"]).groupBy("qid", "nth").agg(F.array_sort(F.collect_set("n")).alias("citations"))
    rows = shown.join(cited, ["qid", "nth"], "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<bigint>")))
    found = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text", "verdict", "citations"))), lambda x: F.struct(x["text"].alias("text"), x["verdict"].alias("verdict"), x["citations"].alias("citations"))).alias("claims"))
    every = claims.groupBy("qid").agg(F.max("answer").alias("answer")).join(found, "qid", "left")
    none = F.col("claims").isNull()
    return every.select("qid", "claims", F.when(none, ABSTENTION).otherwise(F.col("answer")).alias("summary"), none.alias("abstained"))


def numbered_names(spark, prefix: str, most: int, only: list[str] | None = None, first: int | None = None) -> DataFrame:
    """(id) 'prefix1' to 'prefix<most>', those of a list alone, the first few."""
    ids = spark.range(1, most + 1).select("id", F.concat(F.lit(prefix), F.col("id").cast("string")).alias("name"))
    ids = ids if only is None else ids.where(F.col("name").isin(only))
    return (ids if first is None else ids.orderBy("id").limit(first)).select(F.col("name").alias("id"))


def status_coverage(ids: DataFrame, statuses: DataFrame) -> DataFrame:
    """(status, n) of all ids, those without a status as 'missing'."""
    return ids.join(statuses, "id", "left").groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def same_spans(slides: DataFrame, by: str) -> DataFrame:
    """(by, page, same): pages shown over one and the same span, each with all of them; pages alone in theirs aren't listed."""
    classes = slides.groupBy(by, "start", "end").agg(F.array_sort(F.collect_set("page")).alias("same")).where(F.size("same") > 1)
    return classes.select(by, F.explode("same").alias("page"), "same")


def near_edges(segments: DataFrame, edges: DataFrame, by: str, tolerance: float = 3.0) -> DataFrame:
    """segments(by, a, a0, a1) with near: whether an edge(by, t) lies within the tolerance of either end. Joined on bins of its width."""
    cell = lambda t, k: (F.floor(t / tolerance) + k).alias("_bin")
    marks = edges.select(F.col(by).alias("_by"), "t", F.explode(F.array(*(cell(F.col("t"), k) for k in (-1, 0, 1)))).alias("_bin")).distinct()
    ends = segments.select(by, "a", F.explode(F.array("a0", "a1")).alias("_end")).withColumn("_cell", F.floor(F.col("_end") / tolerance))
    close = (F.col(by) == F.col("_by")) & (F.col("_cell") == F.col("_bin")) & (F.abs(F.col("t") - F.col("_end")) <= tolerance)
    hit = ends.join(marks, close, "left_semi").select(by, "a").distinct().withColumn("_hit", F.lit(True))
    return segments.join(hit, [by, "a"], "left").withColumn("near", F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_of_page(units: DataFrame, read: DataFrame, all_pages: bool = False) -> DataFrame:
    """(file, page, text) of decks: each page's first text, what OCR read(file, page, text) where there is none, else '(page n)'. all_pages takes OCR's for every page."""
    first = units.where("modality = 'text'").groupBy(T.file_name(F.col("source_file")).alias("file"), F.col("location.page").alias("page")).agg(F.min_by("content", "pos").alias("_t"))
    both = read.select("file", "page", F.col("text").alias("_o")).join(first, ["file", "page"], "full")
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    order = [filled(F.col("_o"))] if all_pages else [filled(F.col("_t")), filled(F.col("_o"))]
    return both.select("file", "page", F.coalesce(*order, F.format_string("(page %d)", "page")).alias("text"))


def reviewed(drafts: DataFrame, sheet: DataFrame) -> DataFrame:
    """drafts(qid, question, expected_answer) as a sheet(qid, decision, edited_question, edited_answer, kind, reviewer) decides.

    Every row of the sheet needs a decision, and every draft a row: an error else.
    """
    decision = F.lower(F.trim("decision"))
    rows = drafts.join(sheet.withColumn("review", decision), "qid", "left")
    wrong = F.when(F.col("review").isNull(), F.concat(F.lit("no row for "), F.col("qid"))).when(~F.col("review").isin("accept", "edit", "reject"), F.concat(F.lit("no decision for "), F.col("qid")))
    checked = rows.withColumn("review", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("review"))).where("review != 'reject'")
    given = lambda edited, old: F.when((F.col("review") == "edit") & (F.trim(F.coalesce(edited, F.lit(""))) != ""), F.trim(edited)).otherwise(F.col(old)).alias(old)
    return checked.select("qid", given("edited_question", "question"), given("edited_answer", "expected_answer"), "kind", F.col("reviewer").alias("reviewed_by"), "review")


def control_counts(links: DataFrame) -> DataFrame:
    """(link_type, total, cross_file) over all known link types and a row of all: links of an unrelated pair must not cross files. Ids begin with their file and ':'."""
    crosses = F.split("src_id", ":")[0] != F.split("dst_id", ":")[0]
    counts = links.groupBy("link_type").agg(F.count("*").alias("total"), F.count_if(crosses).alias("cross_file"))
    types = links.sparkSession.createDataFrame([(t,) for t in T.LINK_TYPES], "link_type string")
    rows = types.join(counts, "link_type", "full").select("link_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "cross_file")))
    return rows.unionByName(rows.agg(F.lit("all").alias("link_type"), F.sum("total").alias("total"), F.sum("cross_file").alias("cross_file")))


def rejections(gates: DataFrame) -> DataFrame:
    """(n, rejected, share, low, middle, high): how many related pairs a gate turns away, and the spread of their z."""
    out = F.count_if(~F.col("related"))
    return gates.agg(F.count("*").alias("n"), out.alias("rejected"), (out / F.greatest(F.count("*"), F.lit(1))).alias("share"), F.min("z").alias("low"), F.median("z").alias("middle"), F.max("z").alias("high"))


def crosstab(rows: DataFrame, group: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """(group, verdicts..., n): counts of stated verdicts in each group."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(verdict) == v).alias(v) for v in verdicts), F.count("*").alias("n"))


def numbered_evidence(results: DataFrame) -> DataFrame:
    """(qid, id, n): the numbers that evidence of several answers to a question is cited by, as it first comes."""
    first = results.groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")).alias("n"))
