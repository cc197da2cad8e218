"""Replies and prompts, and the checking of answers: parsing, evidence, votes, verdicts, gold."""

from pyspark.sql import functions as F

from ...functions import stats as S
from ...functions import text as T
from ...operators import evidence, ledger, sampling, speech, views
from .base import CORPUS, clock, corpus, in_turn, table


def reply_parsing(spark, sf):
    """What is read out of replies that events make up."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    cited = F.concat(F.lit("see [u"), s(e % 7), F.lit("] and [u"), s(e % 3), F.lit("], [u"), s(e % 7), F.lit("] or [not an id]"))
    query = F.concat(F.lit('Search query: "who is '), s(e % 9), F.lit('"\nand more'))
    options = F.array(F.lit("alpha"), F.lit("beta two"), F.concat(F.lit("gamma"), s(e % 100)), F.lit("delta four"))
    reply = F.when(e % 4 == 0, F.lit("(b) because")).when(e % 4 == 1, F.lit(" Beta Two")).when(e % 4 == 2, F.concat(F.lit("D."), s(e))).otherwise("none of them")
    prompt = F.concat(F.lit("Evidence: "), s(e), F.lit(" lines\n\nQuestion: why "), s(e % 5))
    proposal = F.concat(F.lit('```json\n{"question": "q'), s(e), F.lit('", "answer": "'), F.when(e % 3 == 0, " ").otherwise("a"), F.lit('"} and {x}\n```'))
    split = T.shared_context(prompt, 14)
    made = evidence.proposed_question(proposal)
    return table(spark, sf, "events").select(
        "event_id", F.array_join(T.cited_ids(cited), ",").alias("cited"), T.clean_query(query).alias("query"), T.mcq_choice(reply, options).cast("string").alias("choice"), T.longest_option(options).alias("longest"),
        T.parse_mmss(F.when(e % 6 == 0, " ").otherwise(F.concat(s(e % 90), F.lit(":"), s(e % 60)))).alias("seconds"), split["context"].alias("context"), split["question"].alias("question"), made["question"].alias("made"),
    )


def fact_clauses(spark, sf):
    """Clauses of benchmark passages as facts to be stated, after a question for every second one."""
    text = F.concat(F.col("text"), F.lit("; that is so. no; See fig. 2 now. End"))
    with_question = T.facts(text, F.when(F.col("item_id") % 2 == 0, F.lit("Why?")).otherwise(" "))
    return table(spark, sf, "benchmark").select("item_id", F.size(with_question).cast("long").alias("n"), F.md5(F.array_join(with_question, "|")).alias("facts_md5"))


def prompt_blocks(spark, sf):
    """Prompts of questions with five units of evidence each, and the same as numbered passages."""
    u = corpus(spark, sf).withColumn("content", F.when(F.col("pos") % 6 == 0, " ").otherwise(F.substring("content", 1, 30)))
    found = u.select(F.floor(F.col("pos") / 5).alias("qid"), (F.col("pos") % 5).alias("rank"), "id", "modality", "source_file", "location", "content")
    asked = found.select("qid").distinct().withColumn("question", F.concat(F.lit("what of "), F.col("qid").cast("string")))
    prompts = evidence.prompts(found, asked)
    told = found.groupBy("qid").agg(T.passages(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])).alias("passages"))
    return prompts.join(told, "qid").select("qid", F.md5("user").alias("prompt_md5"), F.md5("passages").alias("passages_md5"))


def evidence_numbers(spark, sf):
    """Numbers of evidence that two runs of each question share."""
    u = corpus(spark, sf).select(F.floor(F.col("pos") / 10).alias("qid"), "id", (F.col("pos") % 10).alias("rank"))
    both = u.unionByName(u.withColumn("rank", (F.col("rank") * 7) % 10).where("rank < 6"))
    return views.numbered_evidence(both).withColumn("n", F.col("n").cast("long"))


def citation_map(spark, sf):
    """Cited units that exist, with their places."""
    p = F.col("pos")
    reply = F.concat(F.lit("as in ["), F.col("id"), F.lit("] and [src0:"), (p % 200).cast("string"), F.lit("]"))
    u = corpus(spark, sf)
    return views.citations(u.select(p.alias("qid"), reply.alias("reply")), u)


def _claims(spark, sf):
    p = F.col("pos")
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "weak", "unsupported"))), (p % 3 + 1).cast("int"))
    return corpus(spark, sf).select(F.floor(p / 4).alias("qid"), (p % 4).alias("nth"), F.concat(F.lit("claim "), p.cast("string")).alias("text"), F.when(F.floor(p / 4) % 9 == 0, "unsupported").otherwise(verdict).alias("verdict"), F.array("id", F.lit("nowhere")).alias("ids"), F.lit("an answer").alias("answer"))


def packed_answers(spark, sf):
    numbers = corpus(spark, sf).select(F.floor(F.col("pos") / 4).alias("qid"), "id", (F.col("pos") % 4 + 1).cast("long").alias("n"))
    rows = views.packed_answers(_claims(spark, sf), numbers)
    return rows.select("qid", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("n"), F.array_join(F.flatten(F.transform("claims", lambda c: c["citations"])), ",").alias("numbers"), "summary", "abstained")


def answer_reports(spark, sf):
    """Verdict counts and rates of answers, and the pooled rate by what they show."""
    r = evidence.answer_report(_claims(spark, sf), strict=True)
    shown = evidence.shown_answer(F.lit("an answer"), F.col("supported"), True)
    return r.select("qid", "claims", "supported", "weak", "unsupported", F.round("rate", 6).alias("rate"), "abstains", shown.alias("shown"))


def hallucination_rates(spark, sf):
    r = evidence.answer_report(_claims(spark, sf)).withColumn("part", F.col("qid") % 5)
    return evidence.hallucination_rate(r, ["part"]).select("part", F.round("rate", 6).alias("rate"))


def _votes(spark, sf):
    """Three runs' votes on whether units carry the first words of their own text."""
    p = F.col("pos")
    runs = corpus(spark, sf).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    span = F.when((p + F.col("run")) % 4 == 0, "zzqx not there").otherwise(F.substring("content", 1, 12))
    return runs.select(F.floor(p / 3).alias("claim"), "id", p.alias("pos"), "run", F.when((p * 7 + F.col("run") * 3) % 5 < 3, "yes").otherwise("no").alias("verdict"), span.alias("span"), "content")


def unit_votes(spark, sf):
    return evidence.unit_votes(_votes(spark, sf)).select("claim", "id", "supported")


def claim_verdicts(spark, sf):
    u = corpus(spark, sf)
    claims = u.select(F.floor(F.col("pos") / 3).alias("claim")).distinct().select((F.col("claim") % 100).alias("qid"), "claim", F.when(F.col("claim") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("cited"))
    return evidence.claim_verdicts(claims, evidence.unit_votes(_votes(spark, sf)))


def graded_answers(spark, sf):
    e = F.col("event_id")
    votes = table(spark, sf, "events").select(F.floor(e / 3).alias("qid"), (e % 3).alias("run"), F.when(F.col("value") * 100 % 7 < 4, "PASS").otherwise("FAIL").alias("verdict"), F.concat(F.lit("r"), e.cast("string")).alias("reason"))
    return evidence.graded(votes)


def _source_runs(spark, sf):
    e = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ("audio", "deck", "paper", "all"))), (F.floor(e / 3) % 4 + 1).cast("int"))
    passed = F.length("event_type") + e % 7 + F.floor(e / 36) % 5 > 12
    return table(spark, sf, "events").select(F.floor(e / 12).alias("qid"), source.alias("source"), F.when(F.floor(e / 3) % 5 == 0, " ").otherwise("text").alias("context"), (e % 3).alias("run"), F.when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.concat(F.lit("r"), e.cast("string")).alias("reason"))


def source_runs(spark, sf):
    return evidence.source_runs(_source_runs(spark, sf))


def verified_questions(spark, sf):
    """Questions relabelled by the sources that answer them alone, dropped without a kept unit."""
    runs = _source_runs(spark, sf)
    asked = runs.select("qid").distinct()
    kind = F.element_at(F.array(*map(F.lit, ("deictic", "cross_modal", "audio_only"))), (F.col("qid") % 3 + 1).cast("int"))
    kept = asked.select("qid", (F.col("qid") % 4).alias("n"))
    return evidence.verified(asked.select("qid", kind.alias("type")), runs, kept)


def _verdicts(spark, sf):
    p = F.col("pos")
    unit = F.struct(F.col("id").alias("unit_id"), (p % 3 != 0).alias("kept"), F.substring("content", 1, 15).alias("span"), F.lit("off  topic").alias("reason"), F.substring("content", 1, 60).alias("text"))
    rows = corpus(spark, sf).groupBy(F.floor(p / 4).alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", unit.alias("u")))), lambda x: x["u"]).alias("units"))
    return rows.select("qid", F.when(F.col("qid") % 5 != 0, "cross_modal").alias("type"), F.lit("deictic").alias("original_type"), "units")


def verdict_rows(spark, sf):
    return evidence.verdict_rows(_verdicts(spark, sf)).select("qid", "type", "verdict", "unit_id", F.md5("unit_text").alias("text_md5"), F.md5("span_or_reason").alias("why_md5"))


def gold_rows(spark, sf):
    v = _verdicts(spark, sf)
    topics = v.where("qid % 2 = 0").select("qid", F.concat(F.lit("t"), (F.col("qid") % 3).cast("string")).alias("topic"))
    g = evidence.gold_rows(v, corpus(spark, sf), topics)
    place = F.transform("gold_units", lambda x: F.concat_ws("/", x["source"], x["page"].cast("string"), x["start_s"].cast("string")))
    return g.select("qid", "type", F.array_join("gold_modalities", ",").alias("kinds"), F.array_join("gold_unit_ids", ",").alias("ids"), F.array_join(place, ",").alias("places"), F.col("proposed").cast("long").alias("proposed"), F.col("kept").cast("long").alias("kept"), "topic")


def review_merge(spark, sf):
    """Drafts as a review sheet decides: accepted, edited, rejected."""
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    drafts = b.select(i.cast("string").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("a"), i.cast("string")).alias("expected_answer"))
    decision = F.element_at(F.array(*map(F.lit, ("accept", " Edit", "reject"))), (i % 3 + 1).cast("int"))
    sheet = b.select(i.cast("string").alias("qid"), decision.alias("decision"), F.when(i % 2 == 0, " new question ").otherwise("").alias("edited_question"), F.when(i % 5 == 0, "new").alias("edited_answer"), F.lit("bridge").alias("kind"), F.lit("r1").alias("reviewer"))
    return views.reviewed(drafts, sheet)


def verdict_differences(spark, sf):
    """Why two judges type a document differently."""
    e = F.col("doc_id")
    a, b = F.when(F.col("quality") == 1, "kept"), F.when(F.col("toxic") == 0, "kept")
    sources = lambda k: F.filter(F.array(F.when(e % 2 == k, "deck"), F.when(e % 3 == 0, "audio")), lambda x: x.isNotNull())
    why = evidence.verdict_difference(a, b, e % 4, e % 5, F.lit(5), sources(0), sources(1), "one", "two")
    return table(spark, sf, "labels").select("doc_id", why.alias("why"))


def redundancy(spark, sf):
    """Shares of entailed sentences by pair of roles with their intervals, and what the intake gate makes of them."""
    p = F.col("pos")
    rows = corpus(spark, sf).select(F.col("modality").alias("source"), (p % 2).cast("string").alias("target"), ((p * 13) % 7 < 5).alias("entailed"))
    r = evidence.redundancy_summary(rows)
    gate = evidence.intake(F.col("share"), F.col("low"), F.col("high"), F.col("source").isNull(), 0.7)
    return r.select("source", "target", "n", "entailed", F.round("share", 6).alias("share"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), gate.alias("gate"))


def entailment_spans(spark, sf):
    """Whether a sentence of a document carries the passage that it is given in turn, and any or all of two facts, by shared terms."""
    pairs = in_turn(spark, sf).select(F.col("doc_id").alias("key"), F.col("text").alias("premise"), F.col("passage").alias("hypothesis"))
    found = evidence.entailment(pairs, evidence.word_overlap, margin=0.2)
    facts = found.select(F.floor(F.col("key") / 2).alias("doc"), (F.col("key") % 2).alias("nth"), "entailed", "span")
    both = evidence.entails_any(facts, "doc").withColumnRenamed("entailed", "any_fact").join(evidence.entails_all(facts, "doc").withColumnRenamed("entailed", "all_facts"), "doc")
    return both.select("doc", "any_fact", "all_facts", F.md5("span").alias("span_md5"))


def grounding(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("mode"), (e % 3).cast("string").alias("method"), (e % 6).alias("claims"), F.least(e % 6, e % 4).alias("unsupported"), (e % 5).alias("cited"), F.least(e % 5, e % 3).alias("correct"), (e % 6 == 0).alias("abstained"))
    g = evidence.grounding_table(rows)
    return g.select("mode", "method", "claims", "unsupported", F.round("rate", 6).alias("rate"), F.round("correctness", 6).alias("correctness"), "abstentions")


def open_scores(spark, sf):
    """Token metrics of the first words of passages, in turn, against the first of documents."""
    first = lambda c, n: F.slice(T.ascii_tokens(F.concat_ws(" ", F.lit("the of and"), c)), 1, n)
    rows = in_turn(spark, sf).select("lang", first(F.col("passage"), 9).alias("pred"), first(F.col("text"), 12).alias("ref"))
    s = S.open_scores(rows, ("lang",))
    return s.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "bleu", "meteor", "rouge1")))


def shuffled_options(spark, sf):
    """Options in a seeded order: the right one is where it went, and none is lost."""
    i = F.col("item_id")
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat_ws(":", i.cast("string"), k.cast("string")))
    s = sampling.shuffled_options(options, i % 4, i, seed=3)
    return table(spark, sf, "benchmark").select("item_id", F.element_at(s["options"], (s["gold"] + 1).cast("int")).alias("right"), F.array_join(F.array_sort(s["options"]), ",").alias("options"))


def manifest_stamp(spark, sf):
    """Hashes of manifests, and the warnings that differing ones give."""
    rows = [{"files": [{"name": "a", "units": i}], "created_utc": str(i)} for i in range(3)] + [{"files": [{"name": "a", "units": 0}], "created_utc": "later"}]
    marks = [ledger.manifest_hash(r) for r in rows]
    warn = [ledger.manifest_warning(m, marks[0]) is None for m in marks]
    return spark.createDataFrame(list(zip(range(4), marks, warn, strict=True)), "nth long, hash string, same boolean")


def term_counts(spark, sf):
    phrases = {"of the": ("of the", "Of-The"), "der": ("der",), "no": ("no scope", "noscope")}
    return table(spark, sf, "documents").select("doc_id", *speech.phrase_counts(F.col("text"), phrases))


def deck_terms(spark, sf):
    """Terms of each source's documents that a recogniser should know. Marks that SQL turns into spaces are in no term anyway."""
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("nth"), F.concat(F.lit("Top-K NoScope of YOLOv2 "), "text").alias("text"))
    return speech.distinctive_terms(d, "source", 20).withColumn("rank", F.col("rank").cast("long"))


def recogniser_prompts(spark, sf):
    return speech.recogniser_prompt(deck_terms(spark, sf), "source")


def sentence_cuts(spark, sf):
    """How often fixed runs of words cut a sentence."""
    from ...sources import readers

    words = readers.spoken(table(spark, sf, "conversations")).withColumn("bucket", F.floor(F.col("nth") / 7))
    return speech.cut_inside(words, "by").select("by", F.round("share", 6).alias("share"))


def punctuation(spark, sf):
    """Words of conversations without their marks, which the turns give back."""
    from ...sources import readers

    words = readers.spoken(table(spark, sf, "conversations"))
    bare = words.select("by", "nth", F.regexp_replace("text", r"[.,;:!?]+$", "").alias("text"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("by"), F.col("turn").alias("nth"), "text")
    back = speech.punctuated(bare, turns, "by")
    return back.groupBy("by").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " ")).alias("text_md5"))


def level_profile(spark, sf):
    levels = table(spark, sf, "events").select("user_id", F.col("event_id").alias("nth"), F.abs("value").alias("level"))
    p = speech.level_profile(levels, "user_id", 10)
    return p


def image_hashes(spark, sf):
    """Hashes of the vectors as grey images of eight rows, their distance and likeness to the next."""
    v = table(spark, sf, "embeddings")
    grey = F.concat(F.col("embedding"), F.slice("embedding", 1, 8))
    h = v.select("vec_id", speech.difference_hash(grey).alias("h"))
    two = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g")), "vec_id")
    return two.select("vec_id", S.hamming(F.col("h"), F.col("g")).cast("long").alias("bits"), F.round(S.hash_similarity(F.col("h"), F.col("g")), 6).alias("alike"))


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_VERDICTS = f"""
{CORPUS},
units AS (SELECT pos // 4 AS qid, pos, id, modality, file, page, start_s, pos % 3 <> 0 AS kept, substr(content, 1, 15) AS span, substr(content, 1, 60) AS text FROM corpus)
"""
_CLAIMS = f"""
{CORPUS},
claims AS (SELECT pos // 4 AS qid, pos % 4 AS nth, CASE WHEN (pos // 4) % 9 = 0 THEN 'unsupported' ELSE ['supported', 'weak', 'unsupported'][pos % 3 + 1] END AS verdict FROM corpus)
"""
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_VOTES = f"""
{CORPUS},
votes AS (
  SELECT pos // 3 AS claim, id, pos, (pos * 7 + run * 3) % 5 < 3 AND (pos + run) % 4 <> 0 AND {_NORM.format('substr(content, 1, 12)')} <> '' AS yes FROM corpus, (SELECT unnest([0, 1, 2]) AS run)),
units AS (SELECT claim, id, pos, sum(yes::INT) * 2 > count(*) AS supported FROM votes GROUP BY ALL)
"""
_RUNS = """
runs AS (
  SELECT event_id, event_id // 12 AS qid, ['audio', 'deck', 'paper', 'all'][(event_id // 3) % 4 + 1] AS source, (event_id // 3) % 5 <> 0 AS filled, event_id % 3 AS run,
         length(event_type) + event_id % 7 + (event_id // 36) % 5 > 12 AS pass FROM events),
won AS (SELECT qid, source, bool_or(filled) AS filled, count(*) FILTER (WHERE pass) * 2 > count(*) AS won FROM runs GROUP BY ALL),
told AS (SELECT w.*, (SELECT arg_min('r' || event_id, run) FROM runs r WHERE r.qid = w.qid AND r.source = w.source AND r.pass = w.won) AS why FROM won w)
"""

QUERIES = {
    "reply_parsing": (reply_parsing, """
SELECT event_id, CASE WHEN event_id % 7 = event_id % 3 THEN 'u' || event_id % 7 ELSE 'u' || event_id % 7 || ',u' || event_id % 3 END AS cited, 'who is ' || event_id % 9 AS query,
       CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 END::VARCHAR AS choice, 'D' AS longest,
       CASE WHEN event_id % 6 <> 0 THEN (event_id % 90) * 60 + event_id % 60 END::DOUBLE AS seconds,
       CASE WHEN length('Evidence: ' || event_id || ' lines') >= 14 THEN 'Evidence: ' || event_id || ' lines' END AS context, CASE WHEN length('Evidence: ' || event_id || ' lines') >= 14 THEN chr(10) || chr(10) || 'Question: why ' || event_id % 5 END AS question,
       CASE WHEN event_id % 3 <> 0 THEN 'q' || event_id END AS made FROM events"""),
    "fact_clauses": (fact_clauses, None),
    "prompt_blocks": (prompt_blocks, f"""
WITH {CORPUS}, e AS (
  SELECT pos // 5 AS qid, pos % 5 AS rank, id, modality, file || ' ' || CASE WHEN start_s IS NOT NULL THEN printf('%.1fs-%.1fs', start_s, end_s) ELSE 'p.' || page END AS place, CASE WHEN pos % 6 = 0 THEN ' ' ELSE substr(content, 1, 30) END AS content FROM corpus)
SELECT qid, md5('Evidence:' || chr(10) || string_agg('[' || id || ', ' || modality || ', ' || place || ']' || chr(10) || CASE WHEN trim(content, ' ') <> '' THEN content ELSE '(no text)' END, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: what of ' || qid) AS prompt_md5,
       md5(string_agg('[' || (rank + 1) || '] ' || content, chr(10) ORDER BY rank)) AS passages_md5 FROM e GROUP BY qid"""),
    "evidence_numbers": (evidence_numbers, f"""
WITH {CORPUS}, u AS (SELECT pos // 10 AS qid, id, pos % 10 AS r FROM corpus), b AS (SELECT qid, id, r FROM u UNION ALL SELECT qid, id, (r * 7) % 10 FROM u WHERE (r * 7) % 10 < 6), f AS (SELECT qid, id, min(r) AS r FROM b GROUP BY ALL)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY r, id) AS n FROM f"""),
    "citation_map": (citation_map, f"""
WITH {CORPUS}, c AS (SELECT pos AS qid, id FROM corpus UNION SELECT pos, 'src0:' || pos % 200 FROM corpus)
SELECT qid, id, CASE WHEN page IS NOT NULL THEN file || ' p.' || page ELSE file || ' ' || {clock('start_s')} || '-' || {clock('end_s')} END AS place FROM c JOIN corpus USING (id)"""),
    "packed_answers": (packed_answers, f"""
WITH {_CLAIMS}
SELECT qid, count(*) FILTER (WHERE verdict <> 'unsupported') AS n, string_agg((nth + 1)::VARCHAR, ',' ORDER BY nth) FILTER (WHERE verdict <> 'unsupported') AS numbers,
       CASE WHEN count(*) FILTER (WHERE verdict <> 'unsupported') = 0 THEN 'The evidence does not answer this question.' ELSE 'an answer' END AS summary, count(*) FILTER (WHERE verdict <> 'unsupported') = 0 AS abstained FROM claims GROUP BY qid"""),
    "answer_reports": (answer_reports, f"""
WITH {_CLAIMS}, r AS (SELECT qid, count(*) AS claims, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'weak') AS weak, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported FROM claims GROUP BY qid)
SELECT *, round(unsupported / claims, 6) AS rate, supported = 0 AS abstains, CASE WHEN supported = 0 THEN 'The evidence does not answer this question.' ELSE 'an answer' END AS shown FROM r"""),
    "hallucination_rates": (hallucination_rates, f"WITH {_CLAIMS} SELECT qid % 5 AS part, round(count(*) FILTER (WHERE verdict = 'unsupported') / count(*), 6) AS rate FROM claims GROUP BY qid % 5"),
    "unit_votes": (unit_votes, f"WITH {_VOTES} SELECT claim, id, supported FROM units"),
    "claim_verdicts": (claim_verdicts, f"""
WITH {_VOTES}, f AS (SELECT claim, arg_min(id, pos) FILTER (WHERE supported) AS id FROM units GROUP BY claim)
SELECT claim % 100 AS qid, claim, CASE WHEN claim % 6 = 0 THEN 'weak' WHEN id IS NOT NULL THEN 'supported' ELSE 'unsupported' END AS verdict, CASE WHEN claim % 6 <> 0 THEN id END AS id FROM f"""),
    "graded_answers": (graded_answers, """
WITH v AS (SELECT event_id // 3 AS qid, event_id % 3 AS run, value * 100 % 7 < 4 AS pass, 'r' || event_id AS reason FROM events),
t AS (SELECT qid, count(*) FILTER (WHERE pass) * 2 > count(*) AS passed FROM v GROUP BY qid)
SELECT t.qid, any_value(passed) AS passed, arg_min(reason, run) AS reason FROM t JOIN v ON v.qid = t.qid AND v.pass = t.passed GROUP BY t.qid"""),
    "source_runs": (source_runs, f"WITH {_RUNS} SELECT qid, source, filled AND won AS passed, CASE WHEN filled THEN why ELSE 'no text from this source' END AS reason FROM told"),
    "verified_questions": (verified_questions, f"""
WITH {_RUNS}, f AS (
  SELECT qid, coalesce(bool_or(source = 'audio' AND filled AND won), false) AS a, coalesce(bool_or(source = 'deck' AND filled AND won), false) AS d, coalesce(bool_or(source = 'paper' AND filled AND won), false) AS p, coalesce(bool_or(source = 'all' AND filled AND won), false) AS t FROM told GROUP BY qid),
k AS (SELECT *, list_filter([CASE WHEN a THEN 'audio' END, CASE WHEN d THEN 'deck' END, CASE WHEN p THEN 'paper' END], lambda x: x IS NOT NULL) AS one, ['deictic', 'cross_modal', 'audio_only'][qid % 3 + 1] AS old FROM f),
n AS (SELECT *, CASE WHEN NOT t AND len(one) = 0 THEN NULL WHEN len(one) = 1 THEN one[1] || '_only' WHEN len(one) > 1 THEN 'single_modality' WHEN old IN ('cross_modal', 'deictic') THEN old ELSE 'cross_modal' END AS new FROM k)
SELECT qid, CASE WHEN qid % 4 > 0 THEN new END AS type,
       CASE WHEN qid % 4 = 0 THEN 'no proposed unit survived' WHEN new IS NULL THEN 'no source answers it' WHEN new = old THEN 'as proposed' ELSE 'answered by ' || CASE WHEN len(one) > 0 THEN array_to_string(one, ', ') ELSE 'all sources together' END END AS reason, qid % 4 AS kept FROM n"""),
    "verdict_rows": (verdict_rows, rf"""
WITH {_VERDICTS} SELECT qid, CASE WHEN qid % 5 <> 0 THEN 'cross_modal' ELSE 'dropped(deictic)' END AS type, CASE WHEN kept THEN 'kept' ELSE 'dropped' END AS verdict, id AS unit_id,
       md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS text_md5, md5(CASE WHEN kept THEN span ELSE 'off  topic' END) AS why_md5 FROM units"""),
    "gold_rows": (gold_rows, f"""
WITH {_VERDICTS}, n AS (SELECT qid, count(*) AS proposed FROM units GROUP BY qid)
SELECT qid, 'cross_modal' AS type, array_to_string(list_filter(['text', 'figure', 'table', 'audio'], lambda m: list_contains(list(DISTINCT modality), m)), ',') AS kinds, string_agg(id, ',' ORDER BY pos) AS ids,
       string_agg(file || '/' || CASE WHEN page IS NOT NULL THEN page::VARCHAR ELSE round(start_s, 1)::VARCHAR END, ',' ORDER BY pos) AS places, any_value(proposed) AS proposed, count(*) AS kept, CASE WHEN qid % 2 = 0 THEN 't' || qid % 3 END AS topic
FROM units JOIN n USING (qid) WHERE kept AND qid % 5 <> 0 GROUP BY qid"""),
    "review_merge": (review_merge, """
SELECT item_id::VARCHAR AS qid, CASE WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'new question' ELSE text END AS question, CASE WHEN item_id % 3 = 1 AND item_id % 5 = 0 THEN 'new' ELSE 'a' || item_id END AS expected_answer,
       'bridge' AS kind, 'r1' AS reviewed_by, CASE item_id % 3 WHEN 0 THEN 'accept' ELSE 'edit' END AS review FROM benchmark WHERE item_id % 3 < 2"""),
    "verdict_differences": (verdict_differences, """
WITH x AS (SELECT doc_id, quality, toxic, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'audio' END, CASE WHEN doc_id % 2 = 0 THEN 'deck' END], lambda x: x IS NOT NULL) AS a, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'audio' END, CASE WHEN doc_id % 2 = 1 THEN 'deck' END], lambda x: x IS NOT NULL) AS b FROM labels)
SELECT doc_id, CASE WHEN toxic <> 0 THEN 'two kept ' || doc_id % 5 || ' of 5 units, one ' || doc_id % 4 WHEN quality <> 1 THEN 'one dropped it, two kept ' || doc_id % 5 || ' of 5 units'
       ELSE 'answered by ' || CASE WHEN len(a) > 0 THEN array_to_string(a, ', ') ELSE 'none' END || ' under one, by ' || CASE WHEN len(b) > 0 THEN array_to_string(b, ', ') ELSE 'none' END || ' under two; kept ' || doc_id % 4 || ' and ' || doc_id % 5 || ' of 5 units' END AS why FROM x"""),
    "redundancy": (redundancy, f"""
WITH {CORPUS}, r AS (SELECT modality AS source, (pos % 2)::VARCHAR AS target, count(*) AS n, count(*) FILTER (WHERE (pos * 13) % 7 < 5) AS entailed FROM corpus GROUP BY GROUPING SETS ((modality, pos % 2), ())),
w AS (SELECT *, entailed / n AS p, 3.8416 AS zz FROM r),
i AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS c, 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n) AS d FROM w)
SELECT source, target, n, entailed, round(p, 6) AS share, round(greatest(0, c - d), 6) AS low, round(least(1, c + d), 6) AS high,
       CASE WHEN source IS NULL THEN CASE WHEN p < 0.7 THEN 'KEEP' ELSE 'REJECT' END WHEN least(1, c + d) < 0.7 THEN 'KEEP' WHEN greatest(0, c - d) >= 0.7 THEN 'REJECT' ELSE 'BORDERLINE' END AS gate FROM i"""),
    "entailment_spans": (entailment_spans, None),
    "grounding": (grounding, """
SELECT event_type AS mode, (event_id % 3)::VARCHAR AS method, sum(event_id % 6)::BIGINT AS claims, sum(least(event_id % 6, event_id % 4))::BIGINT AS unsupported, round(sum(least(event_id % 6, event_id % 4)) / nullif(sum(event_id % 6), 0), 6) AS rate,
       round(sum(least(event_id % 5, event_id % 3)) / nullif(sum(event_id % 5), 0), 6) AS correctness, count(*) FILTER (WHERE event_id % 6 = 0) AS abstentions FROM events GROUP BY ALL"""),
    "open_scores": (open_scores, None),
    "shuffled_options": (shuffled_options, "SELECT item_id, item_id || ':' || item_id % 4 AS \"right\", item_id || ':0,' || item_id || ':1,' || item_id || ':2,' || item_id || ':3' AS options FROM benchmark"),
    "manifest_stamp": (manifest_stamp, """
WITH m AS (SELECT unnest([0, 1, 2, 3]) AS nth, unnest([0, 1, 2, 0]) AS units)
SELECT nth::BIGINT AS nth, substr(sha256('{"files":[{"name":"a","units":' || units || '}]}'), 1, 16) AS hash, units = 0 AS same FROM m"""),
    "term_counts": (term_counts, r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), '-', ' '), '\s+', ' ', 'g'), ' ') AS x FROM documents)
SELECT doc_id, 2 * (length(x) - length(replace(x, 'of the', ''))) // 6 AS "of the", (length(x) - length(replace(x, 'der', ''))) // 3 AS "der", (length(x) - length(replace(x, 'no scope', ''))) // 8 + (length(x) - length(replace(x, 'noscope', ''))) // 7 AS "no" FROM t"""),
    "deck_terms": (deck_terms, rf"""
WITH t AS (SELECT source, doc_id, regexp_extract_all('Top-K NoScope of YOLOv2 ' || regexp_replace(text, '[^A-Za-z0-9 -]', ' ', 'g'), '{speech.TERM}') AS w FROM documents),
x AS (SELECT source, doc_id, unnest(w) AS written, generate_subscripts(w, 1) AS place FROM t),
k AS (SELECT *, lower(written) AS key, length(regexp_replace(written, '[^A-Z]', '', 'g')) AS caps FROM x WHERE lower(written) NOT IN ({', '.join(f"'{w}'" for w in speech.EVERYDAY)})),
c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k GROUP BY ALL), best AS (SELECT source, key, written AS term FROM k QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY caps DESC, doc_id, place) = 1)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, regexp_matches(term, '[0-9-]|^.+[A-Z]') DESC, length(key) DESC, key) AS rank, term FROM c JOIN best USING (source, key) QUALIFY rank <= 20"""),
    "sentence_cuts": (sentence_cuts, r"""
WITH turns AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS k FROM conversations),
words AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS nth FROM turns), last AS (SELECT conv_id, nth // 7 AS b, arg_max(w, nth) AS w FROM words GROUP BY ALL),
m AS (SELECT *, b < max(b) OVER (PARTITION BY conv_id) AND NOT regexp_matches(w, '[.?!]$') AS cut FROM last)
SELECT conv_id::VARCHAR AS "by", round(sum(cut::INT) / greatest(count(*) - 1, 1), 6) AS share FROM m GROUP BY conv_id"""),
    "punctuation": (punctuation, r"""
WITH turns AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS k FROM conversations)
SELECT conv_id::VARCHAR AS "by", md5(string_agg(w, ' ' ORDER BY turn, k)) AS text_md5 FROM turns GROUP BY conv_id"""),
    "level_profile": (level_profile, """
WITH x AS (SELECT user_id, abs(value) AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
y AS (SELECT *, least(10, n) AS k, n // least(10, n) AS m, n % least(10, n) AS r FROM x), z AS (SELECT user_id, CASE WHEN i < r * (m + 1) THEN i // (m + 1) ELSE r + (i - r * (m + 1)) // m END AS bin, max(l) AS l FROM y GROUP BY ALL)
SELECT user_id, bin, round(l / CASE WHEN max(l) OVER (PARTITION BY user_id) = 0 THEN 1 ELSE max(l) OVER (PARTITION BY user_id) END, 3) AS level FROM z"""),
    "image_hashes": (image_hashes, """
WITH v AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda k: (g[(k // 8) * 9 + k % 8 + 2] > g[(k // 8) * 9 + k % 8 + 1])::INT) AS b FROM v)
SELECT x.vec_id, list_sum(list_transform(range(1, 65), lambda k: (x.b[k] <> y.b[k])::INT))::BIGINT AS bits, round(1 - list_sum(list_transform(range(1, 65), lambda k: (x.b[k] <> y.b[k])::INT)) / 64, 6) AS alike FROM b x JOIN b y ON y.vec_id = x.vec_id + 1"""),
}
QUERIES["recogniser_prompts"] = (recogniser_prompts, f"""
WITH terms AS ({QUERIES['deck_terms'][1]})
SELECT source, 'A technical conference talk. Terminology used: ' || string_agg(term, ', ' ORDER BY rank) || '.' AS prompt FROM terms GROUP BY source""")  # fmt: skip
