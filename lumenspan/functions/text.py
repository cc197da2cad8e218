"""Text scalars as Spark column expressions. None of them runs Python on executors."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Wordings that decide results and so must be these.
CUES = ["here", "this", "that", "that one", "this one", "shown", "on the left", "on the right", "this slide", "as you can see", "as you see", "look at this", "over here", "right here"]
CUE_NOUNS = ["arrow", "box", "step", "line", "circle", "node", "column", "row", "bar", "point", "block", "region", "curve", "axis"]
CUE_DIRECTIONS = ["above", "below", "on the left", "on the right", "here", "there"]
CUE_DETERMINERS = ["the", "this", "that"]
VISUAL_TERMS = ["see", "seen", "show", "shows", "showing", "shown", "look", "looking", "plot", "plotted", "screen", "slide", "figure", "graph", "diagram", "arrow", "chart", "picture", "image", "axis", "curve", "table", "box", "column", "row", "highlight", "highlighted", "display", "displayed", "draw", "drawn", "point", "pointing"]
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "vs.", "fig.", "eq.", "sec.", "ref.", "dr.", "mr.", "mrs.", "prof.", "al.", "cf.", "approx.", "no."]
LINK_TYPES = ["audio_slide", "figure_text", "deictic", "same_slide"]
NUMBERED = r"(?i)\b(fig(?:ure)?|tab(?:le)?)\s*\.?\s*(\d{1,2})\b"
DESCRIPTIVE = r"(?i)\bthe\s+(diagram|flowchart|graph|chart|plot|figure|table|image|picture|screenshot)\s+(below|above|on the left|on the right|to the left|to the right|opposite)\b"
TERMINAL = r"[.!?][\"')\]]?$"
# ------------------------------------------------------------------------------

SPACES = r"\s+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, as answer metrics count them."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def collapsed(c: Column) -> Column:
    """White space runs as one space, none around."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


# -- places -------------------------------------------------------------------


def cite(location: Column) -> Column:
    """'12.0s-15.5s' for times, else 'p.3', else '?'."""
    times = F.format_string("%.1fs-%.1fs", location["start_s"], location["end_s"])
    page = F.concat(F.lit("p."), location["page"].cast("string"))
    return F.when(location["start_s"].isNotNull(), times).when(location["page"].isNotNull(), page).otherwise("?")


def mmss(seconds: Column) -> Column:
    """m:ss of seconds rounded half to even."""
    whole = F.bround(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def mmss_floor(seconds: Column) -> Column:
    """m:ss of seconds without their fraction."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def locator(source_file: Column, location: Column) -> Column:
    """'file p.N', or 'file m:ss-m:ss', or the file: a page goes before times."""
    name = file_name(source_file)
    paged = F.concat(name, F.lit(" p."), location["page"].cast("string"))
    timed = F.concat(name, F.lit(" "), mmss(location["start_s"]), F.lit("-"), mmss(location["end_s"]))
    return F.when(location["page"].isNotNull(), paged).when(location["start_s"].isNotNull(), timed).otherwise(name)


def judge_place(source_file: Column, location: Column) -> Column:
    """Page, else time, else file name, as a judge is told it."""
    page = F.concat(F.lit("page "), location["page"].cast("string"))
    return F.when(location["page"].isNotNull(), page).when(location["start_s"].isNotNull(), mmss(location["start_s"])).otherwise(file_name(source_file))


def modality_tag(modality: Column, location: Column) -> Column:
    """'[AUDIO 18:40-19:10]', '[FIGURE p.12]' or '[TEXT]'."""
    times = F.concat(mmss_floor(location["start_s"]), F.lit("-"), mmss_floor(location["end_s"]))
    where = F.when(location["start_s"].isNotNull(), times).when(location["page"].isNotNull(), F.concat(F.lit("p."), location["page"].cast("string")))
    return F.concat(F.lit("["), F.concat_ws(" ", F.upper(modality), where), F.lit("]"))


def rerank_text(modality: Column, location: Column, content: Column) -> Column:
    return F.concat_ws(" ", modality_tag(modality, location), collapsed(content))


def embed_text(modality: Column, content: Column, source_file: Column, location: Column) -> Column:
    """What is embedded of a unit: its content, or where it is if that is blank."""
    stand_in = F.concat(modality, F.lit(" from "), file_name(source_file), F.lit(" at "), cite(location))
    return F.when(F.trim(content) != "", content).otherwise(stand_in)


def describe_locator(place: Column) -> Column:
    """'src p.N' or 'src a-bs' of a gold locator."""
    paged = F.concat(place["source"], F.lit(" p."), place["page"].cast("string"))
    timed = F.concat(place["source"], F.lit(" "), place["start_s"].cast("string"), F.lit("-"), place["end_s"].cast("string"), F.lit("s"))
    return F.when(place["page"].isNotNull(), paged).otherwise(timed)


def locator_of(source_file: Column, location: Column) -> Column:
    """Struct {source, page, start_s, end_s} that names a unit's place; times with one decimal."""
    paged = location["page"].isNotNull()
    return F.struct(
        file_name(source_file).alias("source"),
        location["page"].alias("page"),
        F.when(~paged, F.round(location["start_s"], 1)).alias("start_s"),
        F.when(~paged, F.round(location["end_s"], 1)).alias("end_s"),
    )


# -- references and cues ------------------------------------------------------


def ref_kind(word: Column) -> Column:
    return F.when(F.lower(word).startswith("tab"), "table").otherwise("figure")


def figure_number(c: Column) -> Column:
    """Number of the first 'Figure 3' or 'Table 2', else null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), NUMBERED, 2), F.lit("")).cast("int")


def figure_kind(c: Column) -> Column:
    return ref_kind(F.regexp_extract(F.coalesce(c, F.lit("")), NUMBERED, 1))


def referenced(c: Column) -> Column:
    """Distinct 'figure 3' or 'table 2' that a text refers to, sorted."""
    kinds = F.regexp_extract_all(c, F.lit(NUMBERED), F.lit(1))
    numbers = F.regexp_extract_all(c, F.lit(NUMBERED), F.lit(2))
    return F.array_sort(F.array_distinct(F.zip_with(kinds, numbers, lambda k, n: F.concat_ws(" ", ref_kind(k), n.cast("int").cast("string")))))


def descriptive_refs(c: Column) -> Column:
    """Array of (noun, direction) like ('diagram', 'below'), in the order of the text."""
    nouns = F.regexp_extract_all(F.lower(c), F.lit(DESCRIPTIVE), F.lit(1))
    directions = F.regexp_extract_all(F.lower(c), F.lit(DESCRIPTIVE), F.lit(2))
    return F.arrays_zip(nouns.alias("noun"), directions.alias("direction"))


def expand_cues(base: Sequence[str] = CUES, nouns: Sequence[str] = CUE_NOUNS, directions: Sequence[str] = CUE_DIRECTIONS, determiners: Sequence[str] = CUE_DETERMINERS) -> list[str]:
    """The cues and every 'determiner noun direction'."""
    return [*base, *(f"{a} {b} {c}" for a in determiners for b in nouns for c in directions)]


def cue_pattern(cues: Sequence[str]) -> str:
    """Java pattern that finds the longest cue at a place between spaces."""
    longest_first = sorted({c.lower() for c in cues}, key=lambda c: (-len(c.split()), c))
    return r"(?<!\S)(?:" + "|".join(map(re.escape, longest_first)) + r")(?!\S)"


def cue_words(c: Column) -> Column:
    """The words of a text as cues are looked up: lower case, only a-z, 0-9 and apostrophes."""
    return F.transform(F.split(c, SPACES), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9']", ""))


def tier_of(phrase: Column, sentence: Column, visual: Sequence[str] = VISUAL_TERMS) -> Column:
    """1 for a cue of several words, 2 for one word in a sentence about something seen, else 3."""
    seen = F.arrays_overlap(cue_words(sentence), F.array(*map(F.lit, visual)))
    return F.when(F.size(F.split(phrase, SPACES)) > 1, 1).when(seen, 2).otherwise(3)


def cue_strength(phrase: Column) -> Column:
    return F.least(F.lit(1.0), F.size(F.split(phrase, SPACES)) / 3)


# -- sentences ----------------------------------------------------------------


def split_sentences(c: Column, bullets: bool = False, min_words: int = 5) -> Column:
    """Sentences of at least min_words; with bullets, their lines are cut first."""
    cut = F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")
    if bullets:
        lines = F.split(c, r"\s*[\n•▪●‣]\s*|\s+[-–]\s+")
        cut = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.size(words(s)) >= min_words)


def premises(c: Column, max_chars: int = 1200) -> Column:
    """Sentences as premises: abbreviations joined again, long ones cut into pieces of max_chars."""
    # cut by one pattern that looks back for an abbreviation: to join parts one by one would copy all those before
    abbreviation = "|".join(re.escape(a) for a in ABBREVIATIONS)
    whole = F.filter(F.split(collapsed(c), rf"(?<=[.!?])(?<!(?:^|\s)(?i:{abbreviation}))\s+"), lambda s: s != "")
    starts = lambda s: F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(max_chars))
    return F.flatten(F.transform(whole, lambda s: F.transform(starts(s), lambda i: F.substring(s, i, F.lit(max_chars)))))


def facts(reference: Column, question: Column | None = None) -> Column:
    """Clauses of a reference answer of at least two words, after the question if there is one."""
    clauses = F.flatten(F.transform(premises(reference), lambda s: F.split(s, r"\s*;\s*")))
    kept = F.filter(F.transform(clauses, lambda s: F.trim(s)), lambda s: F.size(words(s)) >= 2)
    return kept if question is None else F.transform(kept, lambda s: F.when(F.trim(question) != "", F.concat_ws(" ", question, s)).otherwise(s))


def normal(c: Column) -> Column:
    """Lower case with single spaces for all but a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def span_in_text(span: Column, text: Column) -> Column:
    """Whether a quote stands in a text; pieces between '...' must stand in order. An empty quote never does."""
    return span_in_normal(span, normal(text))


def span_in_normal(span: Column, hay: Column) -> Column:
    """span_in_text() of a text in its normal form."""
    pieces = F.filter(F.transform(F.split(span, r"\.\.\.|…"), normal), lambda p: p != "")
    place = F.aggregate(pieces, F.lit(1), lambda at, p: F.when(at == 0, 0).otherwise(once(_locate(p, hay, at), lambda found: F.when(found > 0, found + F.length(p)).otherwise(0))))
    return (F.size(pieces) > 0) & (place > 0)


def _locate(piece: Column, hay: Column, at: Column) -> Column:
    """1-based place of piece in hay from place at on, or 0."""
    rest = F.substring(hay, at, F.length(hay) + 1)
    found = F.position(piece, rest)
    return F.when(found > 0, found + at - 1).otherwise(0)


def excerpt(c: Column, limit: int = 360) -> Column:
    """A text cut at the last space before the limit, with an ellipsis if anything went."""
    whole = collapsed(c)
    cut = F.regexp_replace(F.substring(whole, 1, limit), r"\s\S*$", "")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit("…")))


# -- replies ------------------------------------------------------------------


def cited_ids(c: Column) -> Column:
    """Ids in brackets, in the order in which they first come."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[([A-Za-z0-9_.:\-]+)\]"), F.lit(1)))


def clean_query(c: Column) -> Column:
    """First line of a proposed query without quotes and 'query:' before it, at most 20 words."""
    line = F.trim(F.split(F.trim(c), "\n")[0])
    bare = F.regexp_replace(F.regexp_replace(line, r"(?i)^\s*(search\s+)?query\s*:\s*", ""), r"^[\"'`\s]+|[\"'`\s]+$", "")
    return F.array_join(F.slice(words(bare), 1, 20), " ")


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Strings as wholes, one that isn't closed with all after it, braces, and runs of anything else. Possessive: no backtracking, and no depth of calls in long strings.
JSON_PIECES = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|".*|[{}]|[^"{}]++"""


def json_object(c: Column) -> Column:
    """The first whole JSON object of a reply, as text: fences go, and so does all after the brace that closes it. Null without one."""
    rest = F.regexp_extract(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), r"(?s)(\{.*)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        moved = once(depth, lambda d: F.struct(d.alias("depth"), (s["n"] + F.length(x)).alias("n"), (d == 0).alias("done")))
        return F.when(s["done"], s).otherwise(moved)

    end = lambda r: F.aggregate(F.regexp_extract_all(r, F.lit(JSON_PIECES), F.lit(0)), start, step)
    return once(rest, lambda r: once(end(r), lambda e: F.when((r != "") & e["done"], F.substring(r, F.lit(1), e["n"]))))


CLAIMS = "struct<answer:string,claims:array<struct<text:string,units:array<string>>>>"


def answer_claims(c: Column) -> Column:
    """{answer, claims} of a structured reply, its first JSON object; null without an answer. Blank claims go."""
    none = F.array().cast("array<struct<text:string,units:array<string>>>")
    kept = lambda read: F.filter(F.coalesce(read["claims"], none), lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    return once(F.from_json(json_object(c), CLAIMS), lambda read: F.when(read["answer"].isNotNull(), F.struct(read["answer"].alias("answer"), kept(read).alias("claims"))))


def strict_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS, MM:SS or plain seconds, else null. Fields after the first are under 60, hours under 24."""
    parts = F.split(F.trim(c), ":")
    value = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    shaped = F.trim(c).rlike(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$")
    three = (value(0) < 24) & (value(1) < 60) & (value(2) < 60)
    return (
        F.when(~shaped, None)
        .when(F.size(parts) == 1, value(0))
        .when((F.size(parts) == 2) & (value(1) < 60), value(0) * 60 + value(1))
        .when((F.size(parts) == 3) & three, value(0) * 3600 + value(1) * 60 + value(2))
    )


def parse_mmss(c: Column) -> Column:
    """Seconds of m:ss; blank is null."""
    parts = F.split(F.trim(c), ":")
    return F.when(F.trim(c) != "", F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double"))


def mcq_choice(reply: Column, options: Column) -> Column:
    """0-based option of a reply: its leading letter A to D, else the option it repeats, else null."""
    letter = F.regexp_extract(F.trim(reply), r"^\(?([A-Da-d])(?:[).:\s]|$)", 1)
    by_letter = F.when(letter != "", F.ascii(F.upper(letter)) - F.lit(65))
    by_text = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(F.trim(reply))) - 1
    return F.coalesce(by_letter, F.when(by_text >= 0, by_text)).cast("int")


def longest_option(options: Column) -> Column:
    """Letter of the one longest option, null if several are as long."""
    lengths = F.transform(options, lambda o: F.length(o))
    most = F.array_max(lengths)
    only = F.size(F.filter(lengths, lambda n: n == most)) == 1
    return F.when(only, F.char(F.array_position(lengths, most) + 64))


def evidence_block(rows: Column) -> Column:
    """Evidence for a prompt from array<struct<rank, id, modality, place, content>>: a head line and the content of each."""
    one = lambda x: F.concat(F.lit("["), F.concat_ws(", ", x["id"], x["modality"], x["place"]), F.lit("]\n"), F.when(F.trim(x["content"]) != "", x["content"]).otherwise("(no text)"))
    return F.array_join(F.transform(F.array_sort(rows), one), "\n\n")


def passages(texts: Column) -> Column:
    """'[i] text' lines, from 1."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def shared_context(prompt: Column, min_chars: int) -> Column:
    """{context, question}: a prompt cut at its last question mark line, if that is min_chars in; else null."""
    mark = "\n\nQuestion: "
    at = F.length(prompt) - F.length(F.substring_index(prompt, mark, -1)) - len(mark)
    return F.when((F.position(F.lit(mark), prompt) > 0) & (at >= min_chars), F.struct(F.substring(prompt, F.lit(1), at.cast("int")).alias("context"), F.substring(prompt, (at + 1).cast("int"), F.length(prompt)).alias("question")))


# -- small columns ------------------------------------------------------------


def is_deck(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def role_of(modality: Column, deck_flag: Column) -> Column:
    return F.when(modality == "audio", "transcript").when(is_deck(deck_flag), "deck").otherwise("paper")


def material_kind(modality: Column, deck_flag: Column) -> Column:
    return F.when(modality == "audio", "speech").when(is_deck(deck_flag), "slides").otherwise("notes")


def source_of(modality: Column, source_file: Column, decks: Sequence[str]) -> Column:
    return F.when(modality == "audio", "audio").when(file_name(source_file).isin(list(decks)), "deck").otherwise("paper")


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def finite(x: Column, digits: int = 2) -> Column:
    return F.when(~(F.isnan(x) | x.isin(float("inf"), float("-inf"))), F.round(x, digits))


def estimated_tokens(c: Column) -> Column:
    return F.bround(F.length(c) / 4).cast("long")


def cost_text(cost: Column) -> Column:
    return F.when(cost.isNull(), "price unknown").otherwise(F.format_string("$%.4f", cost))


def checked_link_type(c: Column) -> Column:
    """The link type, or an error for one that doesn't exist."""
    return F.when(c.isin(LINK_TYPES), c).otherwise(F.raise_error(F.concat(F.lit("unknown link type: "), F.coalesce(c, F.lit("null")))))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, entities of markup are read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    plain = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    named = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
    return collapsed(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), named, plain))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)
