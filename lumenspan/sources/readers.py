"""Readers: files and tables to DataFrames.

Files go through Spark's binary reader, so that they are listed and parsed by
executors; a file that can't be read becomes a row with an error, not a failed run.
Formats that need a codec or a model take a callable for it.
"""

from __future__ import annotations

import io
import json
import shutil
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import regions
from ..operators.segments import fixed_spans, islands
from ..operators.units import LOCATION, location, word_windows
from . import scratch

# Which reader takes which suffix.
KINDS = {"pdf": "pdf", "docx": "docx", "wav": "audio", "mp3": "audio", "m4a": "audio", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}
PARSED = f"id string, modality string, content string, location {LOCATION}"
TRANSCRIPT = "audio string, words array<array<string>>"


def tables(spark: SparkSession, directory: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{directory}/{n}.parquet") for n in names)


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, suffix, kind, content) of files; kind is null for a suffix that no reader takes."""
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rows = spark.read.format("binaryFile").load(list(paths)).select("path", T.file_name(F.col("path")).alias("name"), "content")
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return rows.withColumn("kind", F.element_at(kinds, F.col("suffix")))


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of a DOCX file's paragraphs, tables and headers apart."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    return ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in (body if body is not None else ()) if p.tag == f"{space}p"]


def parsed(rows: DataFrame, parsers: dict[str, Callable[[bytes, str], list[dict]]]) -> DataFrame:
    """files() with units and error: each file's parser by kind. An unknown kind, and any exception, is an error of that file alone."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units, errors = [], []
            for name, kind, content in zip(batch["name"], batch["kind"], batch["content"], strict=True):
                try:
                    units.append(parsers[kind](content, name))
                    errors.append(None)
                except Exception as e:  # the error is the row's result
                    units.append([])
                    errors.append(f"{type(e).__name__}: {e}" if kind in parsers else f"no reader for {name}")
            yield pd.DataFrame({"path": batch["path"], "name": batch["name"], "units": units, "error": errors})

    kind = f"array<struct<{PARSED.replace(' string', ':string').replace(' struct', ':struct')}>>"
    return rows.select("path", "name", "kind", "content").mapInPandas(over, f"path string, name string, units {kind}, error string")


def docx_units(content: bytes, name: str, chunk_words: int = 225, lap: int = 45) -> list[dict]:
    """Units of a DOCX file: windows of words, without places."""
    words = " ".join(docx_paragraphs(content)).split()
    starts = [s for s in range(0, len(words), chunk_words - lap) if s == 0 or len(words) - s > lap]
    nowhere = {"page": None, "bbox": None, "start_s": None, "end_s": None}
    stem = name.rpartition(".")[0] or name
    return [{"id": f"{stem}:t{i}", "modality": "text", "content": " ".join(words[s : s + chunk_words]), "location": nowhere} for i, s in enumerate(starts)]


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, nth, start, end, text): words of stored transcripts {audio, words: [[start, end, text], ...]}."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    words = rows.select(F.coalesce("audio", T.file_name(F.col("_file"))).alias("source_file"), F.posexplode("words").alias("nth", "w"))
    return words.select("source_file", F.col("nth").cast("long").alias("nth"), F.col("w")[0].cast("double").alias("start"), F.col("w")[1].cast("double").alias("end"), F.col("w")[2].alias("text"))


def with_transcript(audio: DataFrame, stored: DataFrame) -> DataFrame:
    """audio files(name) with has_transcript: whether '<stem>.frozen.json' is among the stored files(name)."""
    key = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    names = stored.select(F.regexp_replace("name", r"\.frozen\.json$", "").alias("_stem")).distinct().withColumn("has_transcript", F.lit(True))
    return audio.withColumn("_stem", key(F.col("name"))).join(names, "_stem", "left").withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False))).drop("_stem")


def links(spark: SparkSession, path: str, manifest_hash: str | None = None, gated: bool = True) -> DataFrame:
    """Links of JSON lines whose first may be a _meta row; a manifest hash that differs from the one given is an error.

    Links that were judged unrelated are left out unless gated is false; those never
    judged stay.
    """
    schema = "_meta struct<manifest_hash:string>, src_id string, dst_id string, link_type string, score double, metadata struct<relatedness:struct<passed:boolean>,nth:bigint>"
    rows = spark.read.schema(schema).json(path)
    if manifest_hash is not None:
        stamp = rows.where("_meta IS NOT NULL").select("_meta.manifest_hash").first()
        if stamp is None or stamp[0] != manifest_hash:
            raise ValueError(f"links were made for manifest {stamp and stamp[0]}, the corpus has {manifest_hash}")
    out = rows.where("src_id IS NOT NULL")
    out = out.where(F.coalesce("metadata.relatedness.passed", F.lit(True))) if gated else out
    return out.select("src_id", "dst_id", T.checked_link_type(F.col("link_type")).alias("link_type"), "score", F.col("metadata.relatedness.passed").alias("passed"))


def alignment_labels(spark: SparkSession, path: str) -> DataFrame:
    """Alignment labels: 'none' and '' are null; accept holds the true slide and all others that count as correct."""
    rows = spark.read.option("header", True).csv(path)
    slide = F.when(~F.coalesce("true_slide", F.lit("")).isin("none", ""), F.col("true_slide")).cast("int")
    other = F.filter(F.transform(F.split(F.coalesce("also_correct", F.lit("")), r"[;,\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return rows.select("segment_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), slide.alias("true_slide"), F.when(slide.isNotNull(), F.array_union(F.array(slide), other)).alias("accept"))


def slide_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(slide, start, end, outro, zero_length) of a timeline in m:ss; rows without times go."""
    rows = spark.read.option("header", True).csv(path)
    start, end = T.parse_mmss(F.col("start")), T.parse_mmss(F.col("end"))
    out = rows.select(F.col("slide").try_cast("int").alias("slide"), start.alias("start"), end.alias("end"), (F.lower("slide") == "outro").alias("outro"))
    return out.where("start IS NOT NULL AND end IS NOT NULL").withColumn("zero_length", F.col("start") == F.col("end"))


def word_srt(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, text): words of lines '[a --> b] word'. One without a space after the bracket is glued to the word before."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    pattern = r"^\[(\d+):(\d+):(\d+[.,]\d+)\s*-->\s*(\d+):(\d+):(\d+[.,]\d+)\](\s?)(.*)$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    seconds = lambda i: part(i).cast("double") * 3600 + part(i + 1).cast("double") * 60 + F.replace(part(i + 2), F.lit(","), F.lit(".")).cast("double")
    words = rows.where(F.col("text").rlike(pattern)).select("line", seconds(1).alias("start"), seconds(4).alias("end"), (part(7) != "").alias("new"), F.trim(part(8)).alias("word"), F.lit(0).alias("file"))
    numbered = islands(words, ["file"], ["line"], F.col("new"))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word"))), lambda x: x["word"]), "")
    return numbered.groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end"), glued.alias("text")).orderBy("island").drop("island")


def question_maps(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(video, nth, kind, question, answer, options, level, timestamp_start, timestamp_end) of a JSON map from video to questions."""
    item = "struct<question:string,answer:string,options:array<string>,level:string,timestamp_start:string,timestamp_end:string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,array<{item}>>")).alias("video", "items"))
    return rows.select("video", F.posexplode("items").alias("nth", "q")).select("video", "nth", F.lit(kind).alias("kind"), "q.*").withColumn("level", F.replace("level", F.lit("_"), F.lit(" ")))


def page_units(pages: DataFrame) -> DataFrame:
    """Units of web pages(page_id, url, html): their text, by host."""
    return pages.select(F.col("page_id").alias("pos"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.lit("text").alias("modality"), T.html_text(F.col("html")).alias("content"), T.host(F.col("url")).alias("source_file"), location(page=F.col("page_id")).alias("location"))


def spoken(conversations: DataFrame, seconds_per_word: float = 0.5) -> DataFrame:
    """(by, nth, start, end, text): the words of conversations(conv_id, turn, text) on a clock of equal words."""
    lists = conversations.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: T.words(x["t"]))).alias("w"))
    words = lists.select(F.col("conv_id").cast("string").alias("by"), F.posexplode("w").alias("nth", "text"))
    return words.select("by", F.col("nth").cast("long").alias("nth"), (F.col("nth") * seconds_per_word).alias("start"), ((F.col("nth") + 1) * seconds_per_word).alias("end"), "text")


def first_words(docs: DataFrame) -> DataFrame:
    """Windows of words of documents, as the DOCX reader cuts them."""
    split = docs.select("doc_id", T.words(F.col("text")).alias("words"))
    return split.select("doc_id", F.posexplode(word_windows(F.col("words"))).alias("nth", "window"))


def page_range(units: DataFrame, first: int, last: int) -> DataFrame:
    """Units of an inclusive range of pages, from 1."""
    if first < 1 or last < first:
        raise ValueError(f"no such range of pages: {first} to {last}")
    return units.where(F.col("location.page").between(first, last))


def index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(units, meta) that sinks.index wrote."""
    return spark.read.parquet(f"{path}/units"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    """(rows, meta) of JSON lines whose _meta line, if any, is kept apart."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith('{"_meta"')).first()
    rows = lines.where(~F.col("value").startswith('{"_meta"')).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, json.loads(head[0])["_meta"] if head else {}


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored manifest, or nothing where there is none."""
    return spark.read.schema(schema).json(path) if scratch.exists(spark, path) else None


def named(spark: SparkSession, given: str, schema: str) -> DataFrame:
    """Rows of 'path=name', with the name beside."""
    path, _, name = given.rpartition("=")
    return spark.read.schema(schema).json(path).withColumn("name", F.lit(name))


def config(text: str, backend: str | None = None) -> dict:
    """Settings of a JSON text. A backend's block replaces the endpoint keys of the model, and those alone; budget and prices go along."""
    out = json.loads(text)
    models = out.setdefault("models", {})
    chosen = models.get("backends", {}).get(backend or models.get("backend", ""), {})
    # fixed values: what a backend may decide
    models["llm"] = models.get("llm", {}) | {k: v for k, v in chosen.items() if k in ("model", "base_url", "api_key_env", "billing", "backend")}
    models["llm"] |= {"budget": out.get("budget", {}), "pricing": models.get("pricing", {})}
    return out


def spoken_units(words: DataFrame, segmentation: str = "sentence", seconds: float = 30.0) -> DataFrame:
    """Units '<stem>:a<n>' of words(source_file, nth, start, end, text): sentences, or fixed spans of so many seconds, with their words."""
    if segmentation not in ("sentence", "fixed"):
        raise ValueError(f"segmentation is 'sentence' or 'fixed', not {segmentation!r}")
    if segmentation == "sentence":
        before = F.lag("text").over(Window.partitionBy("source_file").orderBy("nth"))
        cut = islands(words.withColumn("_ends", before.rlike(T.TERMINAL)), ["source_file"], ["nth"], F.col("_ends"), "_n").drop("_ends")
    else:
        cut = fixed_spans(words, "source_file", seconds).withColumnRenamed("bucket", "_n")
    listed = F.array_sort(F.collect_list(F.struct("nth", "start", "end", "text")))
    rows = cut.groupBy("source_file", "_n").agg(listed.alias("w"))
    told = F.transform("w", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    stem = F.regexp_replace(T.file_name(F.col("source_file")), r"\.[^.]+$", "")
    return rows.select(
        F.concat(stem, F.lit(":a"), F.col("_n").cast("string")).alias("id"), F.lit("audio").alias("modality"), F.array_join(F.col("w")["text"], " ").alias("content"), "source_file",
        location(start_s=F.array_min(F.col("w")["start"]), end_s=F.array_max(F.col("w")["end"])).alias("location"), told.alias("words"),
    )


def page_layout(blocks: DataFrame, drawings: DataFrame, pages: DataFrame, landscape: float = 0.6, deck: bool | None = None) -> DataFrame:
    """Units of paged files: (id, modality, content, source_file, location, deck).

    blocks(source_file, page, nth, kind, box, text), drawings(source_file, page, box) and
    pages(source_file, page, width, height) come from whatever parses the format. Texts are
    windows of a page's words; a file with landscape pages for the most part is a deck,
    unless told. Figures of decks are merged drawings under the page's title, those of
    papers the regions above captions.
    """
    key = F.concat_ws("\u001f", "source_file", F.col("page").cast("string"))
    part = lambda i: F.split("page_key", "\u001f")[i]
    flags = pages.groupBy("source_file").agg((F.avg((F.col("width") > F.col("height")).cast("double")) >= landscape).alias("deck"))
    flags = flags if deck is None else flags.withColumn("deck", F.lit(deck))
    told = regions.text_blocks(blocks).withColumn("page_key", key)
    texts = told.groupBy("source_file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " ").alias("text"))
    stem = F.regexp_replace(T.file_name(F.col("source_file")), r"\.[^.]+$", "")
    number = lambda mark: F.concat(stem, F.lit(":p"), F.col("page").cast("string"), F.lit(mark), F.col("n").cast("string"))
    windows = texts.select("source_file", "page", F.posexplode(word_windows(T.words(F.col("text")))).alias("n", "window"))
    text_units = windows.select(number(":t").alias("id"), F.lit("text").alias("modality"), F.array_join("window.words", " ").alias("content"), "source_file", location(page=F.col("page")).alias("location"))
    sheets = pages.withColumn("page_key", key)
    drawn = regions.figures(drawings.withColumn("page_key", key), sheets.select("page_key", "width", "height"), "page_key").where("kind = 'kept'")
    titled = drawn.join(regions.titles(told, "page_key"), "page_key", "left").select("page_key", "box", F.coalesce("title", F.lit("")).alias("caption"))
    anchored = regions.captioned(told, "page_key").select("page_key", "box", "caption")
    both = titled.withColumn("_deck", F.lit(True)).unionByName(anchored.withColumn("_deck", F.lit(False))).select(part(0).alias("source_file"), part(1).cast("int").alias("page"), "box", "caption", "_deck")
    chosen = both.join(flags, "source_file").where(F.col("deck") == F.col("_deck"))
    placed = chosen.withColumn("n", F.row_number().over(Window.partitionBy("source_file", "page").orderBy("box")) - 1)
    figure_units = placed.select(number(":f").alias("id"), F.lit("figure").alias("modality"), F.col("caption").alias("content"), "source_file", location(page=F.col("page"), bbox=F.col("box")).alias("location"))
    return text_units.unionByName(figure_units).join(flags, "source_file")


def image_units(images: DataFrame, read: Callable[[bytes], str] | None = None) -> DataFrame:
    """A figure unit for each of images(name, width, height, content): its text as an OCR callable reads it, white space collapsed, '' without one."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    if read is None:
        text = F.lit("")
    else:
        text = T.collapsed(F.pandas_udf(lambda s: s.map(lambda b: read(b)), "string")(F.col("content")))
    whole = F.array(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
    return images.select(F.concat(stem, F.lit(":f0")).alias("id"), F.lit("figure").alias("modality"), text.alias("content"), F.col("name").alias("source_file"), location(bbox=whole).alias("location"))


def ocr_available(program: str = "tesseract") -> bool:
    return shutil.which(program) is not None


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, files, first, last) of a JSON list of topics; the pages of notes are optional."""
    rows = spark.read.schema("topic string, files array<string>, notes_pages array<int>").option("multiLine", True).json(path)
    return rows.select("topic", "files", F.get("notes_pages", F.lit(0)).alias("first"), F.get("notes_pages", F.lit(1)).alias("last"))


def truth_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(t, text, slide) of a sheet with Time, Text and Key: missing texts are '', rows without a time go."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where(F.trim(F.coalesce("Time", F.lit(""))) != "").select(F.col("Time").try_cast("double").alias("t"), F.coalesce("Text", F.lit("")).alias("text"), F.col("Key").try_cast("int").alias("slide"))


def table_links(lines: DataFrame) -> DataFrame:
    """(id, url) of lines(text) 'name url' as a document's table gives them; a final dot of the address goes."""
    return lines.where(F.col("text").rlike(r"^\s*\S+\s+https?://")).select(F.regexp_extract("text", r"^\s*(\S+)", 1).alias("id"), F.rtrim(F.regexp_extract("text", r"(https?://\S+)", 1), F.lit(".")).alias("url"))
