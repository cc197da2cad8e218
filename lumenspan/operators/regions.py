"""Figure regions of pages, from a table of what a page holds: text blocks and boxes of drawings and images.

Whatever parses a page format gives rows of page, kind, box [x0, y0, x1, y1] and text;
all the rest is here. Only merging boxes until nothing changes walks in Python, page by
page, for boxes grow as they merge and so no plain closure of neighbours will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import places as P
from ..functions import text as T

# Fixed values, in points: what counts as a caption, a figure, a backdrop and a logo.
CAPTION = r"(?i)^\s*(figure|table)\s+(\d{1,2})\s*[:.]"
CAPTION_GAP, COLUMN_SHARE, PROSE_WORDS = 120.0, 0.3, 12
LEAST_HEIGHT, MOST_HEIGHT = 40.0, 420.0
CLUSTER_GAP, LEAST_AREA, BACKDROP_SHARE = 12.0, 8000.0, 0.8
LOGO_AREA, LOGO_CORNER = 15000.0, 100.0
#: Up to so many boxes of a page are merged one after the other.
IN_TURN = 2000


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of text (kind 0) with white space collapsed, empty ones left out, in the order nth."""
    return blocks.where("kind = 0").withColumn("text", T.collapsed(F.col("text"))).where("text != ''")


def titles(blocks: DataFrame, by: str = "page") -> DataFrame:
    """(by, title): the topmost block's text, of equals the first."""
    return blocks.groupBy(by).agg(F.min_by("text", F.struct(F.col("box")[1], F.col("nth"))).alias("title"))


def shared_width(a, b):
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0])


def captions(images: DataFrame, blocks: DataFrame, by: str = "page") -> DataFrame:
    """(by, image, caption) of images(by, image, box): the nearest block below within reach that shares some width, else ''."""
    b = blocks.select(F.col(by).alias("_by"), F.col("box").alias("_b"), "text", "nth")
    gap = F.col("_b")[1] - F.col("box")[3]
    met = (F.col(by) == F.col("_by")) & gap.between(0, CAPTION_GAP) & (shared_width(F.col("_b"), F.col("box")) > 0)
    pairs = images.join(b, met, "left")
    return pairs.groupBy(by, "image").agg(F.coalesce(F.min_by("text", F.struct(gap, F.col("nth"))), F.lit("")).alias("caption"))


def captioned(blocks: DataFrame, by: str = "page") -> DataFrame:
    """(by, nth, box, caption): the region above each block that begins as a caption does.

    It reaches up to the nearest block of prose in the same column, or as far as a
    figure may; one of too little height is none.
    """
    heads = blocks.where(F.col("text").rlike(CAPTION)).select(F.col(by).alias("_by"), F.col("nth").alias("_n"), F.col("box").alias("_c"), F.col("text").alias("caption"))
    prose = blocks.where(F.size(T.words(F.col("text"))) >= PROSE_WORDS)
    c, b = F.col("_c"), F.col("box")
    above = (F.col(by) == F.col("_by")) & (F.col("nth") != F.col("_n")) & (b[3] <= c[1]) & (shared_width(b, c) > COLUMN_SHARE * F.greatest(c[2] - c[0], F.lit(1.0)))
    found = heads.join(prose, above, "left").groupBy("_by", "_n", "_c", "caption").agg(F.max(b[3]).alias("_top"))
    top = F.greatest(F.coalesce("_top", F.lit(0.0)), c[1] - MOST_HEIGHT)
    rows = found.withColumn("_y", top).where(c[1] - F.col("_y") >= LEAST_HEIGHT)
    return rows.select(F.col("_by").alias(by), F.col("_n").alias("nth"), F.array(c[0], F.col("_y"), c[2], c[1]).alias("box"), "caption")


def touching(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Which boxes lie within a gap of which, on both axes."""
    low, high = boxes[:, None, :2], boxes[:, None, 2:]
    return ((low <= boxes[None, :, 2:] + gap) & (boxes[None, :, :2] <= high + gap)).all(axis=2)


def fused(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Boxes in place of all that touch each other, over and over, until none do."""
    while len(boxes) > 1:
        near = touching(boxes, gap)
        # every box takes the least number that reaches it
        label = np.arange(len(boxes))
        while (following := np.where(near, label[None, :], len(boxes)).min(axis=1)).tolist() != label.tolist():
            label = following
        kept = np.unique(label)
        if len(kept) == len(boxes):
            break
        boxes = np.array([np.concatenate((boxes[label == k, :2].min(axis=0), boxes[label == k, 2:].max(axis=0))) for k in kept])
    return boxes


def fused_in_turn(boxes: list[list[float]], gap: float) -> list[list[float]]:
    """The same, one box after the other: each takes in all that it touches as it grows."""
    out = []
    for x0, y0, x1, y1 in boxes:
        k = 0
        while k < len(out):
            a0, b0, a1, b1 = out[k]
            if x0 <= a1 + gap and a0 <= x1 + gap and y0 <= b1 + gap and b0 <= y1 + gap:
                x0, y0, x1, y1 = min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1)
                out[k] = out[-1]
                out.pop()
                k = 0
            else:
                k += 1
        out.append([x0, y0, x1, y1])
    return out


def merged(boxes: DataFrame, by: str = "page", gap: float = CLUSTER_GAP) -> DataFrame:
    """(by, box): boxes(by, box) merged until no two are within the gap. A batch has many pages: most hold few boxes."""
    out = to_arrow_schema(StructType.fromDDL(f"{by} {dict(boxes.dtypes)[by]}, box array<double>"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(fused_in_turn(x, gap) if len(x) <= IN_TURN else fused(np.array(x, np.float64), gap).tolist()) for x in batch.column(1).to_pylist()]
            pages = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pages.cast(out.field(0).type), pa.array([b for x in found for b in x], out.field(1).type)], schema=out)

    lists = boxes.select(by, "box").groupBy(by).agg(F.collect_list("box").alias("box"))
    return lists.mapInArrow(over, f"{by} {dict(boxes.dtypes)[by]}, box array<double>")


def figures(boxes: DataFrame, pages: DataFrame, by: str = "page", gap: float = CLUSTER_GAP) -> DataFrame:
    """(by, box, kind) of boxes(by, box) on pages(by, width, height): merged regions as 'kept', 'small' or 'logo'.

    Boxes without an area, and those that cover most of a page, are left out before.
    """
    sized = boxes.join(pages, by)
    b = F.col("box")
    plain = sized.where((b[2] > b[0]) & (b[3] > b[1]) & (P.box_area(b) < BACKDROP_SHARE * F.col("width") * F.col("height")))
    regions = merged(plain, by, gap).join(pages, by)
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    corner = (F.least(x, F.col("width") - x) < LOGO_CORNER) & (F.least(y, F.col("height") - y) < LOGO_CORNER)
    kind = F.when(P.box_area(b) < LEAST_AREA, "small").when((P.box_area(b) <= LOGO_AREA) & corner, "logo").otherwise("kept")
    return regions.select(by, "box", kind.alias("kind"))


def region_counts(regions: DataFrame, by: str = "page") -> DataFrame:
    """(by, clusters, kept, small, logos)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return regions.groupBy(by).agg(F.count("*").alias("clusters"), n("kept").alias("kept"), n("small").alias("small"), n("logo").alias("logos"))


def read_words(words: DataFrame, least: float = 50.0) -> DataFrame:
    """Words that an OCR engine read, words(..., confidence), of enough confidence."""
    return words.where(F.col("confidence") >= least)
