"""The link build: alignment, figures and text, same page and pointing words, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, graph, links


def link_corpus(audio: DataFrame, slides: DataFrame, texts: DataFrame, figures: DataFrame, found: DataFrame, mode: str = "linked", penalties: alignment.Penalties = alignment.Penalties(), z: float | None = 1.27, least: float | None = None, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Links(src_id, dst_id, link_type, score) of a corpus.

    audio(pair, i, id, text, embedding) and slides(pair, j, id, text, embedding) hold
    every recording with every deck it may be about; figures and texts are units with
    embeddings, found the cues of the audio with their contexts' embeddings. ``by`` names
    columns that a figure and a text must share (a corpus, a topic); slides have the
    columns of units beside. Where a segment is aligned with several decks, the slide of
    the best link is the one shown, of equals that of the greater pair and slide.
    """
    cells = alignment.hybrid_similarity(audio, slides)
    gates = alignment.related(cells, penalties, z) if z is not None else None
    path = alignment.abstained(alignment.monotone(cells, penalties) if mode == "linked" else alignment.naive(cells), cells, least)
    aligned = links.aligned_links(path, audio, slides, gates)
    scores = links.figure_text_scores(figures, texts, by=by, reach=links.farthest_page(threshold))
    near = links.figure_text(scores, threshold, same_page_only=mode == "baseline")
    where = links.slide_map(aligned.withColumn("nth", F.struct("score", "dst_id")), slides) if mode == "linked" else None
    pointed = links.deictic(found, figures, where)
    parts = [aligned, near.drop("why"), links.same_slide(figures, texts, enabled=mode == "linked"), pointed.select(*links.LINK)]
    return graph.union_all([p.select(*links.LINK) for p in parts])
