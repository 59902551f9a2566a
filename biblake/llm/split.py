"""Splitting oversized sections at natural boundaries.

Method: every position where a section may be cut has a strength (paragraph, sentence, word). A sparse table over the
strengths answers, for the window of lengths a piece may have, which cut is strongest; among equals the rightmost one
wins, which makes pieces long. The window is the later half of the limit, or all of it if that half has no cut of the
kind that suffices for the text. The next piece starts ``overlap`` characters before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LIMIT, OVERLAP = 3000, 200
PARAGRAPH, SENTENCE, WORD, NONE = 3, 2, 1, 0
NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", NONE: "none"}
_BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")


class RangeMaximum:
    """Sparse table: the maximum of any range of a fixed array from two lookups."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-step], below[step:]))
            step *= 2

    def __call__(self, first: int, end: int) -> int:
        level = (end - first).bit_length() - 1
        row = self.levels[level]
        return int(max(row[first], row[end - (1 << level)]))


def boundaries(text: str) -> tuple[list[int], np.ndarray, dict[int, int]]:
    """Positions where ``text`` may be cut (a piece ends before them), their strengths, and by kind the longest unit between them.

    White space stays with the piece before it. A sentence ends in ``.``, ``!`` or ``?`` before white space.
    """
    strength: dict[int, int] = {}
    longest = {PARAGRAPH: 0, SENTENCE: 0, WORD: 0}
    for kind, pattern in ((WORD, _SPACE), (SENTENCE, _SENTENCE_END), (PARAGRAPH, _BLANK_LINES)):
        for m in pattern.finditer(text):
            strength[m.end()] = kind
    strength.pop(0, None), strength.pop(len(text), None)
    spans = [(m.start(), m.end(), PARAGRAPH) for m in _BLANK_LINES.finditer(text)]
    for kind, marks in (
        (PARAGRAPH, spans),
        (SENTENCE, sorted([*spans, *((m.start(), m.end(), SENTENCE) for m in _SENTENCE_END.finditer(text))])),
        (WORD, [(m.start(), m.end(), WORD) for m in _SPACE.finditer(text)]),
    ):
        at = 0
        for a, b, _ in marks:
            longest[kind] = max(longest[kind], a - at)
            at = max(at, b)
        longest[kind] = max(longest[kind], len(text) - at)
    cuts = sorted(strength)
    return cuts, np.array([strength[c] for c in cuts], np.int64), longest


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[int, list[tuple[int, int, int]]]:
    """The weakest kind of boundary that must be used, and ``(start, end, strength of the cut at end)`` of the pieces.

    All pieces have at most ``limit`` characters, and each but the first begins with the last ``overlap`` characters of
    the one before (all of it if it is shorter). The end of the text counts as a paragraph's.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return PARAGRAPH, [(0, len(text), PARAGRAPH)] if text else []
    cuts, strengths, longest = boundaries(text)
    needed = next((k for k in (PARAGRAPH, SENTENCE, WORD) if longest[k] <= limit), NONE)
    n = len(cuts)
    best = RangeMaximum(strengths * (n + 1) + np.arange(n)) if n else None
    out, start, cut = [], 0, 0
    while start + limit < len(text):
        a, b = bisect_right(cuts, cut), bisect_right(cuts, start + limit)
        late = max(a, bisect_right(cuts, start + limit // 2))
        key = best(late, b) if late < b else None
        # earlier in the window only for a boundary of the kind that suffices for the text
        if a < late and (key is None or key // (n + 1) < needed):
            early = best(a, b)
            key = early if key is None or early // (n + 1) >= needed else key
        if key is not None:
            end, kind = cuts[key % (n + 1)], key // (n + 1)
        else:
            end, kind = start + limit, NONE
        out.append((start, end, kind))
        start, cut = max(start, end - overlap), end
    return needed, [*out, (start, len(text), PARAGRAPH)]


def split_sections(sections: DataFrame, md: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of the sections of the valid index: ``paper_id, ord, title, boundary, span, piece, start, end, cut[, text]``.

    ``start`` and ``end`` are offsets in ``md``. The valid row of a section is the one of the latest ``generated_at``
    (of equal ones the greatest start); a null ``end_offset`` means the start of the next section or the end of
    ``md``; of several texts of a paper the latest counts (of equal ones the greatest). Sections without a text, with
    a null start or an empty span give no rows; ends beyond the text are cut to it. Blank and null titles stay as they
    are. ``boundary`` is the first of paragraph, sentence, word whose units all fit the limit, else none; ``span`` is
    the section's length. Other columns of the tables are ignored; empty tables give no rows.
    """
    index = sections.groupBy("paper_id").agg(F.collect_list(F.struct("ord", "generated_at", "start_offset", "end_offset", "title")).alias("index"))
    text = md.where("md is not null").groupBy("paper_id").agg(F.max_by("md", F.struct("generated_at", F.xxhash64("md"))).alias("md"))
    fields = "paper_id string, ord int, title string, boundary string, span int, piece int, start int, end int, cut string"
    names = [x.split()[0] for x in fields.split(", ")] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for paper, doc, entries in zip(*(c.to_pylist() for c in batch.columns)):
                valid: dict[int, dict] = {}
                for e in sorted(entries, key=lambda e: (e["generated_at"] is not None, e["generated_at"] or 0, e["start_offset"] or -1)):
                    if e["ord"] is not None:
                        valid[e["ord"]] = e
                order = [valid[o] for o in sorted(valid) if valid[o]["start_offset"] is not None]
                for k, e in enumerate(order):
                    begin, end = max(0, e["start_offset"]), e["end_offset"]
                    if end is None:
                        end = order[k + 1]["start_offset"] if k + 1 < len(order) else len(doc)
                    span = doc[begin : min(end, len(doc))] if end > begin else ""
                    needed, cut = pieces(span, limit, overlap)
                    for i, (a, b, kind) in enumerate(cut):
                        rows.append((paper, e["ord"], e["title"], NAMES[needed], len(span), i, begin + a, begin + b, NAMES[kind], *([span[a:b]] * with_text)))
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    joined = text.join(index, "paper_id").select("paper_id", "md", "index")
    return joined.mapInArrow(run, fields + ", text string" * with_text)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Sections longer than 3,000 characters and the boundary that suffices to split them."""
    cut = split_sections(table(spark, root, "sections"), table(spark, root, "paper_md"), with_text=False)
    return cut.where(f"span > {LIMIT} and piece = 0").select("paper_id", "ord", "boundary")


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All sections in pieces of at most 3,000 characters."""
    return split_sections(table(spark, root, "sections"), table(spark, root, "paper_md"))
