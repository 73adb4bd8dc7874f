"""Problem 6: cutting oversized items at natural boundaries.

Recursive separator hierarchy: an item over the limit is split by section, a section over
the limit by paragraph, then by sentence, word and, where nothing else is left, character.
The resulting atoms (each within the limit) are packed greedily into pieces, and every
piece but the first repeats at most ``overlap`` trailing characters of the one before.

Defined results
---------------
* Null or empty contents, and contents within the limit, give no pieces (they need none).
* Offsets are code points, starts 0-based and ends exclusive; the parts of the pieces
  after their overlap (``new_start`` to ``end``) tile the contents exactly.
* The overlap shrinks where the next atom would not fit otherwise, so an atom within the
  limit is never cut to make room for an overlap.
* Character cuts avoid separating a combining mark from its base where one is near.
* Repeated rows give repeated pieces; other columns of the input are ignored, whatever
  their names.

The work is one narrow pass: no shuffle, one Arrow batch at a time, rows within the limit
dropped in the JVM before any text reaches Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table

LIMIT, OVERLAP = 1500, 150

#: Fixed value: the marks after which an item may be cut without white space.
MARKS = ".!?…。！？؟።։।"

_HEADING = re.compile(r"§|#|\d+(?:\.\d+)*\.?\s+\S|[A-Z]\.\s|[^\n.!?]{1,60}\n[^\S\n]*\n")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(rf"[{MARKS}]+[\"'”’»\)\]』」】）]*\s*")
_WORD = re.compile(rf"\s+|[{MARKS}]+")
_PATTERNS = (_PARAGRAPH, _PARAGRAPH, _SENTENCE, _WORD)
#: The separator that made a unit, from coarse to fine; the last needs no pattern.
LEVELS = ("whole", "section", "paragraph", "sentence", "word", "character")
FORCED = LEVELS.index("character")


def _char_cuts(text: str, start: int, end: int, limit: int) -> list[int]:
    cuts, at = [], start
    while end - at > limit:
        cut = at + limit
        back = cut
        while back > at + limit // 2 and unicodedata.combining(text[back]):
            back -= 1
        at = back if back > at + limit // 2 else cut
        cuts.append(at)
    return cuts


def atoms(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """``(start, end, level)`` of units within the limit that tile ``start`` to ``end``."""
    if end - start <= limit:
        yield start, end, level
        return
    if level == len(_PATTERNS):
        at = start
        for cut in [*_char_cuts(text, start, end, limit), end]:
            yield at, cut, level + 1
            at = cut
        return
    at = start
    for m in _PATTERNS[level].finditer(text, start, end):
        cut = m.end()
        if level == 0 and not _HEADING.match(text, cut):  # a section begins with a heading
            continue
        if level == 3 and cut - at > limit >= m.start() - at:
            cut = m.start()  # a run that just fits leaves its separator to the next atom
            if cut > at:
                yield from atoms(text, at, cut, limit, level + 1)
                at = cut
            cut = m.end()
        if at < cut < end:
            yield from atoms(text, at, cut, limit, level + 1)
            at = cut
    yield from atoms(text, at, end, limit, level + 1)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces as ``(start, new_start, end, level)``; level is the finest cut the piece needed."""
    if len(text) <= limit:
        return [(0, 0, len(text), 0)] if text else []
    pieces: list[tuple[int, int, int, int]] = []
    begin = new = stop = 0
    finest = 0
    for a, b, level in atoms(text, 0, len(text), limit):
        # a unit may take room that an overlap would have used
        lead = min(new - begin, max(0, limit - (b - new)))
        if stop > new and b - new + lead > limit or b - new > limit:
            pieces.append((begin, new, stop, finest))
            new = stop
            begin = _overlap_start(text, pieces[-1][1], stop, min(overlap, limit - (b - a)))
            finest = 0
        elif b - begin > limit:
            begin = new - lead
        stop = b
        finest = max(finest, level)
    pieces.append((begin, new, stop, finest))
    return pieces


def _overlap_start(text: str, floor: int, stop: int, room: int) -> int:
    """Start of the overlap that ends at ``stop``: after white space if there is any in reach."""
    lowest = max(floor, stop - max(0, room))
    if lowest >= stop:
        return stop
    if lowest == 0 or text[lowest - 1].isspace():
        return lowest
    m = re.compile(r"\s+").search(text, lowest, stop)
    return m.end() if m and m.end() < stop else lowest


_PIECES = "array<struct<piece_no:int,start:int,new_start:int,end:int,level:string>>"


def split_oversized(df: DataFrame, *, id_col: str = "id", text_col: str = "contents", limit: int = LIMIT,
                    overlap: int = OVERLAP, keep: tuple[str, ...] = ("parent_id", "hierarchy")) -> DataFrame:
    """One row per piece of each item over the limit, with the columns in ``keep``."""

    @F.pandas_udf(_PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[(i, s, n, e, LEVELS[v]) for i, (s, n, e, v) in enumerate(split(t, limit, overlap))] for t in texts])

    over = df.where(F.length(text_col) > limit).select(
        F.col(id_col).alias("id"), *[F.col(c) for c in keep if c != "id"], F.col(text_col).alias("_text"))
    cut = over.withColumn("_p", F.explode(pieces("_text")))
    return cut.select("id", *[c for c in keep if c != "id"], "_p.piece_no", "_p.start", "_p.new_start", "_p.end", "_p.level",
                      F.expr("substring(_text, _p.start + 1, _p.end - _p.start)").alias("piece"))


def kinds(df: DataFrame, **options) -> DataFrame:
    """``(id, kind)`` per oversized item: ``forced`` where a cut inside an unbroken run was needed."""
    limit, overlap = options.get("limit", LIMIT), options.get("overlap", OVERLAP)
    id_col, text_col = options.get("id_col", "id"), options.get("text_col", "contents")

    @F.pandas_udf("string")
    def kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(["forced" if any(p[3] == FORCED for p in split(t, limit, overlap)) else "natural" for t in texts])

    over = df.where(F.length(text_col) > limit)
    return over.select(F.col(id_col).alias("id"), kind(text_col).alias("kind"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("hierarchy = 'parent' and is_search").select("id", "parent_id", "hierarchy", "contents")


QUERIES = {
    "p6_found": lambda spark, d: kinds(_parents(spark, d)),
    "p6_pieces": lambda spark, d: split_oversized(_parents(spark, d)),
}

#: Fixed values of the definition: the marks that, like white space, end an unbroken run.
ORACLE = {
    "p6_found": """
        SELECT id, CASE WHEN list_max(list_transform(
                       string_split_regex(contents, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.!?…。！？؟।።։]'),
                       lambda s: length(s))) > 1500 THEN 'forced' ELSE 'natural' END AS kind
        FROM chunks WHERE hierarchy = 'parent' AND is_search AND length(contents) > 1500""",
}
