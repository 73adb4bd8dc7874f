"""Problem 7: evaluation texts leaking into training text.

All test items are normalised to word tokens (characters for Han and kana) and put into one
generalised suffix automaton. Every document is streamed through it token by token, always
knowing the longest suffix read so far that occurs in some item; where that run ends, it is
recorded with the items and positions it stands for. Runs are gathered by item and diagonal
(document position minus item position); a passage whose runs reach ``probe`` of an item is
then verified: the longest common subsequence of item and passage, words compared with
tolerance for damage, must reach ``coverage`` of the item's tokens. ``spans`` gives the places of the
passages in the text and ``cleaned`` the texts without them.

Defined results
---------------
* Null or empty documents and items match nothing; repeated document rows are reported
  once for each row's id; items that are equal after normalisation are all reported.
* Case, accents, punctuation, markup, hyphenated line breaks and spacing are ignored.
* An item shorter than ``min_run`` tokens can only match as a whole.
* Very long documents are streamed whole, in memory linear in their own length.
* Empty tables give an empty result. Only the named columns are read.

Items are the held-out side: their number does not follow the corpus. They are taken in
blocks of at most ``BLOCK_CHARS`` characters, one pass each, so that an automaton's size is
bounded whatever their number; documents are never shuffled or collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table, written

COVERAGE, PROBE = 0.5, 0.2
MIN_RUN, MIN_RUN_CJK = 2, 3
BLOCK_CHARS = 4_000_000

_CJK = "぀-ヿ㐀-䶿一-鿿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_HYPHEN = re.compile(r"(?<=\w)[-‐­][^\S\n]*\n\s*(?=\w)")
_TAG = re.compile(r"<[^<>\n]+>")
_ENTITY = re.compile(r"&#?\w{1,8};")
_MARKS = re.compile(r"[̀-ͯ]+")
#: Letters that canonical decomposition leaves whole.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "­": ""})


def tokens(text: str) -> list[str]:
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_LETTERS)
        # decomposed kana marks are no letters; compose them again
        text = unicodedata.normalize("NFC", text)
    return _TOKEN.findall(text)


_PIECE = re.compile(rf"<[^<>\n]+>|&#?\w{{1,8}};|[{_CJK}]|[^\W_{_CJK}][^\W_{_CJK}̀-ͯ­]*(?:[-‐­][^\S\n]*\n\s*[^\W_{_CJK}]+)*")


def located(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens with their places, starts 0-based and ends exclusive; a word broken over two lines is one token."""
    out, places = [], []
    for m in _PIECE.finditer(text):
        if m.group()[0] not in "<&":
            for t in tokens(m.group()):
                out.append(t)
                places.append(m.span())
    return out, places


class Automaton:
    """Generalised suffix automaton over token lists, with the end positions of each state."""

    def __init__(self, sequences: Iterable[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token, ends)
                ends[last].append((number, at))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        self.children: list[list[int]] = [[] for _ in self.length]
        for s in order:
            self.children[self.link[s]].append(s)
        self.ends = ends

    def _extend(self, last: int, token: str, ends) -> int:
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            q = nxt[last][token]
            if length[last] + 1 == length[q]:
                return q
            return self._clone(last, token, q, ends)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append([])
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, token, q, ends)
        return cur

    def _clone(self, p: int, token: str, q: int, ends) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append([])
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = c
            p = link[p]
        link[q] = c
        return c

    @lru_cache(maxsize=1 << 16)
    def occurrences(self, state: int) -> tuple[tuple[int, int], ...]:
        """``(sequence, last position)`` of every place the state's strings occur at."""
        found, todo = [], [state]
        while todo:
            s = todo.pop()
            found.extend(self.ends[s])
            todo.extend(self.children[s])
        return tuple(found)

    def runs(self, stream: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """``(end, length, state)`` of maximal runs of the stream that occur in some sequence."""
        nxt, link, length = self.next, self.link, self.length
        root = nxt[0]
        state = run = 0
        for at, token in enumerate(stream):
            if not state:
                state = root.get(token, 0)
                run = 1 if state else 0
                continue
            go = nxt[state].get(token)
            if go is not None:
                state = go
                run += 1
                continue
            if run >= least:
                yield at, run, state
            while state > 0:
                state = link[state]
                go = nxt[state].get(token)
                if go is not None:
                    run = length[state] + 1
                    state = go
                    break
            else:
                state = root.get(token, 0)
                run = 1 if state else 0
        if run >= least:
            yield len(stream), run, state


def _damaged(a: str, b: str) -> bool:
    """Whether two different words are one word up to slight damage."""
    n, m = len(a), len(b)
    most = 1 if min(n, m) < 7 else 2
    if min(n, m) < 4 or abs(n - m) > most:
        return False
    row = list(range(m + 1))
    before: list[int] = []
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, cur[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return False
        before, row = row, cur
    return row[m] <= most


class Items:
    def __init__(self, items: tuple[tuple[int, str], ...]):
        seen: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for number, text in items:
            if t := tuple(tokens(text)):
                seen[t].append(number)
        self.sequences = list(seen)
        self.ids = list(seen.values())
        self.masks = [self._mask(s) for s in self.sequences]
        cjk = re.compile(f"[{_CJK}]")
        self.least = [MIN_RUN_CJK if sum(bool(cjk.match(t)) for t in s) * 2 > len(s) else MIN_RUN for s in self.sequences]
        self.automaton = Automaton(map(list, self.sequences))

    @staticmethod
    def _mask(sequence: tuple[str, ...]) -> dict[str, int]:
        mask: dict[str, int] = defaultdict(int)
        for i, t in enumerate(sequence):
            mask[t] |= 1 << i
        return dict(mask)

    def _agreement(self, number: int, passage: list[str], backwards: bool = False) -> tuple[int, int]:
        """Longest common subsequence, bit-parallel, with damaged words counted as equal, and where it is first complete."""
        mask, size = self.masks[number], len(self.sequences[number])
        if backwards:
            mask = self._mask(self.sequences[number][::-1])
        full = (1 << size) - 1
        v, near, steps = full, None, []
        for token in passage:
            m = mask.get(token)
            if m is None and len(token) >= 4:
                if near is None:
                    near = {}
                m = near.get(token)
                if m is None:
                    m = near[token] = sum({b for w, b in mask.items() if _damaged(token, w)})
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
            steps.append(v)
        best = size - v.bit_count()
        end = next((i + 1 for i, x in enumerate(steps) if x == v), 0) if best else 0
        return best, end

    def passages(self, stream: list[str], coverage: float, probe: float, every: bool = False) -> Iterator[tuple[int, int, int]]:
        """``(sequence, first token, after the last)`` of passages that hold a sequence; of each sequence the first one, or ``every`` one."""
        auto = self.automaton
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short = min(self.least, default=MIN_RUN)
        for end, run, state in auto.runs(stream, 1 if any(len(s) < short for s in self.sequences) else short):
            for number, last in auto.occurrences(state):
                if run >= self.least[number] or run == len(self.sequences[number]):
                    hits[number].append((end - 1 - last, run))
        for number, runs in hits.items():
            size = len(self.sequences[number])
            if sum(r for _, r in runs) < probe * size:
                continue
            runs.sort()
            slack = max(4, int(0.3 * size))
            lo = weight = 0
            done = None
            for hi, (diagonal, run) in enumerate(runs):
                weight += run
                while diagonal - runs[lo][0] > slack:
                    weight -= runs[lo][1]
                    lo += 1
                if weight < probe * size or done is not None and diagonal <= done:
                    continue
                start = max(0, runs[lo][0] - 3)
                done = diagonal + slack // 2
                passage = stream[start: max(diagonal, done) + size + slack]
                common, end = self._agreement(number, passage)
                if common >= coverage * size:
                    if not every:
                        yield number, start, start + end
                        break
                    # the shortest stretch that still holds as much: its end, then its beginning from behind
                    length = self._agreement(number, passage[:end][::-1], backwards=True)[1]
                    yield number, start + end - length, start + end

    def leaks(self, text: str, coverage: float, probe: float) -> set[int]:
        return {i for number, _, _ in self.passages(tokens(text), coverage, probe) for i in self.ids[number]}

    def spans(self, text: str, coverage: float, probe: float) -> list[tuple[int, int, int]]:
        """``(item, start, end)`` in code points of every passage."""
        stream, places = located(text)
        return sorted({(i, places[a][0], places[b - 1][1]) for number, a, b in self.passages(stream, coverage, probe, every=True) for i in self.ids[number]})


@lru_cache(maxsize=4)
def _prepared(items: tuple[tuple[int, str], ...]) -> Items:
    return Items(items)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[tuple[int, str], ...]]:
    block, size = [], 0
    for r in items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def _scanned(documents: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, rows_of, schema: str) -> DataFrame:
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).where("_text is not null and doc_id is not null")
    out = None
    for block in _blocks(items, item_col, item_text_col):
        def scan(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            prepared = _prepared(block)
            for pdf in batches:
                rows = [(d, *r) for d, t in zip(pdf["doc_id"], pdf["_text"]) for r in rows_of(prepared, t)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype("int64")

        part = docs.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def leaked(documents: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", coverage: float = COVERAGE, probe: float = PROBE) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a passage of an item."""
    return _scanned(documents, items, doc_col, text_col, item_col, item_text_col, lambda x, t: ((i,) for i in sorted(x.leaks(t, coverage, probe))), "doc_id long, item_id long")


def spans(documents: DataFrame, items: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", coverage: float = COVERAGE, probe: float = PROBE) -> DataFrame:
    """``(doc_id, item_id, span_start, span_end)`` of the passages found, in code points."""

    def rows(x: Items, t: str) -> list[tuple[int, int, int]]:
        return x.spans(t, coverage, probe) if x.leaks(t, coverage, probe) else []

    return _scanned(documents, items, doc_col, text_col, item_col, item_text_col, rows, "doc_id long, item_id long, span_start long, span_end long")


def cleaned(documents: DataFrame, found: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of all documents, without the spans found; every other character stays as it is."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or c is None else remove(t, [(x["a"], x["b"]) for x in c]) for t, c in zip(texts, cuts)], dtype=object)

    per = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("span_start").alias("a"), F.col("span_end").alias("b"))).alias("_c"))
    rows = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    # only documents that leak are sent to Python
    joined = rows.join(per, "doc_id", "left")
    return joined.where("_c is null").select("doc_id", F.col("_text").alias("text")).unionByName(
        joined.where("_c is not null").select("doc_id", without("_text", "_c").alias("text")))


def remove(text: str, cuts: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(cuts):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "bench_items"))


def by_item(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item."""
    return found(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return spans(table(spark, d, "documents"), table(spark, d, "bench_items"))


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the passages they leak."""
    documents = table(spark, d, "documents")
    return cleaned(documents, written(places(spark, d)))


QUERIES = {"p7_found": found, "p7_items": by_item, "p7_spans": places, "p7_clean": clean}
