"""Problem 9: keyword-stuffed and link-list pages.

Texts become sequences of word classes: function words by role, numbers, links, tags and marks are
classes, a content word is *new* or *again* (seen among the last words), so stuffing
shows as a class of its own and not only as missing function words. A trigram model of the
classes, trained on prose, scores windows of the text; windows whose perplexity is far from
that of prose on either side are abnormal, and a page is flagged when more than half of its
characters lie in abnormal windows.

Training
--------
1. every text is turned into classes once, in the Python workers, and stored as bytes (one
   a token) with the window lengths: the shared intermediate of both steps;
2. class trigrams are counted over the windows of *all* documents that look like prose by
   their own composition (enough function words, few repeats, links and tags), by script;
   counts are tables of a fixed size, summed in Spark;
3. the windows' mean log-probabilities are summed into fixed-size histograms, whose median
   and spread over the prose windows place the two limits for each script.

Defined results
---------------
* Null, empty and blank texts are not flagged: they hold no material.
* A text of one window or less is judged as that window; one of fewer than three tokens has
  no trigram to judge and is not flagged.
* Repeated rows get the same verdict each; extra columns are ignored.
* Empty tables give an empty result.
* If no window looks like prose at all (a table of nothing but spam), the model is uniform
  and the composition test alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table, written

WINDOW, RECENT = 48, 60
#: Windows further than this many spreads below or above the median of prose are abnormal.
LOW_SPREADS, HIGH_SPREADS = 3.0, 4.0

#: Function words of en, de, fr, pl by role, then characters of zh and ja.
FUNCTION_WORDS = {
    "article": "a an the der die das des dem den ein eine einer eines einem einen le la les l un une du ce cette",
    "preposition": "of to in on at by for from with into than zu von mit für auf aus nach bei im am vom zum zur de d à au aux en dans par pour sur avec selon "
                   "w z ze na do od po o u za dla przez przy według",
    "conjunction": "and or not nor und oder et ou i oraz lub a nie",
    "relative": "which that this wherein whereby it its wobei dass sich dadurch qui que dont lequel że się który która które którym jako",
    "verb": "is are be has have including ist sind wird werden est sont jest są",
    "particle": "的与是在和于对并以及或其所中将为了のにをはがとでもへやから",
}
_CJK = "぀-ヿ㐀-䶿一-鿿"
_PATTERN = (
    r"https?://\S+|www\.\S+|<a\s[^>]*>|</a>|\]\([^)\s]*\)|[\w-]+(?:\.[\w-]+)+(?:/\S*)?|#\w+"
    rf"|\d[\d.,]*|[{_CJK}]@|[^\W\d_{_CJK}]+|\n+(?:[-*•]\s)?|[^\w\s]"
)
#: In a text of words, a run of characters is one foreign word.
_TOKEN_CJK, _TOKEN_WORD = re.compile(_PATTERN.replace("]@|", "]|")), re.compile(_PATTERN.replace("]@|", "]+|"))
_RUNS = re.compile(f"[{_CJK}]+")
_LINK = re.compile(r"https?:|www\.|<|\]\(|[\w-]+\.[a-z]")
_KINDS = ("new", "again", "often", "stuffed", "number", "link", "tag", "dot", "comma", "mark", "bracket", "line", "bullet", "symbol", "capital", "cjk", "cjk_again", "cjk_often", "cjk_stuffed")
KIND = {k: i for i, k in enumerate(_KINDS)}
#: So many earlier uses among the recent words make a content word of this class.
_RECURRENCE = ((1, "again", "cjk_again"), (2, "often", "cjk_often"), (4, "stuffed", "cjk_stuffed"))
_AGAIN = tuple(KIND[k] for r in _RECURRENCE for k in r[1:])
_CHARS = (KIND["cjk"], *(KIND[r[2]] for r in _RECURRENCE))
_FIRST = len(_KINDS)
_FUNCTION = {w: _FIRST + i for i, (role, words) in enumerate(FUNCTION_WORDS.items()) for w in (words if role == "particle" else words.split())}
CLASSES = _FIRST + len(FUNCTION_WORDS)
SCRIPTS = ("word", "cjk")
_MARKS = {**dict.fromkeys(".!?。！？", "dot"), **dict.fromkeys(",，、;；:：", "comma"), **dict.fromkeys("()[]（）「」{}", "bracket")}
BINS, BIN_LOW, BIN_HIGH = 800, -8.0, 0.0
#: No single token counts for less: foreign or broken bits do not decide about a window.
FLOOR = -6.0
#: A context is trusted beyond the shorter one by its share of all training tokens, not by its bare
#: count: so many of them for each kind of class seen after it are put in from the shorter context.
TRUST = 1e-5


class _Memo(dict):
    """Class of a token before recency is known; content words get NEW or CJK."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        c = token[0]
        low = token.lower()
        if low in _FUNCTION:
            k = _FUNCTION[low]
        elif c in _MARKS and len(token) == 1:
            k = KIND[_MARKS[c]]
        elif c == "\n":
            k = KIND["line" if token.isspace() and token[-1] == "\n" else "bullet"]
        elif c == "#" and len(token) > 1:
            k = KIND["tag"]
        elif c.isdigit() and not any(x.isalpha() for x in token):
            k = KIND["number"]
        elif _LINK.match(token):
            k = KIND["link"]
        elif re.match(f"[{_CJK}]", c):
            k = KIND["cjk"]
        elif c.isalpha():
            k = KIND["new"]
        else:
            k = KIND["symbol"]
        self[token] = k
        return k


_memo = _Memo()


def classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and its length in characters."""
    chars = 0 if text.isascii() else sum(map(len, _RUNS.findall(text)))
    characters = chars * 4 > len(text)
    toks = (_TOKEN_CJK if characters else _TOKEN_WORD).findall(text)
    k = np.fromiter(map(_memo.__getitem__, toks), dtype=np.uint8, count=len(toks))
    n = np.fromiter(map(len, toks), dtype=np.int32, count=len(toks))
    if not characters:
        k[k == KIND["cjk"]] = KIND["new"]
    content = np.flatnonzero((k == KIND["new"]) | (k == KIND["cjk"]))
    if len(content) > 1:
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(toks[i].lower(), len(numbers)) for i in content.tolist()), dtype=np.int64, count=len(content))
        cjk = k[content] == KIND["cjk"]
        pair = np.zeros_like(ids)
        # a character recurs with its neighbours: single ones recur in any text
        pair[2:] = (ids[:-2] + 1) * len(numbers) ** 2 + ids[1:-1] * len(numbers)
        key = np.where(cjk, ids + pair, ids)
        order = np.argsort(key, kind="stable")
        sorted_key, place = key[order], content[order]
        reach = np.where(cjk[order], RECENT * 2, RECENT)
        for back, word, char in _RECURRENCE:
            if len(order) > back:
                m = (sorted_key[back:] == sorted_key[:-back]) & (place[back:] - place[:-back] <= reach[back:])
                hit = order[back:][m]
                k[content[hit]] = np.where(cjk[hit], KIND[char], KIND[word])
    return k, n


def _windows(k: np.ndarray) -> np.ndarray:
    """Window number of each token; a short rest joins the window before."""
    count = max(1, round(len(k) / WINDOW))
    return np.minimum(np.arange(len(k)) * count // max(1, len(k)), count - 1)


_CLASS_OF = np.zeros((CLASSES, 8), dtype=np.float64)
for _c in range(CLASSES):
    _CLASS_OF[_c] = [
        _c >= _FIRST, _c in (KIND["new"], KIND["cjk"]), _c in _AGAIN, _c in (KIND["link"], KIND["tag"]),
        _c == KIND["number"], _c in (KIND["stuffed"], KIND["cjk_stuffed"]), _c in _CHARS, _c in (KIND["line"], KIND["bullet"], KIND["bracket"], KIND["symbol"]),
    ]


def _composition(k: np.ndarray, w: np.ndarray) -> np.ndarray:
    count = int(w[-1]) + 1
    comp = np.stack([np.bincount(w, weights=_CLASS_OF[k, j], minlength=count) for j in range(8)], axis=1)
    return comp / np.bincount(w, minlength=count)[:, None]


def _script(comp: np.ndarray) -> np.ndarray:
    return (comp[:, 6] > 0.3).astype(int)


def _prose_like(comp: np.ndarray) -> np.ndarray:
    """Windows used for training: function words between mostly fresh content words, none of them stuffed."""
    fresh = comp[:, 1] > 1.5 * comp[:, 2]
    return (comp[:, 0] > 0.15) & fresh & (comp[:, 3] < 0.03) & (comp[:, 4] < 0.2) & (comp[:, 7] < 0.25) & (comp[:, 5] == 0)


def encoded(documents: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """``(doc_id, k, n)``: one byte a token for its class and four for its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["_text"]):
                k, n = classes(t)
                if len(k):
                    rows.append((d, k.tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "n"]).astype({"doc_id": "int64"})

    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).where("_text is not null and doc_id is not null")
    return docs.mapInPandas(run, "doc_id long, k binary, n binary")


def _trigrams(k: np.ndarray) -> np.ndarray:
    """Number of the trigram that ends at each token from the third on."""
    x = k.astype(np.int32)
    return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]


def _window_counts(k: np.ndarray) -> np.ndarray:
    """Trigram counts by script over a text's prose-like windows."""
    total = np.zeros((2, CLASSES**3), dtype=np.int64)
    if len(k) < 3:
        return total
    w = _windows(k)
    comp = _composition(k, w)
    use, script = _prose_like(comp)[w], _script(comp)[w]
    tri = _trigrams(k)
    for s in (0, 1):
        m = use[2:] & (script[2:] == s)
        if m.any():
            total[s] = np.bincount(tri[m], minlength=CLASSES**3)
    return total


def _counts(enc: DataFrame) -> np.ndarray:
    """Class trigrams of all documents' prose-like windows: one table of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CLASSES**3), dtype=np.int64)
        for pdf in batches:
            for kb in pdf["k"]:
                total += _window_counts(np.frombuffer(kb, dtype=np.uint8))
        s, p = np.nonzero(total)
        yield pd.DataFrame({"s": s, "p": p, "c": total[s, p]})

    rows = enc.select("k").mapInPandas(run, "s int, p int, c long").groupBy("s", "p").agg(F.sum("c").alias("c")).toPandas()
    total = np.zeros((2, CLASSES**3))
    total[rows["s"], rows["p"]] = rows["c"]
    return total.reshape(2, CLASSES, CLASSES, CLASSES)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the interpolated trigram model, for both scripts.

    Weights depend on shares of the training tokens, so that the same documents many times
    over give the same model; tables of under ``1 / TRUST`` tokens count in whole tokens.
    """
    total = counts.sum(axis=(1, 2, 3))
    weight = np.maximum(1.0, total * TRUST)[:, None, None]
    uni = counts.sum(axis=(1, 2)) + 0.5 * weight[:, 0]
    uni /= uni.sum(axis=1, keepdims=True)
    lower = uni[:, None, :]
    for c in (counts.sum(axis=1), counts):
        w = weight if c.ndim == 3 else weight[..., None]
        seen, kinds = c.sum(axis=-1, keepdims=True), ((c > 0).sum(axis=-1, keepdims=True) + 1) * w
        p = (c + kinds * lower) / (seen + kinds)
        lower = p[:, None] if c.ndim == 3 else p
    return np.maximum(np.log(lower), FLOOR).astype(np.float32).reshape(2, -1)


def _window_scores(k: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w = _windows(k)
    comp = _composition(k, w)
    script = _script(comp)
    if len(k) < 3:
        return w, comp, script, np.full(len(comp), np.nan)  # compares as neither too low nor too high
    lp = model[script[w[2:]], _trigrams(k)]
    inside = np.bincount(w[2:], minlength=len(comp))
    return w, comp, script, np.bincount(w[2:], weights=lp, minlength=len(comp)) / np.maximum(inside, 1)


def _limits(enc: DataFrame, model: np.ndarray) -> np.ndarray:
    """Lower and upper limit of the mean log-probability for each script."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = np.zeros((2, BINS), dtype=np.int64)
        for pdf in batches:
            for kb in pdf["k"]:
                k = np.frombuffer(kb, dtype=np.uint8)
                if len(k) < 3:
                    continue
                _, comp, script, score = _window_scores(k, model)
                b = np.clip(((score - BIN_LOW) / (BIN_HIGH - BIN_LOW) * BINS).astype(int), 0, BINS - 1)
                ok = _prose_like(comp)
                for s in (0, 1):
                    hist[s] += np.bincount(b[ok & (script == s)], minlength=BINS)
        s, b = np.nonzero(hist)
        yield pd.DataFrame({"s": s, "b": b, "c": hist[s, b]})

    rows = enc.select("k").mapInPandas(run, "s int, b int, c long").groupBy("s", "b").agg(F.sum("c").alias("c")).toPandas()
    hist = np.zeros((2, BINS))
    hist[rows["s"], rows["b"]] = rows["c"]
    centre = BIN_LOW + (np.arange(BINS) + 0.5) * (BIN_HIGH - BIN_LOW) / BINS
    out = np.zeros((2, 2))
    for s in (0, 1):
        if not hist[s].sum():
            out[s] = (-np.inf, np.inf)
            continue
        cum = np.cumsum(hist[s]) / hist[s].sum()
        lo, mid, hi = (centre[np.searchsorted(cum, q)] for q in (0.1587, 0.5, 0.8413))  # one spread below, middle, one above
        spread = max((hi - lo) / 2, 0.02)
        out[s] = (mid - LOW_SPREADS * spread, mid + HIGH_SPREADS * spread)
    return out


def _abnormal(comp: np.ndarray, script: np.ndarray, score: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return (score < limits[script, 0]) | (score > limits[script, 1])


def scored(documents: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, abnormal, perplexity, windows)``: share of characters in abnormal windows, and the page's perplexity."""
    enc = written(encoded(documents, doc_col, text_col))
    model = _log_model(_counts(enc))
    limits = _limits(enc, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, kb, nb in zip(pdf["doc_id"], pdf["k"], pdf["n"]):
                k, n = np.frombuffer(kb, dtype=np.uint8), np.frombuffer(nb, dtype=np.int32)
                w, comp, script, score = _window_scores(k, model)
                chars = np.bincount(w, weights=n, minlength=len(comp))
                bad = _abnormal(comp, script, score, limits)
                rows.append((d, float(chars[bad].sum() / max(1.0, chars.sum())), float(np.exp(-np.average(score, weights=np.maximum(chars, 1)))), len(comp)))
            yield pd.DataFrame(rows, columns=["doc_id", "abnormal", "perplexity", "windows"]).astype({"doc_id": "int64"})

    return enc.mapInPandas(run, "doc_id long, abnormal double, perplexity double, windows int")


def found(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "documents")).where("abnormal > 0.5").select("doc_id")


QUERIES = {
    "p9_found": found,
    "p9_scores": lambda spark, d: scored(table(spark, d, "documents")).select("doc_id", F.round("abnormal", 4).alias("abnormal"), F.round("perplexity", 3).alias("perplexity"), "windows"),
}
