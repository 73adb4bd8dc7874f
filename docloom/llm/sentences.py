"""Problem 1: sentence boundaries across languages and scripts.

Hidden-event n-gram language model. Between words stands a hidden event, boundary or none,
and the model is one of words and events together:

* ``P(event | history, token)``: the token is the word before the gap with its stop, the history
  the word before that or, where the token opens a sentence, the boundary event itself; it
  backs off to the token alone and then to its shape;
* ``P(next word | event, ...)``: after a boundary the history is the event alone, otherwise the
  class of the next word depends on the token before it, backing off to the token's shape, and
  the word itself is drawn from words within sentences.

Forward-backward over a block gives the posterior of every gap, and gaps above one half become
boundaries. In scripts with marks a gap without a mark has no boundary in any certain place, so
its event is "none" and the lattice leaves it out; in scripts without marks (Thai, Lao, Khmer,
Burmese) the gaps are the blanks, in the same lattice with the same probabilities.

Training, on the table itself and without labels
------------------------------------------------
1. Certain places are counted: ends of blocks and strong marks before anything but a small letter
   are boundaries, words without a stop are within sentences. Expectation maximisation over the counts by token, in which the end
   of a block is an observation only a boundary can give, yields first probabilities. So a token
   with a stop that never ends a block (an abbreviation) gets none, without any list of them.
2. With these, forward-backward runs over all gaps of all texts; the expected counts by history,
   token and next word are the n-grams of the final model.

All counts are rates against priors of fixed weight, and tables of hashed tokens of a fixed size.

Structure comes first: a blank line ends a sentence, items of a list are sentences, nothing
inside paired quotes or brackets is a gap of the lattice, and in scripts without marks a
blank next to a number is none.

Defined results
---------------
* Null, empty and blank contents have no sentences. Spans are code points, end exclusive,
  without blanks at their ends, and cover all other characters.
* Repeated rows give the same spans under each id. Empty tables give an empty result.
* Very long texts are read whole, block by block; a block without blanks or sentence
  marks of an unspaced script is one unit.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table

#: Hashed table sizes: tokens a shape, histories a token, next words.
TOKENS, HISTORIES, WORDS = 1 << 14, 1 << 10, 1 << 18
THRESHOLD = 0.5

#: Marks that end sentences, by how far they decide alone; quotes and brackets in pairs.
_STRONG = "!?。！？؟।॥።፧։"
_WEAK = ".…"
_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "«": "»", "„": "”“", "“": "”", "‹": "›", "《": "》"}
_CLOSE = "".join(_OPEN.values())
_PAIRS = re.compile(f"[{re.escape(''.join(_OPEN) + _CLOSE)}\"]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"[^\S\n]*(?:[-•–*·‣]|\(?\d{1,3}[.)]|\(?[^\W\d_]\)|\(?[ivxIVX]{1,5}[.)])\s")
#: Scripts without blanks between words: those without sentence marks, and Han and kana.
_THAI, _UNSPACED = "฀-๿຀-໿ក-៿က-႟", "぀-ヿ㐀-䶿一-鿿"
_END = re.compile(rf"([{re.escape(_STRONG + _WEAK)}]+)([\"{re.escape(_CLOSE)}]*)")
_GREEK_END = re.compile(rf"([{re.escape(_STRONG + _WEAK)};;]+)([\"{re.escape(_CLOSE)}]*)")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
#: What a token ends at besides blanks.
_EDGE = frozenset("\"„“”«»()[]「」『』（）")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
_NEXT = re.compile(r"\S")


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines, without blanks at their ends."""
    at = 0
    for m in _BLANK_LINE.finditer(text):
        yield from _trimmed(text, at, m.start())
        at = m.end()
    yield from _trimmed(text, at, len(text))


def _trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        yield a, b


def _items(text: str, a: int, b: int) -> list[tuple[int, int]] | None:
    """Items of a block that is a list: it begins with a marker and has another one."""
    if "\n" not in text[a:b] or not _ITEM.match(text, a):
        return None
    starts, at = [a], a
    while (at := text.find("\n", at, b)) >= 0:
        at += 1
        if _ITEM.match(text, at):
            starts.append(at)
    if len(starts) < 2:
        return None
    return [s for i, s0 in enumerate(starts) for s in _trimmed(text, s0, starts[i + 1] if i + 1 < len(starts) else b)]


def _enclosed(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets, as (open, after close)."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _PAIRS.finditer(text, a, b):
        c, at = m.group(), m.start()
        hit = next((i for i in range(len(stack) - 1, -1, -1) if c in stack[i][1] and (c != '"' or stack[i][0] == '"')), None)
        if hit is not None:
            start = stack[hit][2]
            del stack[hit:]
            while out and out[-1][0] > start:  # pairs inside this one
                out.pop()
            out.append((start, at + 1))
        elif c in _OPEN:
            stack.append((c, _OPEN[c], at))
        elif c == '"':
            stack.append((c, '"', at))
    return out


class Gap:
    """A place where a sentence may end: after ``at``; the token before it, what precedes that, and the next word.

    ``first`` tells that no word stands between the token and the gap before.
    """

    __slots__ = ("at", "left", "before", "word", "right", "first")

    def __init__(self, at: int, left: str, before: str, word: str, right: str, first: bool):
        self.at, self.left, self.before, self.word, self.right, self.first = at, left, before, word, right, first


_FIRST_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _right_class(text: str, at: int, b: int) -> str:
    """Class of the next character: upper, lower, digit, caseless letter, opening, end, other."""
    m = _NEXT.search(text, at, b)
    if not m:
        return "$"
    c = m.group()
    if c in _OPEN or c == '"':
        inner = text[m.end(): m.end() + 1]
        return "o" if not inner.islower() else "q"
    if c in "¿¡":
        return "U"
    if c.isalpha():
        return "U" if c.isupper() or c.istitle() else "l" if c.islower() else "c"
    return "d" if c.isdigit() else "x"


def _token(text: str, a: int, at: int) -> str:
    """The token that ends at a stop, up to the blank, quote or bracket before it."""
    start = at
    while start > a and not text[start - 1].isspace() and text[start - 1] not in _EDGE:
        start -= 1
    return text[start:at]


_SITE = re.compile(r"\w{3,}[.-]\w{2,}")


def _left_type(token: str) -> str:
    """Type of the token before a stop: the word itself, or its shape for numbers, initials and addresses."""
    if not token:
        return "<C>"  # a closing quote or bracket
    if "@" in token or "/" in token or _SITE.search(token):
        return "<URL>"
    if token[-1].isdigit():
        digits = sum(c.isdigit() for c in token)
        return f"<N{min(digits, 4)}{'.' if '.' in token or ',' in token else ''}>"
    if len(token) == 1 and token.isupper():
        return "<I>"
    return token.lower()


def _before(text: str, a: int, at: int) -> str:
    """The word before a token, as history: itself, or ``#`` for numbers; empty at the start."""
    end = at
    while end > a and text[end - 1].isspace():
        end -= 1
    word = _token(text, a, end) or text[max(a, end - 1): end]
    return "#" if word[-1:].isdigit() else word.lower()


_SPECIAL = {"<S>": 0, "<E>": 1, "<QS>": 2, "<QM>": 3, "<C>": 4, "<URL>": 5, "<N1>": 6, "<N2>": 7, "<N3>": 8, "<N4>": 8, "<I>": 10, "<T>": 16}
SHAPES, CASELESS = 17, 17
CLASSES = "Uldcoqx$"
_PLACE = {c: i for i, c in enumerate(CLASSES)}


def _shape(left: str) -> int:
    if left[0] == "<" and left[-1] == ">":
        return _SPECIAL.get(left, 9)
    if "." in left:
        return 15
    n = len(left)
    return 11 if n <= 2 else 12 if n == 3 else 13 if n <= 5 else 14


def _key(left: str, cased: bool) -> int:
    return (_shape(left) + (0 if cased else CASELESS)) * TOKENS + _bucket(left, TOKENS)


_LETTER = re.compile(r"[^\W\d_]")


def _cased(text: str, a: int, b: int) -> bool:
    """Whether a block's first letter belongs to a script with capitals."""
    m = _LETTER.search(text, a, b)
    return m is None or m.group().islower() or m.group().isupper()


def _quoted(text: str, a: int, start: int) -> str:
    """Whether a quotation or bracket opens its sentence or stands within it."""
    j = start - 1
    while j >= a and text[j].isspace():
        j -= 1
    return "<QS>" if j < a or text[j] in _STRONG + _WEAK or text[j] in _CLOSE + '"' and j > a and text[j - 1] in _STRONG + _WEAK else "<QM>"


def gaps(text: str, a: int, b: int) -> list[Gap]:
    block_greek = _GREEK.search(text, a, b) is not None
    inner = _enclosed(text, a, b)
    out: list[Gap] = []
    k = 0
    last = a
    for m in (_GREEK_END if block_greek else _END).finditer(text, a, b):
        at, marks = m.end(), m.group(1)
        if at >= b:
            break
        while k < len(inner) and inner[k][1] <= m.start():
            k += 1
        quoted = ""
        if k < len(inner) and inner[k][0] < m.start() < inner[k][1]:
            if at < inner[k][1]:
                continue  # inside
            at = inner[k][1]
            quoted = _quoted(text, a, inner[k][0])
            # marks that follow the closing one belong to it as well
            while at < b and text[at] in _STRONG + _WEAK:
                at, quoted = at + 1, ""
            if at >= b:
                break
        nxt = text[at]
        spaced = nxt.isspace()
        if not spaced:
            before = text[m.start() - 1] if m.start() > a else ""
            free = nxt in _OPEN or nxt.isalpha() and (nxt.isupper() and (before.islower() or quoted) or not nxt.isascii() and not nxt.islower() and not nxt.isupper()) or nxt.isdigit() and marks[-1] in "。！？।።"
            if not free or marks[-1] in "." and not (nxt.isupper() and before.islower() and _single_stop(text, a, m.start())):
                if not (free and marks[-1] in "。！？।።!?…" or quoted and free):
                    continue
        start = m.start()
        if quoted:
            left, start = quoted, inner[k][0]
        elif marks == ".":
            token = _token(text, a, m.start())
            left, start = _left_type(token), m.start() - len(token)
        elif marks[-1] in "…." and not any(c in _STRONG for c in marks):
            left = "<E>"
        else:
            left = "<S>"
        right = _right_class(text, at, b)
        word = _FIRST_WORD.search(text, at, b) if right == "U" else None
        while last < start and text[last].isspace():
            last += 1
        out.append(Gap(at, left, _before(text, a, start), word.group() if word else "", right, start <= last))
        last = at
    return out


def _single_stop(text: str, a: int, at: int) -> bool:
    """Whether the token before a stop without a blank after it is a plain word of some length."""
    token = _token(text, a, at)
    return len(token) > 2 and token.isalpha()


_MARKLESS = re.compile(f"[{_THAI}]")
_BLANK = re.compile(r"[^\S\n]+")


def _blanks(text: str, a: int, b: int) -> list[Gap]:
    """Blanks that are not next to a number: the gaps of a script without marks."""
    out = []
    for m in _BLANK.finditer(text, a, b):
        p, q = m.start() - 1, m.end()
        if not (text[p].isdigit() or text[q].isdigit() or text[p] in "(-–/" or text[q] in ")-–/ๆฯ"):
            out.append(Gap(m.start(), "<T>", "", text[q: q + 2], "c", False))
    return out


def lattice(text: str, a: int, b: int) -> list[Gap]:
    """All gaps of a block that can hold a boundary, in order."""
    found = gaps(text, a, b)
    if _MARKLESS.search(text, a, b):
        at = {g.at: g for g in [*found, *_blanks(text, a, b)]}
        found = [at[x] for x in sorted(at)]
    return found


def _unbroken(text: str, a: int, b: int) -> bool:
    part = text[a:b]
    return not any(c.isspace() for c in part) and not re.search(f"[{_UNSPACED}{_THAI}]", part)


# --- training -----------------------------------------------------------------

#: Weights of the priors, in tokens: of a token's shape, of the token for a history, of a next word's class and of the word.
W_SHAPE, W_PAIR, W_TOKEN, W_CLASS, W_WORD = 15.0, 4.0, 12.0, 12.0, 2.0
#: The same in expected ends of blocks, for the first guess.
W_END = 1.0
#: Word types are plain words or abbreviations. A plain word stands before a stop in ``PLAIN_STOP`` of its uses
#: and always ends a sentence there, an abbreviation in ``SHORT_STOP`` and ends one in ``SHORT_END`` of these.
PLAIN_STOP, SHORT_STOP, SHORT_END, PLAIN_END = 0.08, 0.9, 0.3, 0.998
#: However often a type occurs, its evidence counts as so many uses before a stop, and as so many in all.
W_TYPE, W_BARE = 60.0, 3.0
ROUNDS = 12
_N = 2 * SHAPES * TOKENS
_SHAPE_OF = np.repeat(np.arange(2 * SHAPES), TOKENS)
#: At most this share of blocks' ends stands after a stop that is no boundary.
SLIP = 1e-3


def _final_token(text: str, a: int, b: int) -> tuple[str, str] | None:
    """History and type of the token a block ends with, if it ends as a sentence does."""
    if text[b - 1] == "." and (b - a < 2 or text[b - 2] not in ".…"):
        token = _token(text, a, b - 1)
        return _before(text, a, b - 1 - len(token)), _left_type(token)
    if text[b - 1] in _WEAK:
        return "", "<E>"
    if text[b - 1] in _STRONG:
        return "", "<S>"
    if b - a > 2 and text[b - 1] in _CLOSE + '"' and text[b - 2] in _STRONG + _WEAK:
        inner = _enclosed(text, a, b)
        if inner and inner[-1][1] == b:
            return "", _quoted(text, a, inner[-1][0])
    if _MARKLESS.search(text, a, b) and not text[b - 1].isdigit():
        return "", "<T>"
    return None


def _has_history(left: str) -> bool:
    """Types whose meaning hangs on the word before: numbers, initials and short words."""
    return left[1] in "NI" if left[0] == "<" else len(left) <= 3


def _certain(text: str, inner: Counter, bare: Counter, pairs: Counter, *_: Counter) -> None:
    for a, b in blocks(text):
        if _items(text, a, b) is not None or _unbroken(text, a, b):
            continue
        cased = _cased(text, a, b)
        final = _final_token(text, a, b)
        if final:
            inner[(_key(final[1], cased), "$")] += 1
            if _has_history(final[1]):
                pairs[(_history_key(*final, cased), "$")] += 1
        for i, g in enumerate(lattice(text, a, b)):
            inner[(_key(g.left, cased), g.right)] += 1
            if _has_history(g.left):
                pairs[(_pair_key(g, cased, g.first and i == 0), g.right)] += 1
        bare.update(m for m in _PLAIN_WORD.findall(text, a, b))


#: Words without a stop, and capitalised words that follow a word without one.
_PLAIN_WORD = re.compile(r"(?<![\w.])[^\W\d_]{1,12}(?=[\s,;:])")
_WITHIN = re.compile(r"(?<=[^\W\d_]\s)[^\W\d_]+(?:['’-][^\W\d_]+)*")
_COUNTS = "t string, k long, c int, n double"


def _rows(table: str, counts) -> list[tuple[str, int, int, float]]:
    return [(table, int(k), int(c), float(n)) for (k, c), n in counts.items() if n > 0]


def _first_rows(inner: Counter, bare: Counter, pairs: Counter, *_: Counter) -> list[tuple[str, int, int, float]]:
    out = _rows("token", {(k, _PLACE[c]): n for (k, c), n in inner.items()}) + _rows("pair", {(k, _PLACE[c]): n for (k, c), n in pairs.items()})
    plain: Counter = Counter()
    for w, n in bare.items():
        plain[(_key(w.lower(), w[0].islower() or w[0].isupper()), 0)] += n
    out += _rows("bare", plain)
    return out


class Model:
    """Probabilities of events and next words, in tables of fixed size.

    ``event`` is the chance of a boundary by token, ``after`` that of the next word's class within a
    sentence by token, ``start`` that after a boundary for caseless and cased scripts, ``word`` the log-odds
    by which the next word moves a gap, ``pair`` the chance of a boundary by history and token.
    """

    def __init__(self, event: np.ndarray, after: np.ndarray, start: np.ndarray, word: np.ndarray, pair: dict[int, float]):
        self.event, self.after, self.start, self.word, self.pair = event, after, start, word, pair

    def score(self, g: Gap, cased: bool, opens: bool) -> float:
        """Log-odds of a boundary at a gap whose token opens a sentence, or not."""
        k = _key(g.left, cased)
        p = float(self.event[k])
        if _has_history(g.left):
            p = self.pair.get(_pair_key(g, cased, opens), p)
        p = min(max(p, 1e-6), 1 - 1e-6)
        out = math.log(p / (1 - p))
        if g.left != "<T>":
            j = _PLACE[g.right]
            out += math.log(float(self.start[int(cased), j]) / float(self.after[k, j]))
        if g.word:
            out += float(self.word[_bucket(g.word, WORDS)])
        return out


def _history_key(before: str, left: str, cased: bool) -> int:
    """A token's number and, below it, a bucket of its history; numbers of one to three digits go together."""
    left = "<N1>" if left in ("<N2>", "<N3>") else left
    return _key(left, cased) * HISTORIES + _bucket(before, HISTORIES)


def _pair_key(g: Gap, cased: bool, opens: bool) -> int:
    return _history_key("<B>" if opens else g.before, g.left, cased)


def untrained() -> Model:
    """The priors alone, as an empty table gives them."""
    return _estimated(pd.DataFrame([], columns=["t", "k", "c", "n"]))


def _estimated(rows: pd.DataFrame) -> Model:
    """First model from certain places: expectation maximisation over the table of tokens and next classes."""
    n, bare = np.zeros((_N, len(CLASSES))), np.zeros(_N)
    pairs = pd.DataFrame([], columns=["k", "c", "n"])
    for t, x in rows.groupby("t"):
        k, c, v = x["k"].to_numpy(), x["c"].to_numpy(), x["n"].to_numpy(dtype=float)
        if t == "token":
            np.add.at(n, (k, c), v)
        elif t == "bare":
            np.add.at(bare, k, v)
        else:
            pairs = x
    event, after, start, ends = _maximised(n, bare)
    # the next word itself has no say yet: which words go on after a stop is only known from expected counts
    return Model(event.astype(np.float32), after.astype(np.float32), start, np.zeros(WORDS, dtype=np.float32), _paired(pairs, event, after, start, ends))


def _paired(rows: pd.DataFrame, event: np.ndarray, after: np.ndarray, start: np.ndarray, ends: float) -> dict[int, float]:
    """Chance of a boundary by history and token, against the token's own as a prior."""
    if not len(rows):
        return {}
    keys, at = np.unique(rows["k"].to_numpy(), return_inverse=True)
    n = np.zeros((len(keys), len(CLASSES)))
    np.add.at(n, (at, rows["c"].to_numpy()), rows["n"].to_numpy(dtype=float))
    token = keys // HISTORIES
    total, prior, begin = n.sum(axis=1), event[token], start[(_SHAPE_OF[token] < CASELESS).astype(int)]
    p, follow = _by_ends(n, total, prior, after[token], W_END, W_PAIR, ends)
    for _ in range(ROUNDS):
        post = _posterior(p, follow, begin, ends)
        rest = ((1 - post) * n)[:, :-1]
        p = ((post * n).sum(axis=1) + W_PAIR * prior) / (total + W_PAIR)
        follow = (rest + W_PAIR * after[token]) / (rest.sum(axis=1, keepdims=True) + W_PAIR)
    return dict(zip(keys.tolist(), p.tolist()))


def _by_ends(n: np.ndarray, total: np.ndarray, prior: np.ndarray, within: np.ndarray, weight, class_weight: float, ends: float) -> tuple[np.ndarray, np.ndarray]:
    """First guess: as many boundaries as the ends of blocks tell of the ends expected, and next classes as if there were none."""
    inner = n[:, :-1]
    return np.minimum(1 - 1e-6, (n[:, -1] + weight * prior) / (total * ends + weight)), (inner + class_weight * within) / (inner.sum(axis=1, keepdims=True) + class_weight)


def _posterior(p: np.ndarray, after: np.ndarray, start: np.ndarray, ends: float) -> np.ndarray:
    """Chance of a boundary for each next class, the end of a block among them."""
    rows = len(p)
    b = np.concatenate([start * (1 - ends), np.full((rows, 1), ends)], axis=1) * p[:, None]
    w = np.concatenate([after * (1 - SLIP), np.full((rows, 1), SLIP)], axis=1) * (1 - p)[:, None]
    return b / (b + w)


def _prior_events() -> np.ndarray:
    """Chance of a boundary by shape before anything is counted."""
    p = np.full(SHAPES, 0.9)
    p[[1, 2, 3, 6, 7, 9, 10, 11, 12, 13, 14, 15]] = [0.5, 0.8, 0.3, 0.4, 0.5, 0.7, 0.1, 0.2, 0.3, 0.3, 0.3, 0.2]
    return np.tile(p, 2)


#: Chance that a type of a word's shape is a plain word, by length; the rest are no words.
_PLAIN_PRIOR = np.full(SHAPES, 0.5)
_PLAIN_PRIOR[[11, 12, 13, 14, 15]] = [0.2, 0.6, 0.9, 0.99, 0.1]


#: Priors of next classes: within a sentence mostly small letters, after a boundary capitals; caseless scripts first.
_WITHIN_PRIOR = np.array([[.02, .02, .2, .65, .05, .03, .03], [.25, .45, .15, .05, .05, .03, .02]])
_START_PRIOR = np.array([[.02, .02, .08, .8, .06, .01, .01], [.8, .02, .08, .02, .06, .01, .01]])
W_POOL = 20.0


def _maximised(n: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Chance of a boundary and next classes by token, next classes after a boundary, share of boundaries at blocks' ends."""
    cased = (_SHAPE_OF < CASELESS).astype(int)
    word_like = np.isin(_SHAPE_OF % SHAPES, (11, 12, 13, 14, 15))
    group = (np.arange(2 * SHAPES) < CASELESS).astype(int)
    shape, within, ends = _prior_events(), _WITHIN_PRIOR[group], 0.15
    start = W_POOL * _START_PRIOR
    seen = np.flatnonzero(n.sum(axis=1) > 0)
    n, total, s, g = n[seen], n[seen].sum(axis=1), _SHAPE_OF[seen], cased[seen]
    # strong marks decide by themselves unless a small letter follows: they tell what opens sentences
    sure = np.flatnonzero(s % SHAPES == 0)[:, None], np.flatnonzero(~np.isin(list(CLASSES), ["l", "q"]))[None, :]
    begun = np.zeros((len(seen), len(CLASSES)))
    begun[sure] = n[sure]
    np.add.at(start, g, begun[:, :-1])
    start /= start.sum(axis=1, keepdims=True)
    words = word_like[seen]
    uses = total + bare[seen]
    stop = (total * math.log(PLAIN_STOP / SHORT_STOP) + bare[seen] * math.log((1 - PLAIN_STOP) / (1 - SHORT_STOP))) * W_BARE / (uses + W_BARE)
    odds = np.log(_PLAIN_PRIOR[s % SHAPES] / (1 - _PLAIN_PRIOR[s % SHAPES])) + stop
    p, _ = _by_ends(n, total, shape[s], within[s], 2 * W_END, W_CLASS, ends)
    after, plain = within[s], np.where(words, 1 / (1 + np.exp(-odds)), 0.0)
    for _ in range(ROUNDS):
        post = _posterior(plain * PLAIN_END + (1 - plain) * p, after, start[g], ends)
        post[sure] = 1.0
        hits, rest, begun = (post * n).sum(axis=1), ((1 - post) * n)[:, :-1], (post * n)[:, :-1]
        p = (hits + W_SHAPE * shape[s]) / (total + W_SHAPE)
        pooled, won, every, began = np.zeros_like(within), np.zeros(2 * SHAPES), np.zeros(2 * SHAPES), np.zeros_like(start)
        np.add.at(pooled, s, rest)
        np.add.at(won, s, hits * (1 - plain))
        np.add.at(every, s, total * (1 - plain))
        np.add.at(began, g, begun)
        within = (pooled + W_POOL * _WITHIN_PRIOR[group]) / (pooled.sum(axis=1, keepdims=True) + W_POOL)
        after = (rest + W_CLASS * within[s]) / (rest.sum(axis=1, keepdims=True) + W_CLASS)
        shape = (won + W_POOL * _prior_events()) / (every + W_POOL)
        start = (began + W_POOL * _START_PRIOR) / (began.sum(axis=1, keepdims=True) + W_POOL)
        ends = min(0.5, max(0.02, float((post * n)[:, -1].sum() + 3) / float(hits.sum() + W_POOL)))
        # what follows a type's stops tells its kind: an abbreviation has followers of its own, but ends few blocks
        opens = np.concatenate([start[g] * (1 - ends), np.full((len(seen), 1), ends)], axis=1)
        inner = n[:, :-1]
        own = (inner + W_CLASS * within[s]) / (inner.sum(axis=1, keepdims=True) + W_CLASS)
        goes_on = np.concatenate([own * (1 - SLIP), np.full((len(seen), 1), SLIP)], axis=1)
        follows = (n * np.log(opens / (SHORT_END * opens + (1 - SHORT_END) * goes_on))).sum(axis=1) * W_TYPE / (total + W_TYPE)
        plain = np.where(words, 1 / (1 + np.exp(-np.clip(odds + follows, -40, 40))), 0.0)
    event, follow = shape[_SHAPE_OF], within[_SHAPE_OF]
    # types never seen with a stop are told by their shape and by their uses without one
    odds = np.log(_PLAIN_PRIOR / (1 - _PLAIN_PRIOR))[_SHAPE_OF % SHAPES] + bare * math.log((1 - PLAIN_STOP) / (1 - SHORT_STOP)) * W_BARE / (bare + W_BARE)
    unseen = 1 / (1 + np.exp(-odds))
    event = np.where(word_like, unseen * PLAIN_END + (1 - unseen) * event, event)
    event[seen], follow[seen] = plain * PLAIN_END + (1 - plain) * p, after
    return event, follow, start, ends


def _word_odds(word: np.ndarray) -> np.ndarray:
    """How much more often a capitalised word follows a boundary than stands within a sentence, as log-odds."""
    total = np.maximum(word.sum(axis=0), 1.0)
    least = total.min()
    inside, opening = (word / total * least).T
    q = (opening + W_WORD / 2) / (opening + inside + W_WORD)
    return np.log(q / (1 - q)).astype(np.float32)


def _aggregated(rows: DataFrame, count, summed) -> pd.DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = tuple(Counter() for _ in range(4))
        for pdf in batches:
            for text in pdf["_text"]:
                count(text, *counters)
        yield pd.DataFrame(summed(*counters), columns=["t", "k", "c", "n"])

    return rows.mapInPandas(run, _COUNTS).groupBy("t", "k", "c").agg(F.sum("n").alias("n")).toPandas()


def trained(rows: DataFrame) -> Model:
    """The model of a table's texts: one pass over certain places, one of forward-backward over all gaps."""
    first = _estimated(_aggregated(rows, _certain, _first_rows))

    def expected(text: str, pairs: Counter, tokens: Counter, within: Counter, words: Counter) -> None:
        for a, b in blocks(text):
            if _items(text, a, b) is not None or _unbroken(text, a, b):
                continue
            cased = _cased(text, a, b)
            found = lattice(text, a, b)
            for g, (p, opens) in zip(found, posteriors(found, first, cased)):
                k = _key(g.left, cased)
                tokens[(k, 1)] += p
                tokens[(k, 0)] += 1 - p
                within[(k, _PLACE[g.right])] += 1 - p
                if _has_history(g.left):
                    h = _pair_key(g, cased, opens)
                    pairs[(h, 1)] += p
                    pairs[(h, 0)] += 1 - p
                if g.word:
                    w = _bucket(g.word, WORDS)
                    words[(w, 1)] += p
                    words[(w, 0)] += 1 - p
            right = _right_class(text, a, b)
            word = _FIRST_WORD.search(text, a, b) if right == "U" else None
            if word:
                words[(_bucket(word.group(), WORDS), 1)] += 1
            for w in _WITHIN.findall(text, a, b):
                if w[0].isupper():
                    words[(_bucket(w, WORDS), 0)] += 1

    return _final(_aggregated(rows, expected, lambda p, t, a, w: _rows("pair", p) + _rows("token", t) + _rows("within", a) + _rows("word", w)), first)


def _final(rows: pd.DataFrame, first: Model) -> Model:
    """n-grams from expected counts, each against the shorter one as a prior of fixed weight."""
    tables = {"token": np.zeros((_N, 2)), "within": np.zeros((_N, len(CLASSES))), "word": np.zeros((WORDS, 2))}
    pair = dict(first.pair)
    for t, x in rows.groupby("t"):
        if t == "pair":
            both = x.pivot_table(index="k", columns="c", values="n", aggfunc="sum", fill_value=0.0).reindex(columns=[0, 1], fill_value=0.0)
            keys = both.index.to_numpy()
            prior = np.array([first.pair.get(k, first.event[k // HISTORIES]) for k in keys.tolist()])
            p = (both[1].to_numpy() + W_TOKEN * prior) / (both.sum(axis=1).to_numpy() + W_TOKEN)
            pair.update(zip(keys.tolist(), p.tolist()))
        else:
            np.add.at(tables[t], (x["k"].to_numpy(), x["c"].to_numpy()), x["n"].to_numpy(dtype=float))
    none, hits = tables["token"].T
    event = (hits + W_SHAPE * first.event) / (hits + none + W_SHAPE)
    rest = tables["within"][:, :-1]
    after = (rest + W_CLASS * first.after) / (rest.sum(axis=1, keepdims=True) + W_CLASS)
    return Model(event.astype(np.float32), after.astype(np.float32), first.start, _word_odds(tables["word"]), pair)


# --- decoding -----------------------------------------------------------------

def posteriors(found: list[Gap], model: Model, cased: bool) -> list[tuple[float, bool]]:
    """Forward-backward over the gaps of a block: the chance of a boundary, and whether the token more likely opens a sentence.

    The state is the last event. It enters a gap's score where the token is the first after the gap
    before it: then the history is the boundary if there was one.
    """
    n = len(found)
    if not n:
        return []
    # log-odds of a boundary after no boundary, and after one
    odds = [(s := model.score(g, cased, g.first and i == 0), model.score(g, cased, True) if g.first and i else s) for i, g in enumerate(found)]

    def add(x: float, y: float) -> float:
        m = max(x, y)
        return m + math.log1p(math.exp(min(x, y) - m))

    def logs(x: float) -> tuple[float, float]:
        none = -add(0.0, x)
        return none, none + x

    step = [(logs(x), logs(y)) for x, y in odds]
    f = [step[0][0]]
    for i in range(1, n):
        (n0, b0), (n1, b1) = step[i]
        f.append((add(f[-1][0] + n0, f[-1][1] + n1), add(f[-1][0] + b0, f[-1][1] + b1)))
    back = [(0.0, 0.0)] * n
    for i in range(n - 2, -1, -1):
        (n0, b0), (n1, b1) = step[i + 1]
        back[i] = (add(n0 + back[i + 1][0], b0 + back[i + 1][1]), add(n1 + back[i + 1][0], b1 + back[i + 1][1]))
    p = [1 / (1 + math.exp(max(-50.0, min(50.0, (f[i][0] + back[i][0]) - (f[i][1] + back[i][1]))))) for i in range(n)]
    return [(x, g.first and (i == 0 or p[i - 1] > 0.5)) for i, (x, g) in enumerate(zip(p, found))]


def sentences(text: str, model: Model, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in blocks(text):
        items = _items(text, a, b)
        if items is not None:
            out.extend(items)
            continue
        if _unbroken(text, a, b):
            out.append((a, b))
            continue
        found = lattice(text, a, b)
        at = a
        for g, (p, _) in zip(found, posteriors(found, model, _cased(text, a, b))):
            if p > threshold:
                out.extend(_trimmed(text, at, g.at))
                at = g.at
        out.extend(_trimmed(text, at, b))
    return out


def split(df: DataFrame, *, id_col: str = "id", text_col: str = "contents") -> DataFrame:
    """``(id, sent_start, sent_end)``, one row a sentence."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    model = trained(rows.select("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, a, b) for i, t in zip(pdf["id"], pdf["_text"]) for a, b in sentences(t, model)]
            yield pd.DataFrame(out, columns=["id", "sent_start", "sent_end"]).astype({"id": "int64", "sent_start": "int32", "sent_end": "int32"})

    return rows.mapInPandas(run, "id long, sent_start int, sent_end int")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("hierarchy = 'parent' and type = 'text' and is_search").select("id", "contents")


def found(spark: SparkSession, d: str) -> DataFrame:
    return split(_parents(spark, d))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Number of sentences and their mean length for each text."""
    return found(spark, d).groupBy("id").agg(F.count("*").alias("sentences"), F.round(F.avg(F.expr("sent_end - sent_start")), 3).alias("mean_length"))


QUERIES = {"p1_found": found, "p1_texts": texts}
