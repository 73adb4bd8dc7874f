"""Problem 4: personal information inside free text.

Bootstrapped contextual extraction. Mentions are first cut out by shape (digit groups,
capitalised sequences, street words, mail addresses). Some shapes are certain by themselves,
such as a number with a country code: these are the seeds. The words next to seeds are the
patterns they induce, and a graph of patterns and instances (a number's shape, a name's
words) is scored in rounds: a pattern is as good as the instances met in it, an instance as
good as the patterns it is met in. High-confidence patterns then discover the mentions no
shape can tell from order numbers or amounts, and words learned as given names discover
names in other places and spellings.

Seeds: mail addresses; phone numbers with a country code, trunk zero or extension; identity
numbers in a grouping only such numbers have; names whose words are the words of mail
addresses or that follow a title; addresses by street word or by postcode and place.

Defined results
---------------
* Spans are code points of the whole text; null and empty texts have none. Mentions do not
  overlap: addresses come first, then mail, identity numbers, phones, names.
* Repeated rows give the same mentions under their ids. Empty tables give an empty result.
* ``masked`` replaces each span by ``[TYPE]`` and leaves all other characters as they are.

Counts cover all rows. A pattern or word counts by its own support and confidence, however large the
table; what the tasks get of them are hashed tables of a fixed size (see ``Learned``).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table, written

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
ROUNDS = 3
#: Uses from which a pattern before a mention, another pattern and a word count.
LEFT_USES, PATTERN_USES, WORD_USES = 5, 2, 4
#: Sizes of the hashed tables: patterns, and bits for words under two hash functions.
PATTERNS, WORD_BITS = 1 << 20, 1 << 24
#: Confidence from which a pattern, and from which a word, discovers mentions.
PATTERN_LEAST, WORD_LEAST = 0.15, 0.6
NAME_PATTERN_LEAST, NAME_RIGHT_LEAST = 0.5, 0.75


def _class(test) -> str:
    """Letters below the Indic blocks that pass a test, as the inside of a character class."""
    out, start = [], None
    for c in range(0x41, 0x590):
        if test(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}" if c - 1 > start else chr(start))
            start = None
    return "".join(out)


_UP = _class(str.isupper)
_S = r"(?:[^\S\n]{1,3}|[^\S\n]*\n[^\S\n]*)"
_L = r"[^\W\d_]"
_CAP = rf"[{_UP}]{_L}+(?:[-'’]{_L}+)*"

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9_])?(?:%40|[^\S\n]?[@＠][^\S\n]?|[^\S\n]?[(\[{](?:at|AT|a|małpa|MAŁPA)[)\]}][^\S\n]?)"
    r"[A-Za-z0-9-]+(?:(?:\.|[^\S\n]?[(\[{](?:dot|kropka|DOT|KROPKA)[)\]}][^\S\n]?)[A-Za-z0-9-]+)*(?:\.|[^\S\n]?[(\[{](?:dot|kropka|DOT|KROPKA)[)\]}][^\S\n]?)[A-Za-z]{2,}")
_GAP = r"(?:[^\S\n]?[/()]{1,2}[^\S\n]?|[^\S\n]|[-.–‑])?"
PHONE = re.compile(rf"(?<![A-Za-z0-9_+/@#-])(?<!\d[.,])(?:\(?\+{_GAP}\d|\(?\d)(?:{_GAP}\d){{6,14}}(?![A-Za-z0-9_@])(?!-\d)(?!/\d)(?:,?\s?(?:ext\.?|wew\.?|x|Durchw\.?|poste)\s?\d{{1,5}})?")
_D = r"[0-9OIl]"
ID_NUMBER = re.compile(
    rf"(?<![A-Za-z0-9_/@.+-])(?:PL[ -]?\d{{3}}[ -]?\d{{3}}[ -]?\d{{2}}[ -]?\d{{2}}|PL[ -]?\d{{10}}|\d{{3}}[ -]\d{{3}}[ -]\d{{2}}[ -]\d{{2}}|\d{{3}}[ -]\d{{2}}[ -]\d{{4}}|\d{{2}} \d{{3}} \d{{3}} \d{{3}}"
    rf"|{_D}{{6}}[ -]{_D}{{5}}|{_D}{{9,12}}|[A-Z]{{2,4}}[ -]?{_D}{{5,9}}[A-Z]?|[A-Z][0-9OIl][A-Z]\d{{6}}[A-Z])(?![A-Za-z0-9_@])(?!-\d)(?!/\d)".replace(" ]", "  ]"))
_STRONG_ID = re.compile(r"PL.*|\d{3}[  -]\d{3}[  -]\d{2}[  -]\d{2}|\d{3}[  -]\d{2}[  -]\d{4}|\d{6}[  -]\d{5}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{3} ?\d{6}|[A-Z]{2} ?\d{7}|[A-Z]{2}\d{6}[A-Z]|[A-Z]\d[A-Z]\d{6}[A-Z]")
_TOWN = rf"[{_UP}]{_L}+(?:[- ]{_CAP}){{0,2}}(?![\w@])"
_PLACE = rf"(?:,?{_S}?\d{{2}}[-–]?\d{{3}}{_S}{_TOWN}|,{_S}{_TOWN})?"
_HOUSE = r"\d+(?:[a-zA-Z](?!\w)|[^\S\n][a-zA-Z](?![\w.]))?(?:/\d+[a-z]?)?"
_FLAT = rf"(?:,?{_S}(?:m|lok|mieszk|apt|app|W(?:hg|ng))\.{_S}?\d+[a-z]?)?"
#: Words for a street in Polish, English, German and French addresses.
ADDRESS = re.compile(
    rf"(?<![\w])(?:(?:[Uu]l|[Aa]l|[Oo]s|[Pp]l)\.|[Uu]lic[aęy]|[Aa]lej[ai]|[Aa]lei|[Oo]siedl[eu]|[Pp]lac(?:u)?){_S}?(?:\d+{_S})?(?:{_CAP}|[{_UP}]{_L}{{0,4}}\.)(?:{_S}(?:{_CAP}|[{_UP}]{_L}{{0,4}}\.|{_L}+)){{0,3}}?{_S}{_HOUSE}{_FLAT}{_PLACE}"
    rf"|(?<![\w])(?:Flat{_S}\d+\w?,{_S})?\d+[a-zA-Z]?{_S}(?:{_CAP}{_S}){{1,3}}(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave\.|Drive|Dr\.|Close|Court|Square|Way|Terrace|Row|Crescent|Gardens|Place)(?:,{_S}{_TOWN})?(?:,?{_S}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}})?"
    rf"|(?<![\w])(?:{_CAP}[ -])?{_L}*(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Gg]asse|[Pp]latz|[Aa]llee|[Uu]fer){_S}{_HOUSE}{_PLACE}"
    rf"|(?<![\w])\d+(?:{_S}(?:bis|ter))?,?{_S}(?:rue|av\.|avenue|bd\.?|boulevard|place|pl\.|chemin|ch\.|impasse|allée|quai|route){_S}(?:(?:de|du|des|la|le|l')[ ']?{_S}?)*{_CAP}(?:{_S}{_CAP})*{_PLACE}"
    rf"|(?<![\w]){_CAP}(?:{_S}{_CAP})?{_S}\d+[a-z]?(?:/\d+)?,{_S}\d{{2}}[-–]?\d{{3}}{_S}{_TOWN}")
_INITIAL = rf"[{_UP}]\."
SEQUENCE = re.compile(rf"(?<![\w@.+-])(?:{_CAP}|{_INITIAL}|Dr\.|Mr\.|Mrs\.|Ms\.|Prof\.)(?:{_S}?(?<=[.])(?:{_CAP}|{_INITIAL}|Dr\.)|{_S}(?:{_CAP}|{_INITIAL}|Dr\.)){{1,7}}(?![\w@])")
_HAN_NAME = re.compile(r"[一-鿿]{2,4}(?=[，,、])")
_TOKEN = re.compile(rf"{_CAP}|{_INITIAL}|{_L}+\.?")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
#: Titles that precede a name and are no part of it.
#: Greek articles, which stand before names only when two capitalised words follow, are seeds as titles are.
TITLES = frozenset("herr frau dr prof mr mrs ms miss mme mlle pan pani mgr inż κ κα sir".split())


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ł", "l").strip(".")


#: Endings that Polish names take on in other cases, in plain letters.
_ENDING = re.compile(r"(?<=...)(?:iego|iemu|ego|emu|iem|em|owi|im|ym|a|e|i|o|u|y)$")


def stem(word: str) -> str:
    return _ENDING.sub("", fold(word))


def _left(text: str, at: int) -> str:
    before = text[max(0, at - 40): at]
    before = before[before.rfind("\n\n") + 1:]
    words = _WORD.findall(before)
    if not words:
        return "^"
    last = words[-1]
    if _CJK.match(last[-1]):
        return last[-2:]
    return re.sub(r"\d+", "9", " ".join(words[-2:]).lower())


def _nearest(left: str) -> str:
    """The last word of a left pattern: what is looked at if both words are too rare."""
    return left.rsplit(" ", 1)[-1]


def _right(text: str, at: int) -> str:
    m = _WORD.search(text, at, at + 25)
    if not m:
        return ""
    word = m.group()
    if re.search(r"[.!?;:]\s|\n|[。！？]", text[at: m.start()]):
        return ""  # another sentence says nothing about this one
    return ("(" if "(" in text[at: m.start()] else "") + (word[:2] if _CJK.match(word[0]) else re.sub(r"\d+", "9", word.lower()))


def _shape(s: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", s)))


def _trim_email(m: re.Match) -> tuple[int, int]:
    """A sentence that goes on without a blank after the address is no part of it."""
    s = m.group()
    at = re.search(r"%40|[@＠)\]}]", s).end()
    domain = s[at:]
    if not domain.strip().isupper():
        cut = re.search(r"(?<=[a-z0-9])\.(?=[A-Z])", domain)
        if cut:
            return m.start(), m.start() + at + cut.start()
    return m.start(), m.end()


class Mention:
    __slots__ = ("start", "end", "kind", "strong", "left", "right", "instances")

    def __init__(self, start, end, kind, strong, left, right, instances):
        self.start, self.end, self.kind, self.strong, self.left, self.right, self.instances = start, end, kind, strong, left, right, instances


def _take(taken: bytearray, a: int, b: int) -> None:
    taken[a:b] = b"\x01" * (b - a)


def candidates(text: str) -> tuple[list[Mention], list[str]]:
    """Mentions by shape, and the words of mail addresses."""
    out: list[Mention] = []
    taken = bytearray(len(text))
    words: list[str] = []

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    has_digit = _DIGIT.search(text) is not None
    if has_digit:
        for m in ADDRESS.finditer(text):
            _take(taken, *m.span())
            out.append(Mention(*m.span(), "ADDRESS", True, "", "", ()))
    if "@" in text or "＠" in text or "%40" in text or "[ma" in text or "(at" in text or "[at" in text or "(a)" in text or "[MA" in text or "(AT" in text:
        for m in EMAIL.finditer(text):
            a, b = _trim_email(m)
            if free(a, b):
                _take(taken, a, b)
                out.append(Mention(a, b, "EMAIL", True, "", "", ()))
                words.extend(stem(w) for w in re.findall(r"[a-z]{3,}", re.split(r"%40|\s?[@＠(\[{]", m.group())[0].lower()))
    if has_digit:
        for m in PHONE.finditer(text):
            a, b = m.span()
            s = m.group()
            digits = sum(c.isdigit() for c in s)
            if digits < 7 or not free(a, b):
                continue
            while s.count(")") > s.count("(") and s[-1] == ")":
                s, b = s[:-1], b - 1
            strong = bool(re.match(r"\(?\+|00[1-9]", s)) and digits >= 10 or "(0" in s or bool(re.search(r"ext|wew", s))
            out.append(Mention(a, b, "PHONE", strong, _left(text, a), _right(text, b), (_shape(s),)))
        for m in ID_NUMBER.finditer(text):
            a, b = m.span()
            if free(a, b) and sum(c.isdigit() for c in m.group()) >= 5:
                strong = bool(_STRONG_ID.fullmatch(m.group()))
                out.append(Mention(a, b, "ID_NUMBER", strong, _left(text, a), _right(text, b), (_shape(m.group()),)))
    for m in SEQUENCE.finditer(text):
        toks = [(t.start(), t.end(), t.group()) for t in _TOKEN.finditer(text, m.start(), m.end())]
        titled = False
        while toks and (fold(toks[0][2]) in TITLES or toks[0][2] == "M." and len(toks) > 2 and not toks[2][2].endswith(".")):
            titled, toks = True, toks[1:]
        for i, t in enumerate(toks):  # a title inside the sequence starts the name anew
            if fold(t[2]) in TITLES and len(t[2]) > 2:
                titled, toks = True, toks[i + 1:]
                break
        while toks and (toks[-1][2].endswith(".") or len(toks[-1][2]) < 4 and re.match(r"\.\s?\d", text[toks[-1][1]: toks[-1][1] + 3])):
            toks = toks[:-1]  # initials end no name, and a word before a number and its stop is a label
        # name: two full words, or initials and a word, with initials between
        full = [i for i, t in enumerate(toks) if not t[2].endswith(".")]
        if not full or len(toks) < 2:
            continue
        first = full[-2] if len(full) > 1 else 0
        while first > 0 and toks[first - 1][2].endswith(".") and first - 1 not in full and len(full) == 1:
            first -= 1
        starts = [first]
        if len(full) > 1 and len(toks) - first > 2 and toks[first + 1][2].endswith("."):
            starts.append(first + 1)  # the first word may precede a name of initial and surname
        for first in starts:
            a, b = toks[first][0], toks[-1][1]
            if free(a, b):
                out.append(Mention(a, b, "NAME", titled and first == 0 or text[max(0, a - 2): a].strip() in ("Ο", "Η"), _left(text, a), _right(text, b), tuple(stem(t[2]) for t in toks[first:] if len(t[2]) > 2)))
    if _CJK.search(text):
        for m in _HAN_NAME.finditer(text):
            for n in (2, 3):  # the name is what the clause ends in
                a = m.end() - n
                if a >= m.start():
                    out.append(Mention(a, m.end(), "NAME", False, _left(text, a), _right(text, m.end()), ()))
        for m in re.finditer(r"(?<=联系)[一-鿿]{2,4}(?=[，,、])|(?<=联络)[一-鿿]{2,4}(?=[，,、])", text):
            out.append(Mention(m.start(), m.end(), "NAME", True, _left(text, m.start()), _right(text, m.end()), ()))
    return out, words


def _edges(rows: DataFrame) -> DataFrame:
    """``(kind, side, pattern, instance, n, seeds)``: how often a pattern met an instance, and as a seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            s: Counter = Counter()
            for text in pdf["_text"]:
                found, words = candidates(text)
                for w in set(words):
                    n[("NAME", "seed", "", w)] += 1
                for x in found:
                    for side, pattern in (("L", x.left), ("K", _nearest(x.left)), ("R", x.right)):
                        for instance in x.instances or ("*",) if pattern else ():
                            n[(x.kind, side, pattern, instance)] += 1
                            s[(x.kind, side, pattern, instance)] += x.strong
            yield pd.DataFrame([(*k, c, s[k]) for k, c in n.items()], columns=["kind", "side", "pattern", "instance", "n", "seeds"])

    return rows.mapInPandas(run, "kind string, side string, pattern string, instance string, n long, seeds long").groupBy(
        "kind", "side", "pattern", "instance").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))


def _bucket(kind: str, side: str, pattern: str) -> int:
    return zlib.crc32(f"{kind}|{side}|{pattern}".encode("utf-8", "surrogatepass")) % PATTERNS


def _bits(word: str) -> tuple[int, int]:
    return zlib.crc32(f"a|{word}".encode("utf-8", "surrogatepass")) % WORD_BITS, zlib.crc32(f"b|{word}".encode("utf-8", "surrogatepass")) % WORD_BITS


class Learned:
    """Confidence of patterns by bucket (of patterns that share one the most used counts), and words learned as given names."""

    def __init__(self, confidence: np.ndarray, words: np.ndarray):
        self.confidence, self.words = confidence, words
        self._memo: dict[str, bool] = {}

    @classmethod
    def nothing(cls) -> Learned:
        return cls(np.full(PATTERNS, np.nan, dtype=np.float16), np.zeros(WORD_BITS // 64, dtype=np.uint64))

    def conf(self, kind: str, side: str, pattern: str) -> float | None:
        c = float(self.confidence[_bucket(kind, side, pattern)])
        return None if c != c else c

    def left(self, kind: str, pattern: str) -> float:
        both = self.conf(kind, "L", pattern)
        return (self.conf(kind, "K", _nearest(pattern)) or 0.0) if both is None else both

    def knows(self, word: str) -> bool:
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            known = self._memo[word] = all(int(self.words[b >> 6]) >> (b & 63) & 1 for b in _bits(word))
        return known


def learned(rows: DataFrame, rounds: int = ROUNDS) -> Learned:
    """Patterns and words with enough support and confidence."""
    edges = written(_edges(rows))
    mail = edges.where("side = 'seed'").select("kind", "instance", F.lit(1.0).alias("score"))
    graph = written(edges.where("side <> 'seed'"))
    # a word starts from mail addresses or titles, a number's shape from its seeds
    scores = graph.groupBy("kind", "instance").agg((F.sum("seeds") / F.sum("n")).alias("share")).join(mail, ["kind", "instance"], "left").select(
        "kind", "instance", F.greatest(F.coalesce("score", F.lit(0.0)), "share").alias("score"))
    patterns = None
    for _ in range(rounds):
        # a number is as good as its own seed; of a name's two words one is enough
        met = graph.join(scores.select("kind", "instance", "score"), ["kind", "instance"]).withColumn("w", F.expr("CASE WHEN kind = 'NAME' THEN greatest(seeds, n * score) ELSE seeds END"))
        patterns = written(met.groupBy("kind", "side", "pattern").agg(F.expr("least(1.0, CASE WHEN kind = 'NAME' THEN 2 * sum(w) / (sum(n) + 8) ELSE sum(w) / (sum(n) + 1) END)").alias("conf"), F.sum("n").alias("n")))
        scores = written(graph.join(patterns.select("kind", "side", "pattern", "conf"), ["kind", "side", "pattern"]).groupBy("kind", "instance").agg(
            (F.sum(F.col("n") * F.col("conf")) / F.sum("n")).alias("s"), F.sum("n").alias("n")).join(mail, ["kind", "instance"], "left").select(
            "kind", "instance", F.greatest(F.coalesce(F.col("score") * 0.6, F.lit(0.0)), "s").alias("score"), "n"))
    keep = patterns.where(f"n >= CASE WHEN side = 'L' THEN {LEFT_USES} ELSE {PATTERN_USES} END")
    slots = keep.select(F.expr(f"cast(crc32(encode(concat_ws('|', kind, side, pattern), 'UTF-8')) % {PATTERNS} as int)").alias("slot"), "conf", "n").groupBy("slot").agg(F.max_by("conf", "n").alias("conf"))
    out = Learned.nothing()
    rows_ = slots.toPandas()
    out.confidence[rows_["slot"].to_numpy(dtype=np.int64)] = rows_["conf"].to_numpy(dtype=np.float16)
    names = scores.where(f"kind = 'NAME' and n >= {WORD_USES} and score >= {WORD_LEAST} and length(instance) > 2").select("instance")
    bits = names.select(F.explode(F.array(*[F.expr(f"cast(crc32(encode(concat('{x}|', instance), 'UTF-8')) % {WORD_BITS} as int)") for x in "ab"])).alias("b"))
    for r in bits.groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("m")).toLocalIterator():
        out.words[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    return out


def mentions(text: str, model: Learned) -> list[tuple[int, int, str]]:
    found, _ = candidates(text)
    chosen: list[tuple[float, Mention]] = []
    for x in found:
        left, right = model.left(x.kind, x.left), (model.conf(x.kind, "R", x.right) if x.right else None) or 0.0
        if x.kind == "NAME":
            known = any(map(model.knows, x.instances))
            # without case or a known word only the neighbourhood on both sides can tell
            ok = x.strong or (known and len(x.instances) > 1) or left >= NAME_PATTERN_LEAST or right >= NAME_RIGHT_LEAST if x.instances else x.strong
            # a longer span wins only if its first word is a name's word
            score = (3.0 if x.strong or x.instances and model.knows(x.instances[0]) else 2.0 + max(left, 0) / 2) if ok else 0.0
        elif x.kind in ("PHONE", "ID_NUMBER"):
            other = "ID_NUMBER" if x.kind == "PHONE" else "PHONE"
            rival = model.left(other, x.left)
            score = max(left, right * 0.9) + (1.0 if x.strong else 0.0)
            if left < rival and (not x.strong or x.kind == "PHONE"):
                score = 0.0
            if left < PATTERN_LEAST and right < 0.5 and not (x.strong and x.kind == "PHONE"):
                score = 0.0
        else:
            score = 3.0
        if score > 0:
            chosen.append((score, x))
    chosen.sort(key=lambda c: (c[1].kind in ("PHONE", "ID_NUMBER", "NAME"), c[1].kind == "NAME", -c[0], -(c[1].end - c[1].start)))
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for _, x in chosen:
        if taken.find(1, x.start, x.end) < 0:
            _take(taken, x.start, x.end)
            out.append((x.start, x.end, x.kind))
    out.extend(_small_names(text, model, taken))
    return sorted(out)


_SMALL = re.compile(rf"(?<![\w@.+-]){_L}{{3,}}(?={_S})")
_SMALL_REST = re.compile(rf"{_S}(?:{_L}\.{_S})?{_L}{{3,}}(?:-{_L}+)?(?![\w@])")


def _small_names(text: str, model: Learned, taken: bytearray) -> list[tuple[int, int, str]]:
    """Names written without capitals, where a known word stands in a name's place."""
    extra, done = [], 0
    for m in _SMALL.finditer(text):
        if m.start() < done or not model.knows(_stem_of[m.group()]):
            continue
        rest = _SMALL_REST.match(text, m.end())
        if rest and taken.find(1, m.start(), rest.end()) < 0 and model.left("NAME", _left(text, m.start())) >= NAME_PATTERN_LEAST:
            extra.append((m.start(), rest.end(), "NAME"))
            done = rest.end()
    return extra


class _Stems(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = stem(word)
        return out


_stem_of = _Stems()


def extracted(df: DataFrame, *, id_col: str = "id", text_col: str = "contents") -> DataFrame:
    """``(id, span_start, span_end, pii_type)`` of all mentions."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    model = learned(rows.select("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, a, b, k) for i, t in zip(pdf["id"], pdf["_text"]) for a, b, k in mentions(t, model)]
            yield pd.DataFrame(out, columns=["id", "span_start", "span_end", "pii_type"]).astype({"id": "int64", "span_start": "int32", "span_end": "int32"})

    return rows.mapInPandas(run, "id long, span_start int, span_end int, pii_type string")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, kind in sorted(spans, reverse=True):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


def masked(df: DataFrame, spans: DataFrame, *, id_col: str = "id", text_col: str = "contents") -> DataFrame:
    """``(id, contents)`` with typed placeholders in place of the mentions."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else mask(t, [(x["a"], x["b"], x["k"]) for x in s]) for t, s in zip(texts, found)], dtype=object)

    per = spans.groupBy("id").agg(F.collect_set(F.struct(F.col("span_start").alias("a"), F.col("span_end").alias("b"), F.col("pii_type").alias("k"))).alias("_s"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return rows.join(per, "id", "left").select("id", put("_text", "_s").alias("contents"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("hierarchy = 'parent' and is_search")


def found(spark: SparkSession, d: str) -> DataFrame:
    return extracted(_parents(spark, d).select("id", "contents"))


def placeholders(spark: SparkSession, d: str) -> DataFrame:
    rows = _parents(spark, d).select("id", "contents")
    return masked(rows, extracted(rows))


def against_reports(spark: SparkSession, d: str) -> DataFrame:
    """Kinds found in a file beside those its confidentiality reports name."""
    files = _parents(spark, d).select("id", "file_id")
    kinds = found(spark, d).join(files, "id").groupBy(F.col("file_id").alias("document_id"), "pii_type").count()
    listed = table(spark, d, "confidential_reports").select("document_id", F.explode_outer("types").alias("_t")).selectExpr(
        "document_id", "CASE WHEN lower(replace(_t, '-', '_')) like '%name%' THEN 'NAME' WHEN lower(replace(_t, '-', '_')) like 'contact%' THEN 'EMAIL' "
        "WHEN lower(replace(_t, '-', '_')) like 'id_n%' THEN 'ID_NUMBER' END AS pii_type").where("pii_type is not null").distinct().withColumn("reported", F.lit(True))
    reported = table(spark, d, "confidential_reports").select("document_id").distinct()
    return kinds.join(reported, "document_id", "left_semi").join(listed, ["document_id", "pii_type"], "left").groupBy("pii_type").agg(
        F.sum("count").alias("mentions"), F.count("*").alias("documents"), F.count("reported").alias("reported"))


QUERIES = {"p4_found": found, "p4_masked": placeholders, "p4_reports": against_reports}
