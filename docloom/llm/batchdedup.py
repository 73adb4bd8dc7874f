"""Problem 3: deduplicating new batches against all history.

Prefix-tree hash forest. Every distinct text has a signature of min-hash values over token
shingles; slices of it are its keys in as many trees. A ``Forest`` keeps them in a folder as
runs of files sorted by (tree, key, id), with the first and last key of every file. A new batch
signs only itself: its keys are routed to the files that hold the range of their prefix, and each
file is searched there by bisection, without moving the history. Ranges are searched deepest first and
the prefix is widened until the chance to meet a text at the limit reaches ``RECALL``. Hits are
verified on the whole texts. Accepted texts are added as a run of their own, and runs are merged
when there are more than ``MAX_RUNS``; no older text is read or signed again.

What an upload repeats depends on which earlier uploads were accepted. That is settled in
rounds over a table of uploads: an upload is decided as soon as all earlier uploads that
could matter to it are. Once few are open they are settled one by one in a single task.

Defined results
---------------
* Wording: tokens ignoring case, accents, blanks, line breaks and the order of paragraphs.
  For scripts with blanks they are words, compared as multisets; for scripts without, the
  characters both have in the same order, paragraphs being moved to where they fit. The agreement is the count over the longer text.
* Uploads without text are never ``near``; null contents are never ``bytes``; a null
  ``file_id`` is never ``id``. Rows without ``seq`` are left out, as they have no turn.
* Of the stored matches met in the first step that has one the most similar comes out, then the
  smallest ``file_id``; of accepted uploads met, the most similar, then the earliest.
* Very long texts are used whole. Empty tables give an empty result.

A range may hold any number of texts (a family of near copies). It is taken in steps of ``RANGE``, eight
times as many in each next step: of stored texts only by texts still without a stored match, of
uploads only by texts that agree with none that is sure to be accepted. So a family costs its
size, not its square, in a number of steps that grows with the logarithm of its size. No
document, signature or link is collected to the driver; it holds the first and last key of each file.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import _remove, shared_dir, table, written

SIMILARITY = 0.8
#: Trees, and the levels (16 bits each) of their keys. Prefixes are widened until two texts that agree in exactly
#: ``SIMILARITY`` meet with a chance of ``RECALL``.
TREES, LEVELS, RECALL = 32, 4, 0.95
#: Numbers of the first tree for short texts of words, and for scripts without blanks; up to
#: ``SHORT`` words a text is short. Those trees hold the words themselves, ``WORD_LEVELS`` hash functions mixed into
#: a key: agreement in four fifths is 2/3 of their union, so one of 48 whole keys meets with
#: 1 - (1 - (2/3)^6)^48 = 0.988 whatever the length and the place of changes, and no shorter prefix is tried.
WORD_FIRST, WORD_TREES, WORD_LEVELS, CHAR_FIRST, SHORT = 640, 48, 6, 64, 256
#: Scripts without blanks have trees of their own: single changes cost them more shingles.
CHAR_TREES, SHINGLE, SHINGLE_CHARS = 128, 2, 3
#: Up to so many tokens of such a script every level has a hash function of its own instead of a bin.
CHAR_SHORT = 1200
#: Alphabets written without blanks (Thai, Lao, Khmer, Burmese) have few letters: unrelated texts share a third of
#: their runs of three, so their trees hold longer runs and are widened further.
LETTER_FIRST, SHINGLE_LETTERS = 320, 8
#: By kind of tree, how many values of their keys two texts must have in common to be compared: what texts that agree
#: in four fifths with scattered changes share (85 of 128 words, 60 of 128 pairs, 176 and 47 of 512 runs), less four
#: spreads (three for the last). Small vocabularies make unrelated short texts meet; this tells them apart unread.
WORD_SKETCH = 128
LEAST_SHARED = {WORD_FIRST: 64, 0: 38, CHAR_FIRST: 133, CHAR_FIRST + CHAR_TREES: 133, LETTER_FIRST: 27}
RANGE, GROWTH, MAX_RUNS = 64, 8, 8
#: Rows of a file of a run, and keys searched in one by a task.
FILE_ROWS, TASK_KEYS = 500_000, 200_000
#: As soon as so few uploads are open, with so few links, one task settles them in order.
LAST_UPLOADS, LAST_LINKS = 200_000, 1_000_000

#: Scripts written without blanks between words: kana, Han, Thai, Lao, Khmer, Burmese.
_UNSPACED = "぀-ヿ㐀-䶿一-鿿฀-๿຀-໿ក-៿က-႟"
#: Vowel signs of Indic scripts are no letters to ``re``, but parts of words.
_SIGNS = "ऀ-ॣ०-෿"
_LETTERS = re.compile("[฀-๿຀-໿ក-៿က-႟]")
_TOKEN = re.compile(rf"[{_UNSPACED}]|(?:[^\W_{_UNSPACED}]|[{_SIGNS}])+")
_MARKS = re.compile(r"[̀-ͯ]+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")


def tokens(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("ł", "l")
        text = unicodedata.normalize("NFC", text)
    return _TOKEN.findall(text)


class _Hashes(dict):
    """Hash of each token, worked out when it is first asked for."""

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[token] = h
        return h


def _shingles(paragraphs: list[list[str]], memo: _Hashes, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` tokens within paragraphs."""
    parts = []
    with np.errstate(over="ignore"):
        for toks in paragraphs:
            h = np.fromiter(map(memo.__getitem__, toks), dtype=np.uint64, count=len(toks))
            n = max(1, len(h) - k + 1)
            s = np.zeros(n, dtype=np.uint64)
            for j in range(min(k, len(h))):
                s = s * np.uint64(0x100000001B3) + h[j: j + n]
            parts.append(s)
        h = np.concatenate(parts)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _counted(paragraphs: list[list[str]], memo: _Hashes) -> np.ndarray:
    """Hashes of the words, each with the number of its earlier occurrences, as multisets compare them."""
    seen: Counter = Counter()
    out = []
    for p in paragraphs:
        for t in p:
            out.append((memo[t] + seen[t] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            seen[t] += 1
    h = np.array(out, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _keys(value: np.ndarray, trees: int) -> np.ndarray:
    """Keys of the trees, most significant level first, so that one tree's levels lie far apart."""
    value = value.reshape(LEVELS, trees).T
    key = np.zeros(trees, dtype=np.uint64)
    for i in range(LEVELS):
        key = (key << np.uint64(16)) | value[:, i]
    return key.view(np.int64)


def _binned(h: np.ndarray, trees: int) -> np.ndarray:
    """One pass of one-permutation hashing; bins that stay empty borrow from the next filled
    one, marked by the distance."""
    bins = trees * LEVELS
    with np.errstate(over="ignore"):
        h = np.sort(h)  # the bin is in the upper bits: its least value comes first
        place = ((h >> np.uint64(48)) * np.uint64(bins)) >> np.uint64(16)
        filled, first = np.unique(place, return_index=True)
        value = np.zeros(bins, dtype=np.uint64)
        low = (h[first] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
        filled = filled.astype(np.int64)
        value[filled] = low
        if len(filled) < bins:
            empty = np.setdiff1d(np.arange(bins), filled)
            at = np.searchsorted(filled, empty)
            source = filled[at % len(filled)]
            away = (source - empty) % bins
            value[empty] = (value[source] + away.astype(np.uint64) * np.uint64(0x51ED)) & np.uint64(0xFFFF)
    return _keys(value, trees)


_SEEDS = np.random.default_rng(17).integers(0, 2**63, (2, 4 * 128), dtype=np.uint64)


def _least(h: np.ndarray, functions: int) -> np.ndarray:
    """16-bit min-hash values with one function each: they stay independent however few shingles there are."""
    h = np.unique(h)
    least = np.full(functions, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 2048):
            mixed = (h[i: i + 2048, None] ^ _SEEDS[0, :functions]) * (_SEEDS[1, :functions] | np.uint64(1))
            mixed ^= mixed >> np.uint64(32)
            np.minimum(least, (mixed * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=least)
        return (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _separate(h: np.ndarray, trees: int) -> np.ndarray:
    return _keys(_least(h, trees * LEVELS), trees)


def _words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole keys of the short texts' trees, all functions of a tree mixed into one, and the values themselves."""
    values = _least(h, WORD_TREES * WORD_LEVELS)
    key = np.zeros(WORD_TREES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for v in values.reshape(WORD_LEVELS, WORD_TREES):
            key = (key ^ v) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64), values


def signature(paragraphs: list[list[str]], memo: _Hashes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Numbers of the trees a text is in, its keys there, and its sketch.

    Which trees follows from script and length; a text near a border is in those of both
    sides, so that texts that agree in four fifths always share a kind of tree.
    """
    count = sum(map(len, paragraphs))
    mean = sum(len(t) for p in paragraphs for t in p) / count
    kinds, sketches = [], []
    if mean >= 1.5:
        if count <= SHORT:
            keys, values = _words(_counted(paragraphs, memo))
            kinds.append((WORD_FIRST, keys))
            sketches.append(_short_form(WORD_FIRST, values[: WORD_SKETCH]))
        if count >= SHORT * SIMILARITY:
            kinds.append((0, _binned(_shingles(paragraphs, memo, SHINGLE), TREES)))
    letters = _letter_share(paragraphs) if mean < 2.7 else 0.0
    if mean < 2.7 and letters > 0.4:
        kinds.append((LETTER_FIRST, _separate(_shingles(paragraphs, memo, SHINGLE_LETTERS), CHAR_TREES)))
    if mean < 2.7 and letters < 0.6:
        h = _shingles(paragraphs, memo, SHINGLE_CHARS)
        if count <= CHAR_SHORT:
            kinds.append((CHAR_FIRST, _separate(h, CHAR_TREES)))
        if count >= CHAR_SHORT * SIMILARITY:
            kinds.append((CHAR_FIRST + CHAR_TREES, _binned(h, CHAR_TREES)))
    sketches += [_short_form(f, k.view(np.uint16)) for f, k in kinds if f != WORD_FIRST]
    return np.concatenate([np.arange(f, f + len(k), dtype=np.int32) for f, k in kinds]), np.concatenate([k for _, k in kinds]), b"".join(sketches)


def _short_form(first: int, values: np.ndarray) -> bytes:
    """The low byte of each value behind the number of its kind of trees and its length."""
    return np.array([first, len(values)], dtype="<u2").tobytes() + values.astype(np.uint8).tobytes()


def _in_order(x: list[str], y: list[str]) -> int:
    """Most tokens both have in the same order, by the bit-parallel longest common subsequence."""
    masks: dict[str, int] = {}
    for i, t in enumerate(y):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(y)) - 1
    v = full
    for t in x:
        m = masks.get(t)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


def _letter_share(paragraphs: list[list[str]]) -> float:
    """Share of letters of alphabets among the tokens written without blanks."""
    single = [t for p in paragraphs for t in p if len(t) == 1]
    return sum(1 for t in single if _LETTERS.match(t)) / len(single) if single else 0.0


def _aligned(a: list[list[str]], b: list[list[str]]) -> float:
    """Share of the longer text's tokens that both have in order, paragraphs moved as fits best."""
    x, y = ([t for p in ps for t in p] for ps in (a, b))
    most = max(len(x), len(y))
    need = SIMILARITY * most
    # each token that is not shared breaks at most two pairs of neighbours
    if sum((Counter(x) & Counter(y)).values()) < need or sum((Counter(zip(x, x[1:])) & Counter(zip(y, y[1:]))).values()) < (3 * SIMILARITY - 2) * most - 2 * (len(a) + len(b)):
        return 0.0
    best = _in_order(x, y)
    if best < need and len(a) + len(b) > 2:
        for ps, other in ((a, y), (b, x)):
            if len(ps) > 1:
                at: dict[tuple, list[int]] = {}
                for i, g in enumerate(zip(other, other[1:], other[2:])):
                    at.setdefault(g, []).append(i)

                def place(p: list[str]) -> float:
                    spots = sorted(i - k for k, g in enumerate(zip(p, p[1:], p[2:])) for i in at.get(g, ())[:4])
                    return spots[len(spots) // 2] if spots else len(other)

                best = max(best, _in_order([t for p in sorted(ps, key=place) for t in p], other))
    return best / most


def agreement(a: str, b: str) -> float:
    """Share of the longer one's wording that both normalised texts have."""
    x, y = a.split(), b.split()
    most = max(len(x), len(y))
    if all(sum(map(len, t)) >= 2 * len(t) for t in (x, y)) or most < 6:
        return sum((Counter(x) & Counter(y)).values()) / most
    return _aligned([p.split() for p in a.split("\n")], [p.split() for p in b.split("\n")])


def _kinds(x: bytes) -> dict[int, np.ndarray]:
    out, at = {}, 0
    while at < len(x):
        first, n = np.frombuffer(x, "<u2", 2, at)
        out[int(first)] = np.frombuffer(x, np.uint8, int(n), at + 4)
        at += 4 + int(n)
    return out


def worth_comparing(x: bytes, y: bytes) -> bool:
    """Whether two sketches have enough in common in a kind of trees both texts are in."""
    a, b = _kinds(x), _kinds(y)
    return any(k in b and int((v == b[k]).sum()) >= LEAST_SHARED[k] for k, v in a.items())


def texts_of(docs: DataFrame) -> DataFrame:
    """``(id, cls, norm, sketch, trees, keys)`` of rows ``(id, text)``; no row for blank texts.

    ``cls`` is the same for texts of the same wording, ``norm`` the tokens with paragraphs
    as lines, ``trees`` and ``keys`` the forest's, ``sketch`` the keys in short.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for pdf in batches:
            rows = []
            for number, text in zip(pdf["id"], pdf["text"]):
                paragraphs = [t for p in _PARAGRAPH.split(text) if (t := tokens(p))]
                if not paragraphs:
                    continue
                norm = [" ".join(t) for t in paragraphs]
                trees, keys, short = signature(paragraphs, memo)
                rows.append((number, hashlib.blake2b("\n".join(sorted(norm)).encode("utf-8", "surrogatepass"), digest_size=16).digest(), "\n".join(norm),
                             short, trees, keys))
                if len(memo) > 200_000:
                    memo.clear()
            yield pd.DataFrame(rows, columns=["id", "cls", "norm", "sketch", "trees", "keys"])

    return docs.where("text is not null").mapInPandas(run, "id long, cls binary, norm string, sketch binary, trees array<int>, keys array<long>")


def depths(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, ...]:
    """Prefix lengths in levels, from the whole key down to the first at which the recall is reached.

    Agreement ``s`` in words leaves ``s * s`` of the pairs of neighbours when changes are scattered, so
    a level is the same with a chance of ``s * s / (2 - s * s)``.
    """
    same = similarity**SHINGLE / (2 - similarity**SHINGLE)
    out = [d for d in range(LEVELS, 0, -1)]
    enough = next((i for i, d in enumerate(out) if 1 - (1 - same**d) ** TREES >= recall), len(out) - 1)
    return tuple(out[: enough + 1])


class Run:
    """Files of keys sorted by (tree, key, id): their places and their first and last keys."""

    def __init__(self, files: list[tuple[str, int, int, int, int]]):
        self.files = sorted(files, key=lambda f: f[1:])

    @classmethod
    def write(cls, keys: DataFrame, path: str) -> Run:
        """Write ``(id, trees, keys)`` as a sorted run. A key shared by many texts is split by id."""
        spark = keys.sparkSession
        rows = keys.select(F.explode(F.arrays_zip("trees", "keys")).alias("k"), "id").select(F.col("k.trees").cast("short").alias("tree"), F.col("k.keys").alias("key"), "id")
        return cls._sorted(rows, int(keys.agg(F.sum(F.size("trees"))).first()[0] or 0), spark, path)

    @classmethod
    def _sorted(cls, rows: DataFrame, count: int, spark: SparkSession, path: str) -> Run:
        parts = max(16, -(-count // FILE_ROWS))
        rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").write.option("compression", "zstd").parquet(path)
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Run:
        rows = spark.read.schema("tree short, key long, id long").parquet(path)
        ends = rows.groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("tree", "key")).alias("lo"), F.max(F.struct("tree", "key")).alias("hi"))
        return cls([(r["f"], r["lo"]["tree"], r["lo"]["key"], r["hi"]["tree"], r["hi"]["key"]) for r in ends.collect()])

    def frame(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.schema("tree short, key long, id long").parquet(*[f[0] for f in self.files]) if self.files else None


class Forest:
    """The persistent index in a folder: texts and key runs of everything accepted so far."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> Forest:
        """A forest in the shared folder, removed when the session's process ends."""
        path = f"{shared_dir(spark).rstrip('/')}/docloom-forest-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, path)
        return cls(spark, path)

    def _parts(self, kind: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(str(x.getPath()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def texts(self) -> DataFrame:
        """``(id, cls, norm)`` of all texts held."""
        parts = self._parts("texts")
        return self.spark.read.schema(_TEXT).parquet(*parts) if parts else self.spark.createDataFrame([], _TEXT)

    def files(self) -> DataFrame:
        """``(file_id, sha, accepted)`` of uploads taken since the collection was indexed."""
        parts = self._parts("files")
        return self.spark.read.schema(_FILE).parquet(*parts) if parts else self.spark.createDataFrame([], _FILE)

    def runs(self) -> list[Run]:
        return [Run.read(self.spark, p) for p in self._parts("keys")]

    def add(self, signed: DataFrame) -> None:
        """Add ``(id, cls, norm, sketch, trees, keys)``; copies of a wording share one entry in the trees."""
        name = f"run-{len(self._parts('texts')):06d}-{uuid.uuid4().hex[:8]}"
        first = signed.groupBy("cls").agg(F.min("id").alias("id"))
        Run.write(signed.select("id", "trees", "keys").join(first, "id", "left_semi"), f"{self.path}/keys/{name}")
        signed.select("id", "cls", "norm", "sketch").write.option("compression", "zstd").parquet(f"{self.path}/texts/{name}")
        if len(self._parts("keys")) > MAX_RUNS:
            self.merge()

    def merge(self) -> None:
        """Merge all key runs into one; texts are neither read nor signed."""
        old = self._parts("keys")
        rows = self.spark.read.schema("tree short, key long, id long").parquet(*old)
        Run._sorted(rows, rows.count(), self.spark, f"{self.path}/keys/merged-{uuid.uuid4().hex[:8]}")
        for p in old:
            _remove(self.spark, p)

    def accept(self, signed: DataFrame, decided: DataFrame) -> None:
        """Take in a batch: texts of accepted uploads, and files and bytes of those that count later."""
        kept = decided.where("status in ('accepted', 'bytes') and file_id is not null")
        kept.selectExpr("file_id", "sha", "status = 'accepted' as accepted").write.parquet(f"{self.path}/files/batch-{uuid.uuid4().hex}")
        new = decided.where("status = 'accepted' and file_id is not null").select((F.col("seq") * 2 + 1).alias("id"), "file_id")
        self.add(written(signed.join(new, "id").withColumn("id", F.col("file_id") * 2).drop("file_id")))


_TEXT, _FILE = "id long, cls binary, norm string, sketch binary", "file_id long, sha string, accepted boolean"


@lru_cache(maxsize=4)
def _opened(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    t = pq.read_table(path, filesystem=system)
    return tuple(t.column(c).to_numpy() for c in ("tree", "key", "id"))


def _bounds(tree: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last key of each prefix; short texts are looked up by whole keys, unspaced alphabets by shorter ones."""
    short = tree >= WORD_FIRST
    drop = LEVELS - depth
    shift = 16 * np.where(short, 0, np.where(tree >= LETTER_FIRST, min(2 * drop, LEVELS - 1), drop)).astype(np.int64)
    lo = (key >> shift) << shift
    return lo, lo | ((np.int64(1) << shift) - 1)


def lookup(run: Run, entries: DataFrame, depth: int, skip: int = 0, take: int = RANGE, *, earlier: bool = False) -> DataFrame:
    """``(a, b)``: texts ``b`` of the run in the ranges of the keys ``(a, tree, key)``.

    Of each file's part of a range the ``skip``-th to ``take``-th by id come out; a null ``b`` tells that there are
    more. With ``earlier`` only smaller ids count.
    """
    files = run.files

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, tree, key = (batch.column(c).to_numpy() for c in ("a", "tree", "key"))
            lo, hi = _bounds(tree, key, depth)
            rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for t in np.unique(tree):
                at = np.flatnonzero(tree == t)
                for n, (_, t0, k0, t1, k1) in enumerate(files):
                    if t0 <= t <= t1:
                        ok = at[((t0 < t) | (hi[at] >= k0)) & ((t < t1) | (lo[at] <= k1))]
                        rows.append(ok), parts.append(np.full(len(ok), n, np.int32))
            take_ = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(a[take_]), pa.array(tree[take_]), pa.array(key[take_])], names=["part", "a", "tree", "key"])

    def search(t: pa.Table) -> pa.Table:
        a, tree, key = (t.column(c).to_numpy() for c in ("a", "tree", "key"))
        out_a, out_b, more = [], [], []
        if len(a):
            trees, keys, ids = _opened(files[int(t.column("part")[0].as_py())][0])
            lo, hi = _bounds(tree, key, depth)
            for one in np.unique(tree):
                at = np.flatnonzero(tree == one)
                x, y = np.searchsorted(trees, one, "left"), np.searchsorted(trees, one, "right")
                begin, end = x + np.searchsorted(keys[x:y], lo[at], "left"), x + np.searchsorted(keys[x:y], hi[at], "right")
                # ranges asked for by several texts are sorted once
                spans, which = np.unique(np.stack([begin, end], axis=1), axis=0, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")
                cuts = np.searchsorted(which.ravel()[order], np.arange(len(spans) + 1))
                for i, (p, q) in enumerate(spans.tolist()):
                    if q - p <= skip:
                        continue
                    who = a[at[order[cuts[i]: cuts[i + 1]]]]
                    there = np.sort(ids[p:q])
                    block = there[skip:take]
                    aa, bb = np.repeat(who, len(block)), np.tile(block, len(who))
                    keep = bb < aa if earlier else bb != aa
                    out_a.append(aa[keep]), out_b.append(bb[keep])
                    if len(there) > take:
                        more.append(who[who > there[take]] if earlier else who)
        more = np.unique(np.concatenate(more)) if more else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0) if out_a else np.zeros((0, 2), np.int64)
        return pa.table({"a": np.concatenate([pairs[:, 0], more]), "b": pa.array(np.concatenate([pairs[:, 1], more]), mask=np.arange(len(pairs) + len(more)) >= len(pairs))})

    if not files:
        return entries.sparkSession.createDataFrame([], "a long, b long")
    routed = entries.mapInArrow(route, "part int, a long, tree short, key long")
    # a file many keys go to is searched by several tasks
    sizes = routed.groupBy("part").agg(F.count("*").alias("_n"))
    spread = routed.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("a"), F.expr(f"_n div {TASK_KEYS} + 1"))).drop("_n")
    return spread.groupBy("part", "salt").applyInArrow(search, "a long, b long")


def _count():
    """Number of tokens of a normalised text."""
    return F.expr("length(norm) - length(translate(norm, ' \\n', '')) + 1")


def _verified(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose whole texts agree; only texts that are in some pair are moved."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([worth_comparing(p, q) for p, q in zip(x, y)], dtype=bool)

    @F.pandas_udf("double")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([agreement(p, q) for p, q in zip(x, y)], dtype="float64")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # numbers of tokens and sketches alone rule most hits out, before any text is moved
    short = written(norms.join(asked, "id", "left_semi").select("id", _count().alias("n"), "sketch"))
    light = pairs.join(short.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_s")), "a").join(
        short.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_t")), "b").where(f"least(_n, _m) >= {similarity} * greatest(_n, _m)")
    near = written(light.where(alike("_s", "_t")).select("a", "b"))
    texts = norms.join(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "norm")
    both = near.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("_x")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("_y")), "b")
    return both.select("a", "b", agree("_x", "_y").alias("sim")).where(F.col("sim") >= similarity)


def entries(signed: DataFrame) -> DataFrame:
    """``(a, tree, key)`` of signed texts."""
    return signed.select(F.col("id").alias("a"), F.explode(F.arrays_zip("trees", "keys")).alias("k")).select("a", F.col("k.trees").cast("short").alias("tree"), F.col("k.keys").alias("key"))


def _long_ones(keys: DataFrame) -> DataFrame:
    """Keys whose prefixes may be shortened; short texts have met by whole keys."""
    return keys.where(F.col("tree") < WORD_FIRST)


def matches(runs: list[Run], batch: DataFrame, norms: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``(a, b, sim)``: texts of the batch, ``(a, tree, key)``, with texts of the runs that agree with them.

    One stored match decides a text, so it leaves the search with the step that gave it one.
    """
    found: DataFrame | None = None
    still = batch
    for n, depth in enumerate(depths(similarity, recall)):
        left = still if n == 0 else _long_ones(still)
        skip, take = 0, RANGE
        while True:
            hits = None
            for run in runs:
                part = lookup(run, left, depth, skip, take)
                hits = part if hits is None else hits.unionByName(part)
            if hits is None:
                break
            hits = written(hits)
            pairs = hits.where("b is not null").distinct()
            if found is not None:
                pairs = pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")
            new = written(_verified(written(pairs), norms, similarity))
            found = new if found is None else found.unionByName(new)
            more = written(hits.where("b is null").select("a").distinct().join(new.select("a").distinct(), "a", "left_anti"))
            if more.isEmpty():
                break
            left = written(left.join(more, "a", "left_semi"))
            skip, take = take, take * GROWTH
        if found is not None:
            still = still.join(found.select("a").distinct(), "a", "left_anti")
    if found is None:
        return batch.sparkSession.createDataFrame([], "a long, b long, sim double")
    return found


def earlier(run: Run, batch: DataFrame, norms: DataFrame, plain: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``(a, b, sim)``: texts of uploads with those of earlier ones, ``b < a``, as far as they can decide ``a``.

    A text leaves the search only when it agrees with one sure to be accepted: one of
    ``plain`` (ids whose first upload repeats no file and no bytes) that has met all earlier
    texts of its ranges and agrees with none. What agrees with that one is never accepted,
    so nothing else depends on it; all other pairs of a range are compared. Ranges are wide
    enough here to hold those of all greater depths.
    """
    depth = depths(similarity, recall)[-1]
    left, found, skip, take = batch, None, 0, RANGE
    while True:
        hits = written(lookup(run, left, depth, skip, take, earlier=True))
        pairs = hits.where("b is not null").distinct()
        if found is not None:
            pairs = pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_verified(written(pairs), norms, similarity))
        found = new if found is None else found.unionByName(new)
        more = written(hits.where("b is null").select("a").distinct())
        if more.isEmpty():
            return found
        sure = plain.join(more, F.col("id") == F.col("a"), "left_anti").join(found.select(F.col("a").alias("id")), "id", "left_anti")
        closed = found.join(sure.select(F.col("id").alias("b")), "b", "left_semi").select("a").distinct()
        left = written(left.join(more.join(closed, "a", "left_anti"), "a", "left_semi"))
        skip, take = take, take * GROWTH


def _stored(chunks: DataFrame) -> DataFrame:
    texts = chunks.where("hierarchy = 'parent' and type = 'text' and is_search and contents is not null and file_id is not null")
    return texts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "id", "contents"))).alias("_p")).select(
        F.col("file_id").alias("key"), F.expr("array_join(transform(_p, x -> x.contents), '\n\n')").alias("text"))


def indexed(chunks: DataFrame, forest: Forest | None = None) -> Forest:
    """The forest of a stored collection; text ids are even numbers, twice the file's."""
    forest = forest or Forest.temporary(chunks.sparkSession)
    forest.add(written(texts_of(_stored(chunks).select((F.col("key") * 2).alias("id"), "text"))))
    return forest


def decided(uploads: DataFrame, chunks: DataFrame, forest: Forest, *, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """State of a batch of uploads, ``(seq, file_id, sha, cls, .., status, match)``, and its signed texts.

    Of ``chunks`` only file ids and hashes are read; texts come from the forest.
    """
    up = uploads.where("seq is not null").select(
        "seq", F.col("file_id").cast("long").alias("file_id"), F.sha2("content", 256).alias("sha"), F.array_join("pages", "\n\n").alias("text"))
    # ids of uploads are odd numbers, in order
    signed = written(texts_of(up.select((F.col("seq") * 2 + 1).alias("id"), "text")))
    stored = forest.texts()
    # one id a distinct wording: its smallest file, else its first upload
    held = stored.groupBy("cls").agg(F.min("id").alias("s"))
    mine = signed.groupBy("cls").agg(F.min("id").alias("u"))
    of_text = written(signed.select("id", "cls").join(mine, "cls").join(held, "cls", "left").select("id", F.coalesce("s", "u").alias("rep"), F.col("s").alias("same")))
    new = signed.join(of_text.where("id = rep").select("id"), "id", "left_semi")
    keys = entries(new)
    norms = signed.select("id", "norm", "sketch").unionByName(stored.select("id", "norm", "sketch"))
    to_stored = matches(forest.runs(), keys, norms, similarity=similarity, recall=recall)

    equal = of_text.where("same is not null").select(F.col("rep").alias("rep"), F.shiftright("same", 1).alias("file"), F.lit(1.0).alias("sim"))
    # a wording held under several files is named by the smallest
    near = to_stored.select(F.col("a").alias("rep"), F.shiftright("b", 1).alias("file"), "sim")
    stored_near = written(near.unionByName(equal).groupBy("rep").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("file"))).getField("file").alias("s_near")))
    since = forest.files()
    known = chunks.select(F.col("file_id").cast("long").alias("file_id")).unionByName(since.select("file_id")).where("file_id is not null").distinct().withColumn("s_id", F.lit(True))
    hashes = chunks.where("is_search and content_hash <> ''").select(F.lower("content_hash").alias("sha"), F.col("file_id").cast("long").alias("file_id")).unionByName(
        since.where("accepted and sha is not null").select("sha", "file_id")).groupBy("sha").agg(F.min("file_id").alias("s_bytes"))
    of_upload = of_text.select(F.shiftright("id", 1).alias("seq"), F.col("rep").alias("cls")).distinct()
    state = written(up.select("seq", "file_id", "sha").join(of_upload, "seq", "left").join(known, "file_id", "left").join(hashes, "sha", "left").join(
        stored_near.withColumnRenamed("rep", "cls"), "cls", "left").withColumns({"status": F.lit(None).cast("string"), "match": F.lit(None).cast("long")}))
    # only wordings that can be accepted are compared with each other
    able = state.where("s_id is null and s_bytes is null and s_near is null and cls is not null")
    firsts = [state.where(f"{c} is not null").groupBy(c).agg(F.min("seq").alias(f"first_{c}")) for c in ("file_id", "sha")]
    plain = written(able.where("cls = seq * 2 + 1").join(firsts[0], "file_id", "left").join(firsts[1], "sha", "left").where(
        "coalesce(first_file_id, seq) = seq and coalesce(first_sha, seq) = seq").select(F.col("cls").alias("id")))
    open_texts = written(signed.join(able.select(F.col("cls").alias("id")).distinct(), "id", "left_semi"))
    path = f"{shared_dir(up.sparkSession).rstrip('/')}/docloom-run-{uuid.uuid4().hex}"
    atexit.register(_remove, up.sparkSession, path)
    links = earlier(Run.write(open_texts.select("id", "trees", "keys"), path), entries(open_texts), signed.select("id", "norm", "sketch"), plain, similarity=similarity, recall=recall)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    return _settled(state, written(both)), signed


def repeats(uploads: DataFrame, chunks: DataFrame, forest: Forest | None = None, *, similarity: float = SIMILARITY, recall: float = RECALL, accept: bool = False) -> DataFrame:
    """``(seq, kind, match_file_id)`` of the uploads that repeat something.

    With a ``forest`` the collection's texts are not read again. ``accept`` adds the batch's accepted texts to it,
    for the next batch to be held against.
    """
    held = forest if forest is not None else indexed(chunks)
    state, signed = decided(uploads, chunks, held, similarity=similarity, recall=recall)
    if accept:
        held.accept(signed, state)
    return state.where("status <> 'accepted'").select("seq", F.col("status").alias("kind"), F.col("match").alias("match_file_id"))


_DECISION = """CASE
    WHEN s_id OR a_file < seq THEN struct('id' AS status, file_id AS match)
    WHEN u_file < seq THEN NULL
    WHEN s_bytes IS NOT NULL THEN struct('bytes' AS status, s_bytes AS match)
    WHEN a_sha.seq < seq THEN struct('bytes' AS status, a_sha.file_id AS match)
    WHEN u_sha < seq THEN NULL
    WHEN s_near IS NOT NULL THEN struct('near' AS status, s_near AS match)
    WHEN a_cls.seq < seq THEN struct('near' AS status, a_cls.file_id AS match)
    WHEN u_cls < seq THEN NULL
    WHEN n_acc IS NOT NULL THEN struct('near' AS status, n_acc.file AS match)
    WHEN n_open IS NOT NULL THEN NULL
    ELSE struct('accepted' AS status, file_id AS match) END"""
_STATE = "seq long, file_id long, sha string, cls long, s_id boolean, s_bytes long, s_near long, status string, match long"


def _one_by_one(state: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Decide the uploads without a status one by one; the others are decided already."""
    around: dict[int, list[tuple[int, float]]] = {}
    for a, b, sim in zip(links["a"].tolist(), links["b"].tolist(), links["sim"].tolist()):
        around.setdefault(a, []).append((b, sim))
    files: set[int] = set()
    shas: dict[str, int] = {}
    classes: dict[int, tuple[int, int]] = {}
    state = state.sort_values("seq", kind="stable")
    out = []
    for r in state.astype(object).where(state.notna(), None).itertuples(index=False):
        status, match = r.status, r.match
        if status is None:
            if r.s_id or r.file_id is not None and r.file_id in files:
                status, match = "id", r.file_id
            elif r.s_bytes is not None:
                status, match = "bytes", r.s_bytes
            elif r.sha is not None and r.sha in shas:
                status, match = "bytes", shas[r.sha]
            elif r.s_near is not None:
                status, match = "near", r.s_near
            elif r.cls is not None and r.cls in classes:
                status, match = "near", classes[r.cls][1]
            else:
                met = [(-sim, *classes[b]) for b, sim in around.get(r.cls, ()) if b in classes] if r.cls is not None else []
                status, match = ("near", min(met, key=lambda m: m[:2])[2]) if met else ("accepted", r.file_id)
        if status in ("accepted", "bytes") and r.file_id is not None:
            files.add(r.file_id)
        if status == "accepted":
            if r.sha is not None:
                shas.setdefault(r.sha, r.file_id)
            if r.cls is not None:
                classes.setdefault(r.cls, (r.seq, r.file_id))
        out.append((*r[:7], status, match))
    result = pd.DataFrame(out, columns=list(state.columns))
    return result.astype({c: "Int64" for c in ("seq", "file_id", "cls", "s_bytes", "s_near", "match")})


def _settled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Decide uploads as if they came one by one: in rounds over the table while many are open, the last ones in one task.

    Every round decides at least the earliest open upload of each group of uploads that depend on each
    other; where uploads come in no special order, chains of undecided ones shorten geometrically.
    """
    done: DataFrame | None = None
    while True:
        if state.where("status is null").limit(LAST_UPLOADS + 1).count() <= LAST_UPLOADS and edges.limit(LAST_LINKS + 1).count() <= LAST_LINKS:
            return _last(state, edges, done)
        kept = state.where("status in ('accepted', 'bytes')") if done is None else done.where("status in ('accepted', 'bytes')")
        left = state.where("status is null")
        by_file = kept.groupBy("file_id").agg(F.min("seq").alias("a_file"))
        open_file = left.groupBy("file_id").agg(F.min("seq").alias("u_file"))
        accepted = kept.where("status = 'accepted'")
        by_sha = accepted.groupBy("sha").agg(F.min(F.struct("seq", "file_id")).alias("a_sha"))
        open_sha = left.groupBy("sha").agg(F.min("seq").alias("u_sha"))
        by_cls = accepted.groupBy("cls").agg(F.min(F.struct("seq", "file_id")).alias("a_cls"))
        open_cls = left.groupBy("cls").agg(F.min("seq").alias("u_cls"))
        # texts next to each other, seen from a text: the nearest accepted and the earliest open one
        around = edges.join(by_cls.withColumnRenamed("cls", "b"), "b", "left").join(open_cls.withColumnRenamed("cls", "b"), "b", "left").where("a_cls is not null or u_cls is not null")
        near = left.select("seq", "cls").join(around, F.col("cls") == F.col("a")).groupBy("seq").agg(
            F.min(F.expr("CASE WHEN a_cls.seq < seq THEN struct(-sim AS s, a_cls.seq AS at, a_cls.file_id AS file) END")).alias("n_acc"),
            F.min(F.expr("CASE WHEN u_cls < seq THEN u_cls END")).alias("n_open"))
        step = left.join(by_file, "file_id", "left").join(open_file, "file_id", "left").join(by_sha, "sha", "left").join(open_sha, "sha", "left").join(
            by_cls, "cls", "left").join(open_cls, "cls", "left").join(near, "seq", "left")
        decided = step.withColumn("_d", F.expr(_DECISION))
        columns = ["seq", "file_id", "sha", "cls", "s_id", "s_bytes", "s_near"]
        out = written(decided.select(*columns, F.col("_d.status").alias("status"), F.col("_d.match").alias("match")))
        new = out.where("status is not null")
        done = new if done is None else done.unionByName(new)
        state = written(out.where("status is null"))


def _last(state: DataFrame, edges: DataFrame, done: DataFrame | None) -> DataFrame:
    """The open uploads, known to be few, with the decided ones they may depend on, in one task."""
    columns = ["seq", "file_id", "sha", "cls", "s_id", "s_bytes", "s_near", "status", "match"]
    left = state.select(*columns)
    links = edges.select("a", "b", "sim")
    if done is not None:
        opened = state.select("file_id", "sha", "cls")
        beside = opened.select("cls").unionByName(edges.join(opened.select(F.col("cls").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("cls"))).distinct()
        # of decided uploads the first of each file, bytes and wording is enough
        kept = done.where("status in ('accepted', 'bytes')")
        firsts = None
        for c, wanted in (("file_id", opened.select("file_id").distinct()), ("sha", opened.select("sha").distinct()), ("cls", beside)):
            rows = kept if c == "file_id" else kept.where("status = 'accepted'")
            seqs = rows.join(wanted.where(f"{c} is not null"), c, "left_semi").groupBy(c).agg(F.min("seq").alias("seq")).select("seq")
            firsts = seqs if firsts is None else firsts.unionByName(seqs)
        left = left.unionByName(kept.join(firsts.distinct(), "seq", "left_semi").select(*columns))
    whole = left.withColumn("_g", F.lit(0)).groupBy("_g").cogroup(links.withColumn("_g", F.lit(0)).groupBy("_g")).applyInPandas(
        lambda x, y: _one_by_one(x.drop(columns="_g"), y), _STATE)
    settled = written(whole.join(state.select("seq"), "seq", "left_semi"))
    return settled if done is None else done.select(*columns).unionByName(settled)


def found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "documents_in"), table(spark, d, "chunks"))


def recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the forest's search against comparing texts one by one.

    The stated query set, uploads whose ``seq`` is divisible by 100, is held against every stored text,
    block by block; a query counts as found if the forest names at least one text that agrees with it.
    """
    forest = indexed(table(spark, d, "chunks"))
    up = table(spark, d, "documents_in").where("seq % 100 = 0").select((F.col("seq") * 2 + 1).alias("id"), F.array_join("pages", "\n\n").alias("text"))
    signed = written(texts_of(up))
    stored = forest.texts()
    met = matches(forest.runs(), entries(signed), signed.select("id", "norm", "sketch").unionByName(stored.select("id", "norm", "sketch"))).select("a").distinct().withColumn("hit", F.lit(1))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = list(zip(left.column("id").to_pylist(), left.column("norm").to_pylist()))
        bags = [Counter(n.split()) for _, n in mine]
        agree = []
        for other in right.column("norm").to_pylist():
            bag = Counter(other.split())
            size = sum(bag.values())
            for (number, norm), own in zip(mine, bags):
                n = sum(own.values())
                # tokens both have, in whatever order, are the most they can agree in
                if min(n, size) >= SIMILARITY * max(n, size) and sum((own & bag).values()) >= SIMILARITY * max(n, size) and agreement(norm, other) >= SIMILARITY:
                    agree.append(number)
        return pa.table({"a": pa.array(sorted(set(agree)), pa.int64())})

    cells = 64
    blocks = max(1, signed.count() // 200)
    queries = signed.select("id", "norm", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    others = stored.select("norm", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    truth = queries.groupBy("cell", "block").cogroup(others.groupBy("cell", "block")).applyInArrow(compare, "a long").distinct()
    return truth.join(met, "a", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("found"), F.round(F.expr("try_divide(count(hit), count(*))"), 4).alias("recall"))


QUERIES = {"p3_found": found, "p3_recall": recall}
