"""Problem 5: the most similar vectors for every vector.

Hierarchical navigable small-world graphs, one a shard, stored as flat neighbour arrays.
Vectors go to the shard of their nearest pivot; pivots are themselves vectors of the
collection, so dense regions get more of them and shards stay of like size. A shard that grows
beyond ``SPLIT`` vectors all the same (a dense region, or more vectors than pivots provide for) is split
by hash. A vector is inserted into its own shard's graph, which finds its earlier neighbours on the
way. The graphs are written, one row a shard with its ids, vectors and flat neighbour arrays
(``built``), and can be read again for other queries. Every vector is then searched for in the graphs of the
next nearest pivots and in the other parts of its own shard. The shards' results are
merged, and every reported pair's cosine is computed again in double precision.

Inside a shard everything is done for many vectors at once: beams of a whole batch advance
through the layers together over the neighbour arrays.

Defined results
---------------
* Unusable vectors (null, of another width, zero, with null, NaN or infinite elements)
  neither ask nor answer. Lengths do not matter: vectors are normalised.
* Equal vectors are indexed once. Among equal cosines smaller ids come first, so a group
  of copies gives pairs among its first ``k + 1`` ids only and never all pairs.
* ``id_a < id_b``; a pair comes out once. Rows repeated under one id count once.
* Empty tables give an empty result.

Pivots are at most ``MAX_PIVOTS``, chosen by hash over all vectors, and the only thing sent
to every task (2 MB at 64 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.runtime import table, written

WIDTH, K, COSINE = 64, 10, 0.90
SHARD, SPLIT, MAX_PIVOTS, ROUTES = 2500, 10_000, 8192, 3
LINKS, BEAM, BATCH, STRIDE = 10, 20, 512, 3
_SLACK = 1e-4


class Graph:
    """Layers of flat neighbour arrays over the rows of one matrix of unit vectors."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 7):
        self.x, self.links, self.beam = np.ascontiguousarray(x, dtype=np.float32), links, beam
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")  # upper layers first
        self.level = level
        #: neighbours of each row in each layer, -1 where there are fewer
        self.layers = [np.full((n, links * (2 if i == 0 else 1)), -1, dtype=np.int32) for i in range(level.max() + 1 if n else 1)]
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def arrays(self) -> tuple[bytes, list[bytes]]:
        """Levels of the rows and the neighbour arrays of the layers, as they are stored."""
        return self.level.astype("<i4").tobytes(), [np.ascontiguousarray(t, dtype="<i4").tobytes() for t in self.layers]

    @classmethod
    def stored(cls, x: np.ndarray, level: bytes, layers: list[bytes], links: int = LINKS, beam: int = BEAM) -> Graph:
        """A graph read back: nothing is inserted again."""
        g = cls.__new__(cls)
        g.x, g.links, g.beam, g.pairs = np.ascontiguousarray(x, dtype=np.float32), links, beam, []
        g.level = np.frombuffer(level, dtype="<i4")
        g.order = np.argsort(-g.level, kind="stable")
        g.layers = [np.frombuffer(t, dtype="<i4").reshape(len(x), -1) for t in layers]
        return g

    def build(self, report: float = 2.0) -> Graph:
        """Insert all rows; pairs of at least ``report`` met on the way are kept."""
        for layer in range(len(self.layers) - 1, -1, -1):
            members = self.order[: int((self.level >= layer).sum())]
            done = 0
            self.linked = np.zeros(len(self.x) + 1, dtype=bool)  # the last stands for none
            while done < len(members):
                size = min(BATCH, max(64, done), len(members) - done)
                self._insert(layer, members[done: done + size], members[:done], report if layer == 0 else 2.0)
                done += size
        return self

    def _insert(self, layer: int, new: np.ndarray, old: np.ndarray, report: float) -> None:
        q = self.x[new]
        within = q @ q.T
        np.fill_diagonal(within, -2)
        k = min(self.beam, len(new))
        near = np.argpartition(-within, k - 1, axis=1)[:, :k]
        ids, sims = new[near].astype(np.int32), np.take_along_axis(within, near, 1)
        if len(old):
            start = np.full((len(new), 1), old[0], dtype=np.int32)
            if layer + 1 < len(self.layers):  # rows of upper layers may not be in this one yet, as the row itself is not
                entries = self._descend(q, layer)
                there = self.linked[entries]
                first = there.argmax(axis=1)
                start = np.where(there.any(axis=1), entries[np.arange(len(new)), first], start[:, 0])[:, None]
            found, fs = self._beam(q, layer, start, self.beam)
            ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, fs], 1)
        if report <= 1:
            r, c = np.nonzero(sims >= report)
            self.pairs.append((new[r], ids[r, c], sims[r, c]))
        keep = min(self.beam, ids.shape[1])
        order = np.argsort(-sims, axis=1)[:, :keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        chosen = self._diverse(ids, sims, self.links)
        self.layers[layer][new, : self.links] = chosen
        self._link_back(layer, new, chosen)
        self.linked[new] = True

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling order keep those nearer to the row than to any kept one."""
        ids = np.where(sims > -1.5, ids, -1)
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        rows, width = ids.shape
        kept = np.zeros((rows, width), dtype=bool)
        closest = np.full((rows, width), -2.0, dtype=np.float32)
        count = np.zeros(rows, dtype=np.int32)
        for j in range(width):
            take = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > closest[:, j])
            kept[:, j] = take
            count += take
            np.maximum(closest, np.where(take[:, None], between[:, j], -2.0), out=closest)
        # fill up with the nearest of the rest, so that no row is poorly linked
        rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width), axis=1)[:, :most]
        out = np.full((rows, most), -1, dtype=np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
        return out

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        table = self.layers[layer]
        width = table.shape[1]
        r, c = np.nonzero(chosen >= 0)
        if not len(r):
            return
        to, frm = chosen[r, c], new[r]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        first = np.r_[True, to[1:] != to[:-1]]
        starts = np.flatnonzero(first)
        place = np.arange(len(to)) - np.repeat(starts, np.diff(np.r_[starts, len(to)]))
        targets = to[starts]
        have = (table[targets] >= 0).sum(1)
        slot = np.repeat(have, np.diff(np.r_[starts, len(to)])) + place
        room = slot < width
        table[to[room], slot[room]] = frm[room]
        full = np.unique(to[~room])
        if not len(full):
            return
        at = np.searchsorted(full, to[~room])
        over = frm[~room]
        s2 = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        p2 = np.arange(len(at)) - np.repeat(s2, np.diff(np.r_[s2, len(at)]))
        extra = np.full((len(full), int(p2.max()) + 1), -1, dtype=np.int32)
        extra[at, p2] = over
        ids = np.concatenate([table[full], extra], 1)
        sims = np.einsum("rcd,rd->rc", self.x[ids], self.x[full], optimize=False)
        sims[ids < 0] = -2
        order = np.argsort(-sims, axis=1)
        table[full] = self._diverse(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), width)

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """The best rows found for each query in the layers above, as entries below."""
        start = np.full((len(q), 1), self.order[0], dtype=np.int32)
        for above in range(len(self.layers) - 1, layer, -1):
            start = self._beam(q, above, start, 4)[0]
        return start

    def _beam(self, q: np.ndarray, layer: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a whole batch: ids and cosines, best first, -2 where none."""
        table, x = self.layers[layer], self.x
        rows, n = len(q), len(x)
        out_ids = np.full((rows, width), -1, dtype=np.int32)
        out_sims = np.full((rows, width), -2.0, dtype=np.float32)
        ids = np.full((rows, width), -1, dtype=np.int32)
        sims = np.full((rows, width), -2.0, dtype=np.float32)
        done = np.ones((rows, width), dtype=bool)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("rd,rd->r", x[start[:, 0]], q)
        done[:, 0] = False
        seen = np.full((rows, n), -1, dtype=np.int16)
        row = np.arange(rows)
        seen[row, ids[:, 0]] = -2
        step = min(STRIDE, width)
        live = row
        while len(live):
            pick = np.argsort(done, axis=1, kind="stable")[:, :step]
            r = np.arange(len(live))[:, None]
            fresh = ~done[r, pick]
            done[r, pick] = True
            near = table[np.where(fresh, ids[r, pick], -1)].reshape(len(live), -1)
            near[np.repeat(~fresh, table.shape[1], axis=1)] = -1
            col = np.broadcast_to(np.arange(near.shape[1], dtype=np.int16), near.shape)
            g = live[:, None]
            ok = (near >= 0) & (seen[g, near] == -1)
            rr, cc = np.nonzero(ok)
            nn = near[rr, cc]
            seen[live[rr], nn] = cc  # of doubles within a step the last one stays
            own = seen[live[rr], nn] == cc
            rr, cc, nn = rr[own], cc[own], nn[own]
            got = np.full(near.shape, -2.0, dtype=np.float32)
            got[rr, cc] = np.einsum("md,md->m", x[nn], q[live[rr]])
            all_sims = np.concatenate([sims, got], 1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_sims, best, 1), axis=1), 1)
            sims = np.take_along_axis(all_sims, best, 1)
            ids = np.take_along_axis(np.concatenate([ids, near], 1), best, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(near.shape, dtype=bool)], 1), best, 1) | (sims < -1.5)
            ended = done.all(axis=1)
            if ended.any():
                out_ids[live[ended]], out_sims[live[ended]] = ids[ended], sims[ended]
                go = ~ended
                live, ids, sims, done = live[go], ids[go], sims[go], done[go]
        return out_ids, out_sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, dtype=np.float32)
        ids, sims = [], []
        for i in range(0, len(q), BATCH):
            part = q[i: i + BATCH]
            a, b = self._beam(part, 0, self._descend(part, 0), beam)
            ids.append(a)
            sims.append(b)
        if not ids:
            return np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32)
        return np.concatenate(ids), np.concatenate(sims)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(df: DataFrame, *, id_col: str = "id", vector_col: str = "dense_embedding", width: int = WIDTH) -> DataFrame:
    """``(id, v)``: one row an id with a usable vector, normalised."""
    v = F.col(vector_col)
    ok = (F.size(v) == width) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("_v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            m /= np.abs(m).max(axis=1, keepdims=True)
            m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), values], names=["id", "v"])

    return rows.mapInArrow(unit, "id long, v binary")


def _units(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, width)


def _copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors under their smallest id, and for each its first ``k + 1`` ids.

    Ids are gathered over salted keys first, cut to ``k + 1`` there, so a vector that
    fills a third of all rows is never in one task.
    """
    # two hashes of 128 bits in all stand for the vector, which itself is carried once
    key = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    salted = vectors.groupBy(*key, F.pmod(F.xxhash64("id"), F.lit(32)).alias("_s")).agg(
        F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.min_by("v", "id").alias("v"))
    one = salted.groupBy("h", "g").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("v").alias("v"))
    one = written(one.select(F.col("ids")[0].alias("id"), "ids", "v"))
    return one.select("id", "v"), one.where(F.size("ids") > 1).select("id", "ids")


def pivots(vectors: DataFrame, shard: int = SHARD, most: int = MAX_PIVOTS, width: int = WIDTH) -> np.ndarray:
    """A bounded sample of the vectors, by hash of their ids: at most ``most`` rows."""
    count = max(1, min(most, round(vectors.count() / shard)))
    rows = vectors.orderBy(F.xxhash64(F.col("id"), F.lit(11)), "id").limit(count).select("v").collect()
    return np.frombuffer(b"".join(r["v"] for r in rows), dtype=np.float32).reshape(-1, width)


def routed(vectors: DataFrame, centres: np.ndarray, routes: int = ROUTES, width: int = WIDTH) -> DataFrame:
    """``(shard, owner, id, v)``: each vector in its own shard, and as a query in the next nearest ones."""
    m = min(routes, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _units(b.column("v"), width)
            s = x @ centres.T
            near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(centres) else np.tile(np.arange(m), (len(x), 1))
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
            take = pa.array(np.repeat(np.arange(len(x)), m))
            owner = np.tile(np.arange(m) == 0, len(x))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(owner), b.column("id").take(take), b.column("v").take(take)],
                                             names=["shard", "owner", "id", "v"])

    return vectors.mapInArrow(run, "shard int, owner boolean, id long, v binary")


def split(routed_rows: DataFrame, limit: int = SPLIT) -> DataFrame:
    """``(shard, sub, owner, id, v)``: shards over the limit in parts; a vector owns a place in one part and is a guest of the others."""
    sizes = routed_rows.where("owner").groupBy("shard").agg(F.ceil(F.count("*") / limit).cast("int").alias("_subs"))
    rows = routed_rows.join(sizes, "shard").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_subs"))).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)))
    return rows.select("shard", "sub", (F.col("owner") & (F.col("_own") == F.col("sub"))).alias("owner"), "id", "v")


_GRAPH = "shard int, sub int, ids binary, x binary, level binary, layers array<binary>, met_a binary, met_b binary"
_PAIR = "a long, b long, cos double"


def built(rows: DataFrame, parts: int, *, least: float = COSINE, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """The stored graphs, one row a shard's part: ids, vectors, neighbour arrays, and the pairs of rows met on the way."""

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        ids, x = t.column("id").to_numpy()[order], _units(t.column("v"), width)[order]
        g = Graph(x, beam=beam).build(report=least - _SLACK)
        met = [np.concatenate([p[i] for p in g.pairs]).astype("<i4") if g.pairs else np.zeros(0, "<i4") for i in (0, 1)]
        level, layers = g.arrays()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "x": [x.tobytes()], "level": [level],
                         "layers": pa.array([layers], pa.list_(pa.binary())), "met_a": [met[0].tobytes()], "met_b": [met[1].tobytes()]})

    # as many partitions as shards: a task gets a shard or a few, however many there are
    return written(rows.where("owner").select("shard", "sub", "id", "v").repartition(parts, "shard", "sub").groupBy("shard", "sub").applyInArrow(build, _GRAPH))


def searched(graphs: DataFrame, guests: DataFrame, parts: int, *, least: float = COSINE, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """``(a, b, cos)``, a < b: pairs met while the stored graphs were built, and those of guests ``(shard, sub, id, v)`` with their rows."""

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, cos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]

        def add(i, j, x, y):
            x, y = x.astype(np.float64), y.astype(np.float64)
            a.append(np.minimum(i, j)), b.append(np.maximum(i, j))
            cos.append(np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), 6))

        for r in right.to_pylist():
            ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["x"], np.float32).reshape(-1, width)
            p, q = np.frombuffer(r["met_a"], "<i4"), np.frombuffer(r["met_b"], "<i4")
            add(ids[p], ids[q], x[p], x[q])
            if left.num_rows:
                others, xg = left.column("id").to_numpy(), _units(left.column("v"), width)
                found, sims = Graph.stored(x, r["level"], r["layers"], beam=beam).search(xg, beam)
                i, j = np.nonzero(sims >= least - _SLACK)
                add(others[i], ids[found[i, j]], xg[i], x[found[i, j]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "cos": np.concatenate(cos)})

    left = guests.repartition(parts, "shard", "sub").groupBy("shard", "sub")
    pairs = left.cogroup(graphs.repartition(parts, "shard", "sub").groupBy("shard", "sub")).applyInArrow(search, _PAIR)
    return pairs.where(f"cos >= {least} and a <> b").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def similar_pairs(vectors: DataFrame, centres: np.ndarray, *, least: float = COSINE, beam: int = BEAM, routes: int = ROUTES, width: int = WIDTH, limit: int = SPLIT) -> DataFrame:
    """``(a, b, cos)``, a < b: distinct vectors' pairs of at least ``least`` met in the shards' graphs."""
    rows, parts = split(routed(vectors, centres, routes, width), limit), max(1, len(centres))
    graphs = built(rows, parts, least=least, beam=beam, width=width)
    return searched(graphs, rows.where("not owner").select("shard", "sub", "id", "v"), parts, least=least, beam=beam, width=width)


def mutual(pairs: DataFrame, copies: DataFrame, k: int = K) -> DataFrame:
    """``(id_a, id_b)`` of pairs in which each is among the other's ``k`` most similar."""
    p = pairs.join(copies.select(F.col("id").alias("a"), F.col("ids").alias("_as")), "a", "left").join(
        copies.select(F.col("id").alias("b"), F.col("ids").alias("_bs")), "b", "left")
    p = p.select(F.explode(F.coalesce("_as", F.array("a"))).alias("a"), F.col("_bs"), "b", "cos").select("a", F.explode(F.coalesce("_bs", F.array("b"))).alias("b"), "cos")
    same = copies.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b"), F.lit(1.0).alias("cos")).where("a < b")
    links = p.unionByName(same)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    best = both.withColumn("_rn", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cos").desc(), "b"))).where(f"_rn <= {k}")
    return best.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).groupBy("id_a", "id_b").count().where("count = 2").drop("count")


def similar(df: DataFrame, **options) -> DataFrame:
    vectors, copies = _copies(usable(df, **options), K)
    return mutual(similar_pairs(vectors, pivots(vectors)), copies)


def found(spark: SparkSession, d: str) -> DataFrame:
    return similar(table(spark, d, "chunks").where("hierarchy = 'child' and is_search"))


def recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against exact search, for every vector whose id is divisible by 100.

    The stated query set is compared with all rows, block by block.
    """
    df = table(spark, d, "chunks").where("hierarchy = 'child' and is_search")
    vectors, _ = _copies(usable(df), K)
    pairs = written(similar_pairs(vectors, pivots(vectors)))
    queries = vectors.where("id % 100 = 0").withColumn("block", F.expr("id div 100 % 64"))

    def exact(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _units(left.column("v"), WIDTH), _units(right.column("v"), WIDTH)
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        a, b = [], []
        for i in range(0, len(x), 256):
            r, c = np.nonzero(x[i: i + 256] @ y.T >= COSINE)
            a.append(ids[i + r]), b.append(others[c])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        keep = a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    cells = vectors.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    spread = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("cell", "id", "v")
    truth = spread.groupBy("cell").cogroup(cells.select("cell", "id", "v").groupBy("cell")).applyInArrow(exact, "a long, b long").distinct()
    joined = truth.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return joined.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"), F.round(F.expr("try_divide(count(hit), count(*))"), 4).alias("recall"))


QUERIES = {"p5_found": found, "p5_recall": recall}
