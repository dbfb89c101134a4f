"""The most similar vectors of every vector (problem 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import cut, drop

#: Bound of the sample that centroids are fitted on, and of their number.
SAMPLE_ROWS, MOST_LISTS = 65_536, 16_384
#: Lists per square root of the number of vectors; lists that a query probes; groups that it visits.
LISTS_PER_ROOT, PROBES, GROUPS = 1.6, 32, 3
#: Lists of a group, rows of a block of a group.
GROUP_LISTS, BLOCK_ROWS = 48, 65_536
#: Rows of one vector that are answered in one task.
HOT_ROWS = 100_000
#: Columns of a block of the rotated vectors.
COLUMNS = 16
#: Normal quantile of the test that abandons a candidate: about one in a hundred of
#: the neighbours that lie right at the edge of a query's present neighbourhood is lost per test.
QUANTILE = 2.33


class Index:
    """Rotation, centroids and their groups; fitted on a bounded sample, applied to every row."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        lists = int(min(MOST_LISTS, max(1, LISTS_PER_ROOT * rows**0.5), len(sample)))
        self.centroids = self._means(sample, lists, rng)
        held = np.bincount(self.nearest(sample), minlength=len(self.centroids))
        self.group = np.full(len(self.centroids), -1, np.int32)
        self._halve(np.arange(len(self.centroids)), held + 1)

    @staticmethod
    def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            at = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
            by = np.argsort(at, kind="stable")
            held, first = np.unique(at[by], return_index=True)
            sums = np.add.reduceat(x[by], first, axis=0)
            c[held] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return c

    def _halve(self, members: np.ndarray, held: np.ndarray) -> None:
        """Centroids into groups of like ones, of about equal numbers of rows."""
        if len(members) <= GROUP_LISTS:
            self.group[members] = self.group.max() + 1
            return
        c = self.centroids[members] - self.centroids[members].mean(0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        members = members[np.argsort(c @ axis, kind="stable")]
        middle = int(np.searchsorted(np.cumsum(held[members]), held[members].sum() / 2)) + 1
        middle = min(max(middle, 1), len(members) - 1)
        self._halve(members[:middle], held)
        self._halve(members[middle:], held)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(unit[i : i + 8192] @ self.centroids.T, axis=1) for i in range(0, len(unit), 8192)]) if len(unit) else np.empty(0, np.int64)

    def probes(self, unit: np.ndarray, probes: int, groups: int) -> np.ndarray:
        """Lists that each row probes, nearest first; -1 beyond those of its nearest groups."""
        score = unit @ self.centroids.T
        k = min(probes, score.shape[1])
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1), 1)
        group = self.group[top]
        first = np.ones_like(group, bool)
        for j in range(1, k):
            first[:, j] = (group[:, :j] != group[:, j : j + 1]).all(axis=1)
        nth = np.cumsum(first, axis=1)  # of the group where it first occurs
        place = np.zeros_like(nth)
        for j in range(k):
            same = (group[:, : j + 1] == group[:, j : j + 1]) & first[:, : j + 1]
            place[:, j] = np.where(same, nth[:, : j + 1], 0).max(axis=1)
        return np.where(place <= groups, top, -1)


class Scan:
    """Adaptive dimension scan of one block of a group."""

    def __init__(self, index: Index, vectors: np.ndarray, lists: np.ndarray, ids: list[list[int]], k: int):
        by = np.argsort(lists, kind="stable")
        self.index, self.k, self.ids = index, k, [ids[i] for i in by]
        self.raw = vectors[by]
        self.lists, first = np.unique(lists[by], return_index=True)
        self.bounds = np.append(first, len(by))
        turned = (_unit(self.raw) @ index.rotation).astype(np.float32)
        self.dim = turned.shape[1]
        self.columns = [(a, min(a + COLUMNS, self.dim)) for a in range(0, self.dim, COLUMNS)]
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.columns]
        self.norms = [np.einsum("ij,ij->i", x, x) for x in self.blocks]

    def _partial(self, q: np.ndarray, j: int, at: slice) -> np.ndarray:
        """Squared distances within block of columns j, of queries to the rows ``at``."""
        a, b = self.columns[j]
        part = q[:, a:b]
        return np.einsum("ij,ij->i", part, part)[:, None] + self.norms[j][at] - 2 * (part @ self.blocks[j][at].T)

    def _edge(self, seen: int, tau: np.ndarray) -> np.ndarray:
        """Partial squared distance beyond which a candidate of a query is given up.

        The rotation is random, so a part of the columns holds its share of a squared
        distance but for a spread known from the number of columns.
        """
        if seen == self.dim:
            return tau
        share = seen / self.dim
        return tau * share * (1 + QUANTILE * np.sqrt(2 / seen * (1 - share)))

    def search(self, vectors: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the k nearest rows found for each query, as by its probed lists."""
        q = (_unit(vectors) @ self.index.rotation).astype(np.float32)
        n = len(q)
        local = np.searchsorted(self.lists, probes)
        local = np.where((local < len(self.lists)) & (self.lists[np.minimum(local, len(self.lists) - 1)] == probes), local, -1)
        tau = np.full(n, np.inf, np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        has = local >= 0
        home = np.where(has.any(axis=1), local[np.arange(n), has.argmax(axis=1)], -1)
        for at_home in (True, False):
            for x in range(len(self.lists)):
                asks = np.flatnonzero(home == x) if at_home else np.flatnonzero((local == x).any(axis=1) & (home != x))
                rows = slice(self.bounds[x], self.bounds[x + 1])
                size = rows.stop - rows.start
                step = max(1, 4_000_000 // max(1, size))
                for i in range(0, len(asks), step):
                    some = asks[i : i + step]
                    if at_home:
                        d = sum(self._partial(q[some], j, rows) for j in range(len(self.columns)))
                        k = min(self.k, size)
                        top = np.argpartition(d, k - 1, axis=1)[:, :k]
                        near = np.take_along_axis(d, top, 1)
                        if size >= self.k:
                            tau[some] = near.max(axis=1) * (1 + 1e-5) + 1e-6
                        found.append((np.repeat(some, k), (top + rows.start).ravel(), near.ravel()))
                    else:
                        found.append(self._adaptive(q, some, rows, tau))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, row, d = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((row, d, who))
        who, row = who[by], row[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        return who[keep], row[keep]

    def _adaptive(self, q: np.ndarray, some: np.ndarray, rows: slice, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, dense, seen, j = tau[some], None, 0, 0
        while j < len(self.columns):  # whole blocks, as long as much is left
            part = self._partial(q[some], j, rows)
            dense = part if dense is None else dense + part
            seen, j = self.columns[j][1], j + 1
            alive = dense < self._edge(seen, t)[:, None]
            if np.count_nonzero(alive) * 8 < alive.size:
                break
        who, row = np.nonzero(alive)
        d = dense[who, row]
        while j < len(self.columns) and len(who):  # only what is left
            a, b = self.columns[j]
            gap = q[some[who], a:b] - self.blocks[j][row + rows.start]
            d = d + np.einsum("ij,ij->i", gap, gap)
            seen, j = b, j + 1
            left = d < self._edge(seen, t[who])
            who, row, d = who[left], row[left], d[left]
        return some[who], row + rows.start, d


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # a scale first, so that neither tiny nor huge values are lost in their squares
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def nearest_neighbours(
    df: DataFrame, id_col: str = "item_id", vector_col: str = "embedding", k: int = 5, dim: int = 64, probes: int = PROBES, groups: int = GROUPS,
) -> DataFrame:
    """(``id_col``, ``rank``, ``neighbour_id``, ``similarity``): the k rows of nearest cosine of every row.

    Method: adaptive dimension scan.  Vectors are put into lists by their nearest
    centroid, and lists into groups of like ones.  A query visits its nearest groups and
    scans its nearest lists there: the first in full, which bounds its neighbourhood;
    in the others the randomly rotated vectors are compared by blocks of columns, and
    a candidate is abandoned as soon as a test on its partial distance says that it
    lies outside.  What is found gets its cosine in double precision.

    Centroids are fitted on a sample of at most SAMPLE_ROWS rows; every row is indexed.
    Equal vectors are one entry that carries its k+1 smallest ids, so a vector held by
    a third of all rows is compared once.  A group is held in blocks of BLOCK_ROWS
    rows, queries are streamed past them.

    Defined results: rows whose vector is null, of another length, all zero or not
    finite, or whose id is null, take no part.  Ties go to the smaller id, repeated
    rows count each for itself, and fewer than k other rows give fewer neighbours.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    entry = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("vec", T.BinaryType())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat = part.column(1).flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim) + np.float32(0)  # no negative zeros
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
            vec = [x[i].tobytes() for i in good]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(pa.array(good)), pa.array(vec, pa.binary())], names=entry.names)

    rows = cut(base.mapInArrow(read, entry), "vectors")
    # of equal vectors the k+1 smallest ids: a limit of each group that is applied before anything is moved
    by_id = Window.partitionBy("key").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
    classes = cut(first.groupBy("key").agg(F.any_value("vec").alias("vec"), F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids")), "classes")
    with_vectors, rows = rows, cut(rows.select("key", "id"), "members")
    drop(with_vectors)
    count = classes.count()
    out = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("neighbour_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    if not count:
        return spark.createDataFrame([], out)
    sample = classes.orderBy("key").select("vec").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()  # keys are hashes
    index = Index(_unit(_vectors(sample, dim)).astype(np.float32), count)

    routed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("asks", T.BooleanType()), *classes.schema, T.StructField("lists", T.BinaryType())])
    sizes = {r[0]: r[1] for r in _home_sizes(classes, index, dim).collect()}  # one row per group of the bounded index
    blocks = np.ones(int(index.group.max()) + 1, np.int64)
    for g, n in sizes.items():
        blocks[g] = -(-n // BLOCK_ROWS)
    before = np.concatenate([[0], np.cumsum(blocks)[:-1]])

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                lists = index.probes(_unit(_vectors(some.column(1), dim)).astype(np.float32), probes, groups).astype(np.int32)
                home = index.group[lists[:, 0]]
                n = len(home)
                salt = np.frombuffer(b"".join(some.column(0).to_pylist()), np.uint64)[::2]
                row, cell, block, asks, held = [np.arange(n)], [home], [(salt % blocks[home].astype(np.uint64)).astype(np.int64)], [np.zeros(n, bool)], [x.tobytes() for x in lists[:, :1]]
                group = np.where(lists >= 0, index.group[lists], -1)
                for i in range(n):
                    for g in dict.fromkeys(group[i].tolist()):
                        if g >= 0:
                            own = lists[i][group[i] == g].tobytes()
                            for b in range(blocks[g]):
                                row.append([i]), cell.append([g]), block.append([b]), asks.append([True]), held.append(own)
                take = pa.array(np.concatenate(row))
                cells, parts_ = np.concatenate(cell).astype(np.int32), np.concatenate(block).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(parts_), pa.array((before[cells] + parts_).astype(np.int32)), pa.array(np.concatenate(asks)), *(some.column(c).take(take) for c in range(3)), pa.array(held, pa.binary())],
                    names=routed.names,
                )

    near = T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("id", T.LongType())]))
    answered = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("near", near)])

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, scan = None, [], None
        for part in parts:
            cells = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            edges = np.flatnonzero((np.diff(cells, axis=0, prepend=-1) != 0).any(axis=1))
            for a, b in zip(edges, np.append(edges[1:], len(cells))):
                own = part.slice(a, b - a)
                if (at := tuple(cells[a, :2])) != now:
                    now, held, scan = at, [], None
                if not cells[a, 2]:
                    held.append(own)
                    continue
                if scan is None and held:
                    vectors = np.concatenate([_vectors(h.column(4), dim) for h in held])
                    lists = np.concatenate([np.frombuffer(b"".join(h.column(6).to_pylist()), np.int32) for h in held])
                    scan = Scan(index, vectors, lists, [i for h in held for i in h.column(5).to_pylist()], k + 1)
                    held = []
                if scan is not None:
                    yield _answers(scan, own, dim, k, answered)

    spread = classes.mapInArrow(route, routed)
    width = max(1, int(blocks.sum()))
    # a task for each block of a group, as groups are of about equal numbers of rows
    stream = spread.repartitionById(width, "task").drop("task").sortWithinPartitions("cell", "block", "asks")
    merged = stream.mapInArrow(answer, answered).groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    # vectors of very many rows are answered in several tasks
    hot = rows.groupBy("key").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("copies")).filter("copies > 1")
    hot = cut(hot, "hot")  # a row for HOT_ROWS rows at most
    copies = F.coalesce("copies", F.lit(1))
    members = rows.select("key", "id").join(hot, "key", "left").select("key", "id", F.pmod(F.xxhash64("id"), copies).cast("int").alias("copy"))
    merged = merged.join(hot, "key", "left").select("key", "near", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    members = members.join(merged, ["key", "copy"])
    others = members.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("rank", "x"))
    return others.select(F.col("id").alias(id_col), (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbour_id"), (-F.col("x.far")).alias("similarity"))


def _home_sizes(classes: DataFrame, index: Index, dim: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(index.group.max()) + 1, np.int64)
        for part in parts:
            home = index.group[index.nearest(_unit(_vectors(part.column(0), dim)).astype(np.float32))]
            total += np.bincount(home, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["cell", "n"])

    return classes.select("vec").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _answers(scan: Scan, asked: pa.RecordBatch, dim: int, k: int, schema: T.StructType) -> pa.RecordBatch:
    vectors = _vectors(asked.column(4), dim)
    held = [np.frombuffer(x, np.int32) for x in asked.column(6).to_pylist()]
    probes = np.full((len(held), max(map(len, held))), -1, np.int64)
    for i, x in enumerate(held):
        probes[i, : len(x)] = x
    who, row = scan.search(vectors, probes)
    a, b = vectors[who].astype(np.float64), scan.raw[row].astype(np.float64)
    cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    ids = [scan.ids[r] for r in row.tolist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    who, far = np.repeat(who, size), np.repeat(-cosine, size)
    ids = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
    by = np.lexsort((ids, far, who))
    who, far, ids = who[by], far[by], ids[by]
    keep = np.arange(len(who)) - np.searchsorted(who, who) <= k
    who, far, ids = who[keep], far[keep], ids[keep]
    bounds = np.searchsorted(who, np.arange(len(held) + 1)).astype(np.int32)
    near = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(far), pa.array(ids)], names=["far", "id"]))
    return pa.RecordBatch.from_arrays([asked.column(3), near], names=schema.names)


def neighbour_pairs(df: DataFrame, **how) -> DataFrame:
    """(``item_a``, ``item_b``), item_a < item_b: pairs where one is among the nearest of the other."""
    near = nearest_neighbours(df, **how)
    one = near.columns[0]
    return near.select(F.least(one, "neighbour_id").alias("item_a"), F.greatest(one, "neighbour_id").alias("item_b")).distinct()
