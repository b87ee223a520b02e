"""Nearest rows of a stated query set against all rows, in blocks.

The queries are sent out a block of fixed size at a time; every task keeps the k nearest of its own rows for each query and
only those are shuffled. Nothing is paired across the cluster.

Where the queries grow with the rows, nearest_in_cells() gives the same rows from cells of space instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.plans.physical import materialize

QUERIES_PER_BLOCK = 4096
CELLS = 2_000_000
OUT = "qid bigint, rid bigint, dist double"

#: Distinct places that a cell of nearest_in_cells() holds, cells that are cut at most, places drawn for each to find the cuts, and
#: places that are compared one by one inside a cell.
CELL_PLACES, MOST_CELLS, DRAWN, LEAF_PLACES = 4096, 4096, 32, 128


def _numbers(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([np.asarray(batch.column(first + i).to_numpy(zero_copy_only=False), np.float64) for i in range(n)])


#: Stands for a missing label among the 64-bit hashes of labels.
NO_LABEL = np.iinfo(np.int64).min


def _labels(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    cols = [batch.column(first + i).fill_null(NO_LABEL).to_numpy(zero_copy_only=False) for i in range(n)]
    return np.column_stack(cols) if cols else np.zeros((batch.num_rows, 0), np.int64)


def distances(qx: np.ndarray, qt: np.ndarray, x: np.ndarray, t: np.ndarray, by_dims: bool) -> np.ndarray:
    """Queries by rows: root of the sum of squared differences, an unequal label counting 1; dimensions missing on a side are left out. Labels are
    64-bit hashes."""
    total, dims = np.zeros((len(qx), len(x))), np.zeros((len(qx), len(x)))
    for j in range(qx.shape[1]):
        d = qx[:, j, None] - x[None, :, j]
        there = ~np.isnan(d)
        total += np.where(there, d, 0.0) ** 2
        dims += there
    for j in range(qt.shape[1]):
        a, b = qt[:, j], t[:, j]
        there = (a != NO_LABEL)[:, None] & (b != NO_LABEL)[None, :]
        total += there & (a[:, None] != b[None, :])
        dims += there
    return np.where(dims > 0, np.sqrt(total / np.maximum(dims, 1) if by_dims else total), np.inf)


def nearest_rows(queries: DataFrame, rows: DataFrame, qid: str, rid: str, numbers: list[str], labels: list[str], scale: list[float], k: int, by_dims: bool = False, group: str | None = None, exclude_self: bool = False, vector: str | None = None, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(qid, rid, dist, rank): the k nearest rows of each query, ties by rid. numbers are divided by `scale`; `vector` names an array
    column used instead. With `group` only rows of the query's group count; rows of the query's own id are left out on request.
    Rows with no dimension in common are infinitely far and left out."""
    def mark(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return F.when(v.isNotNull(), F.xxhash64(v))

    def shape(d: DataFrame, i: str) -> DataFrame:
        nums = [F.col(f"`{vector}`").cast("array<double>").alias("v")] if vector else [(F.col(f"`{c}`").cast("double") / F.lit(s)).alias(f"x{j}") for j, (c, s) in enumerate(zip(numbers, scale))]
        return d.select(F.col(f"`{i}`").cast("bigint").alias("id"), (mark(group) if group else F.lit(0).cast("bigint")).alias("g"), *nums, *[mark(c).alias(f"t{j}") for j, c in enumerate(labels)]).where(F.col("id").isNotNull())

    def arrays(b: pa.RecordBatch) -> tuple:
        ids, g = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64), b.column(1).fill_null(NO_LABEL).to_numpy(zero_copy_only=False)
        if vector:
            x = np.array([v if v is not None else np.nan for v in b.column(2).to_pylist()], np.float64).reshape(b.num_rows, -1)
            return ids, g, x, _labels(b, 3, len(labels))
        return ids, g, _numbers(b, 2, len(numbers)), _labels(b, 2 + len(numbers), len(labels))

    asked, all_rows = shape(queries, qid), shape(rows, rid)
    blocks = max(1, -(-asked.count() // per_block))
    spark = rows.sparkSession

    def search(block: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asked
        sent = spark.sparkContext.broadcast(part.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value.combine_chunks()
            held = table.to_batches()
            if not held:
                return
            q, qg, qx, qt = arrays(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            best_d, best_r = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            step = max(1, CELLS // max(1, len(q)))
            for b in batches:
                ids, g, x, t = arrays(b)
                for a in range(0, len(ids), step):
                    s = slice(a, a + step)
                    d = distances(qx, qt, x[s], t[s], by_dims)
                    if group:
                        d[qg[:, None] != g[s][None, :]] = np.inf
                    if exclude_self:
                        d[q[:, None] == ids[s][None, :]] = np.inf
                    d, r = np.concatenate([best_d, d], 1), np.concatenate([best_r, np.broadcast_to(ids[s], d.shape)], 1)
                    near = np.lexsort((r, d), axis=-1)[:, :k]
                    best_d, best_r = np.take_along_axis(d, near, 1), np.take_along_axis(r, near, 1)
            keep = np.isfinite(best_d).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[keep]), pa.array(best_r.ravel()[keep]), pa.array(best_d.ravel()[keep])], names=["qid", "rid", "dist"])

        return all_rows.mapInArrow(run, OUT)

    found = reduce(DataFrame.unionByName, map(search, range(blocks)))
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tomek_links(queries: DataFrame, rows: DataFrame, rid: str, label: str, vector: str) -> DataFrame:
    """(a, b): query row and its nearest row, each the other's nearest, of different labels."""
    near = nearest_rows(queries, rows, rid, rid, [], [], [], 1, exclude_self=True, vector=vector).select(F.col("qid").alias("a"), F.col("rid").alias("b"))
    other = rows.join(near.select(F.col("b").alias(rid)).distinct(), rid, "left_semi")
    back = nearest_rows(other, rows, rid, rid, [], [], [], 1, exclude_self=True, vector=vector).select(F.col("qid").alias("b"), F.col("rid").alias("a"))
    return _links(near, back, rows, rid, label)


def all_tomek_links(rows: DataFrame, rid: str, label: str, vector: str) -> DataFrame:
    """tomek_links() of all rows: each link is found from both sides. Every row is searched once, in cells."""
    near = materialize(nearest_in_cells(rows, rows, rid, rid, vector, 1).select(F.col("qid").alias("a"), F.col("rid").alias("b")), "nearest")
    return _links(near, near.select(F.col("a").alias("b"), F.col("b").alias("a")), rows, rid, label)


def _links(near: DataFrame, back: DataFrame, rows: DataFrame, rid: str, label: str) -> DataFrame:
    lab = rows.select(F.col(rid).alias("id"), F.col(label).alias("lab"))
    pairs = near.join(back, ["a", "b"])
    named = pairs.join(lab.select(F.col("id").alias("a"), F.col("lab").alias("la")), "a").join(lab.select(F.col("id").alias("b"), F.col("lab").alias("lb")), "b")
    return named.where(F.col("la") != F.col("lb")).select("a", "b")


class Cells:
    """Space cut in two again and again near the median of the widest dimension, until a part has at most `most` of the points `x`. The
    parts are boxes that cover all of space, so a row that is not in `x` has one, too; only dimensions where `cut` holds are cut."""

    def __init__(self, x: np.ndarray, most: int, cut: np.ndarray) -> None:
        self.dim, self.at, self.below, self.above, self.cell, self.box, self.count = [], [], [], [], [], [], 0
        x = np.where(cut, x, 0.0)
        todo = [(np.arange(len(x)), np.full((2, x.shape[1]), [[-np.inf], [np.inf]]), None)]
        while todo:
            i, box, parent = todo.pop()
            node = len(self.dim)
            if parent:
                parent[0][parent[1]] = node
            j, at = self._cut(x[i]) if len(i) > most else (-1, 0.0)
            for a, v in ((self.dim, j), (self.at, at), (self.below, -1), (self.above, -1), (self.cell, -1), (self.box, box)):
                a.append(v)
            if j < 0:
                self.cell[node] = self.count
                self.count += 1
                continue
            low, high = box.copy(), box.copy()
            low[1, j] = high[0, j] = at
            under = x[i, j] < at
            todo += [(i[under], low, (self.below, node)), (i[~under], high, (self.above, node))]

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[int, float]:
        """The dimension and where to cut it, so that points lie on both sides; -1 where all are at one place."""
        spread = x.max(0) / 2 - x.min(0) / 2
        if not spread.size or not spread.max() > 0:
            return -1, 0.0
        j = int(spread.argmax())
        v = np.sort(x[:, j])
        m = np.searchsorted(v, v[len(v) // 2]) or np.searchsorted(v, v[0], "right")
        at = v[m - 1] / 2 + v[m] / 2
        return j, float(at if v[m - 1] < at <= v[m] else v[m])

    def home(self, q: np.ndarray) -> np.ndarray:
        """The cell of each query."""
        out, todo = np.zeros(len(q), np.int64), [(0, np.arange(len(q)))]
        while todo:
            node, i = todo.pop()
            if self.dim[node] < 0:
                out[i] = self.cell[node]
                continue
            under = q[i, self.dim[node]] < self.at[node]
            todo += [(n, part) for n, part in ((self.below[node], i[under]), (self.above[node], i[~under])) if len(part)]
        return out

    def within(self, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, queries) where the cell is no farther from the query than its bound. The gap to a box is rounded step by step like
        distances(), so it is never above the distance of a row in the box; a dimension that the query lacks has no gap."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, i = todo.pop()
            if self.dim[node] < 0:
                yield self.cell[node], i
                continue
            for n in (self.below[node], self.above[node]):
                total = np.zeros(len(i))
                for j in range(q.shape[1]):
                    with np.errstate(invalid="ignore", over="ignore"):
                        total += np.fmax(np.fmax(self.box[n][0, j] - q[i, j], q[i, j] - self.box[n][1, j]), 0.0) ** 2
                part = i[np.sqrt(total) <= bound[i]]
                if len(part):
                    todo.append((n, part))


class Held:
    """The places of one cell, `counts` ids at each, and the `k` nearest of these rows."""

    def __init__(self, x: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.k, self.cells = k, Cells(x, LEAF_PLACES, np.isfinite(x).all(0))
        order = np.argsort(ids, kind="stable")
        owner, ids = np.repeat(np.arange(len(x)), counts)[order], ids[order]
        leaf = self.cells.home(x)[owner]
        by_leaf = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[by_leaf], np.arange(1, self.cells.count))
        self.leaves = [(x[owner[i]], ids[i]) for i in np.split(by_leaf, ends)]

    def _compare(self, q: np.ndarray, i: np.ndarray, leaf: int, best_d: np.ndarray, best_r: np.ndarray) -> None:
        x, ids = self.leaves[leaf]
        step = max(1, CELLS // len(x))
        for a in range(0, len(i), step):
            p = i[a : a + step]
            with np.errstate(invalid="ignore", over="ignore"):
                d = distances(q[p], np.zeros((len(p), 0), np.int64), x, np.zeros((len(x), 0), np.int64), False)
            first = np.argsort(d, axis=1, kind="stable")[:, : self.k]
            d, r = np.concatenate([best_d[p], np.take_along_axis(d, first, 1)], 1), np.concatenate([best_r[p], ids[first]], 1)
            near = np.lexsort((r, d), axis=-1)[:, : self.k]
            best_d[p], best_r[p] = np.take_along_axis(d, near, 1), np.take_along_axis(r, near, 1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids, queries by k, infinite where there are fewer."""
        best_d, best_r = np.full((len(q), self.k), np.inf), np.full((len(q), self.k), np.iinfo(np.int64).max)
        home = self.cells.home(q)
        for leaf in np.unique(home):
            self._compare(q, np.flatnonzero(home == leaf), leaf, best_d, best_r)
        for leaf, i in self.cells.within(q, best_d[:, -1].copy()):
            i = i[home[i] != leaf]
            if len(i):
                self._compare(q, i, leaf, best_d, best_r)
        return best_d, best_r


def _meet(a: str, b: str) -> bool:
    """Whether rows with these kinds of dimensions (finite, missing, infinite) can be at a finite distance."""
    both = [(i, j) for i, j in zip(a, b) if "n" not in (i, j) and (i != j or i == "0")]
    return bool(both) and all(i == j for i, j in both)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def _alike(keys: list) -> dict:
    found: dict = {}
    for i, key in enumerate(keys):
        found.setdefault(key, []).append(i)
    return {key: np.array(i) for key, i in found.items()}


DEALT = "cell string, asked boolean, g bigint, v array<double>, ids array<bigint>"
NEAR = "g bigint, v array<double>, near array<struct<dist:double,rid:bigint>>"


def nearest_in_cells(queries: DataFrame, rows: DataFrame, qid: str, rid: str, vector: str, k: int, group: str | None = None) -> DataFrame:
    """(qid, rid, dist, rank) of nearest_rows() with `vector` and exclude_self, for any number of queries; `rid` must tell rows apart.

    Queries of one place (group and vector) have the same neighbours but for themselves, so places are searched, for k + 1 rows, and a
    place need only hold its k + 1 rows of least id. Places are dealt to cells cut at sampled medians, apart for each group and each set
    of missing dimensions. A place is compared with its own cell, then with the cells no farther than the nearest rows found there: the
    result is exact wherever the cuts fall. The work grows like the rows while vectors are short; in many dimensions most cells are near.
    """
    spark, most = rows.sparkSession, k + 1

    def shape(d: DataFrame, i: str) -> DataFrame:
        g = F.when(F.col(f"`{group}`").isNotNull(), F.xxhash64(F.col(f"`{group}`").cast("string"))).otherwise(NO_LABEL) if group else F.lit(0).cast("bigint")
        v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))) + 0.0)
        return d.select(F.col(f"`{i}`").cast("bigint").alias("id"), g.alias("g"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def with_kinds(d: DataFrame, name: str) -> DataFrame:
        kind = F.transform("v", lambda x: F.when(F.isnan(x), "n").when(x == float("inf"), "+").when(x == float("-inf"), "-").otherwise("0"))
        return d.withColumn(name, F.array_join(kind, ""))

    asked, all_rows = shape(queries, qid), shape(rows, rid)
    least = all_rows.withColumn("place", F.row_number().over(Window.partitionBy("g", "v").orderBy("id"))).where(F.col("place") <= most)
    places = materialize(with_kinds(least.groupBy("g", "v").agg(F.collect_list("id").alias("ids")), "kinds"), "places")
    sought = with_kinds(places.select("g", "v") if queries is rows else materialize(asked.select("g", "v").distinct(), "sought"), "own")
    sizes = places.groupBy("g", "kinds").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    size = max(CELL_PLACES, -(-total.n // MOST_CELLS))
    large = sizes.where(F.col("n") > size).select("g", "kinds")
    drawn = places.join(large, ["g", "kinds"], "left_semi").sample(DRAWN / size, seed=7).select("g", "kinds", "v").toArrow().combine_chunks()
    forest: dict[tuple[int, str], Cells] = {}
    for (g, kinds), i in _alike(list(zip(drawn.column("g").to_pylist(), drawn.column("kinds").to_pylist()))).items():
        forest[g, kinds] = Cells(_matrix(drawn.column("v").combine_chunks().take(pa.array(i))), DRAWN, np.array([c == "0" for c in kinds]))
    sent = spark.sparkContext.broadcast(forest)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total.groups - len(forest) + sum(c.count for c in forest.values())))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and queries to their own cell; queries with a bound to the others within it."""
        for b in batches:
            names = set(b.schema.names)
            x = _matrix(b.column("v")) if b.num_rows else np.zeros((0, 0))
            own = b.column("own").to_pylist() if "own" in names else None
            for (g, kinds), i in _alike(list(zip(b.column("g").to_pylist(), b.column("kinds").to_pylist()))).items():
                if own:
                    meet = {o: _meet(o, kinds) for o in {own[j] for j in i}}
                    i = i[[meet[own[j]] for j in i]]
                cells = sent.value.get((g, kinds))
                home = cells.home(x[i]) if cells else np.zeros(len(i), np.int64)
                if "bound" not in names:
                    to = [(i, home)]
                elif cells:
                    found = [(c, j[home[j] != c]) for c, j in cells.within(x[i], b.column("bound").to_numpy(zero_copy_only=False)[i])]
                    to = [(i[j], np.full(len(j), c)) for c, j in found]
                else:
                    to = []
                for j, c in to:
                    if len(j):
                        at = pa.array(j)
                        ids = pa.nulls(len(j), pa.list_(pa.int64())) if own else b.column("ids").take(at)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{g} {kinds} {n}" for n in c]), pa.array([bool(own)] * len(j)), b.column("g").take(at), b.column("v").take(at), ids], names=["cell", "asked", "g", "v", "ids"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query of a cell; the rows of a cell come before its queries, which pass by in batches."""
        cell, held, parts_of = None, None, []
        for b in batches:
            keys = list(zip(b.column("cell").to_pylist(), b.column("asked").to_pylist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, end in zip(starts, [*starts[1:], len(keys)]):
                if keys[a][0] != cell:
                    cell, held, parts_of = keys[a][0], None, []
                v, ids = b.column("v").slice(a, end - a), b.column("ids").slice(a, end - a)
                if not keys[a][1]:
                    parts_of.append((_matrix(v), np.asarray(ids.value_lengths()), np.asarray(ids.flatten())))
                    continue
                if held is None:
                    held = Held(*[np.concatenate(p) for p in zip(*parts_of)], most)
                    parts_of = []
                d, r = held.nearest(_matrix(v))
                there = np.isfinite(d)
                ends = pa.array(np.concatenate([[0], there.sum(1).cumsum()]).astype(np.int32))
                near = pa.StructArray.from_arrays([pa.array(d[there]), pa.array(r[there])], names=["dist", "rid"])
                yield pa.RecordBatch.from_arrays([b.column("g").slice(a, end - a), v, pa.ListArray.from_arrays(ends, near)], names=["g", "v", "near"])

    def search(q: DataFrame) -> DataFrame:
        both = places.select("g", "kinds", "v", "ids").mapInArrow(deal, DEALT).unionByName(q.mapInArrow(deal, DEALT))
        return both.repartition(parts, "cell").sortWithinPartitions("cell", "asked").mapInArrow(compare, NEAR)

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("g", "v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, most).alias("near"))

    kinds = sizes.select("g", "kinds")
    near = merged(search(sought.join(kinds, "g").select("g", "kinds", "v", "own")))
    if forest:
        near = materialize(near, "near")
        bound = F.when(F.size("near") >= most, F.element_at("near", -1)["dist"]).otherwise(float("inf"))
        far = with_kinds(near.select("g", "v", bound.alias("bound")), "own").join(kinds, "g").select("g", "kinds", "v", "own", "bound")
        near = merged(near.unionByName(search(far)))
    own = F.slice(F.filter("near", lambda r: r["rid"] != F.col("id")), 1, k)
    found = asked.join(near, ["g", "v"]).select(F.col("id").alias("qid"), F.posexplode(own).alias("place", "r"))
    return found.select("qid", F.col("r.rid").alias("rid"), F.col("r.dist").alias("dist"), (F.col("place") + 1).alias("rank"))
