"""Order statistics, quantiles and cumulative counts of whole columns without sorting or shuffling a column.

A column is cut at splitters taken from its own values (approximate quantiles), so that a cell holds about the same share of the
rows whatever the values are: seconds since 1970 are cut as finely as shares between 0 and 1. One scan counts the cells, exactly;
what is asked for is found among those counts, and only the cells that leave it open are read again, value by value. A splitter
that is off costs a larger cell and never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.plans.physical import running_sums

#: Cells a column, and distinct values of open cells (counted before) up to which they are sorted on the driver; beyond, by range on
#: the executors. The result is the same.
CELLS = 1024
GATHERED = 500_000


def melt(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, c, x): one row a present number of `columns`; null and NaN are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    return df.select(*(ids or []), F.explode(cells).alias("e")).select(*(ids or []), "e.c", "e.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def running_counts(long: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(c, x, then for each name its count at x, name_upto including it, name_all of the column) for each distinct value."""
    values = long.groupBy("c", "x").agg(*[F.sum(e).alias(k) for k, e in counts.items()])
    return running_sums(values, ["c"], ["x"], list(counts))


def _of_long(keys: int):
    """(place of the column, values, counts) out of batches of j, x, counts."""
    def feed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        j, x, *w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for c in np.unique(j):
            own = np.flatnonzero(j == c)
            yield int(c), x[own], [e[own] for e in w]

    return feed


def _of_wide(keys: int):
    """The same out of batches of one column a number; with two counts a last column says which side a row is on."""
    def feed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        side = columns.pop().astype(np.int64) if keys == 2 else np.ones(batch.num_rows, np.int64)
        for j, x in enumerate(columns):
            x = np.asarray(x, np.float64)
            there = np.flatnonzero(~np.isnan(x))
            w = side[there]
            yield j, x[there], [w, 1 - w][:keys]

    return feed


class Cells:
    """The counted cells of some columns: per column and cell the counts, least and largest value (NaN where empty).

    Made by of_columns() of one table, of_two() of two (counts a and b), or of_long() of a table (c, x).
    """

    def __init__(self, rows: DataFrame | None, names: list[str], splits: list[np.ndarray], keys: list[str], feed) -> None:
        self.rows, self.names, self.splits, self.keys, self.feed = rows, names, splits, keys, feed
        self.place = {c: j for j, c in enumerate(names)}
        self.n = {k: [np.zeros(len(s) + 1, np.int64) for s in splits] for k in keys}
        self.lo, self.hi = ([np.full(len(s) + 1, np.nan) for s in splits] for _ in range(2))
        if names:
            self._count()

    @classmethod
    def of_long(cls, long: DataFrame, counts: dict[str, Column], cells: int = CELLS) -> Cells:
        shares = [i / cells for i in range(1, cells)]
        heads = long.groupBy("c").agg(F.percentile_approx(F.col("x").cast("double"), shares, 4 * cells).alias("s")).orderBy("c").collect()
        names = [r.c for r in heads]
        place = (F.array_position(F.array(*[F.lit(c) for c in names]), F.col("c")) - 1).cast("int")
        rows = long.select(place.alias("j"), F.col("x").cast("double").alias("x"), *[e.cast("bigint").alias(k) for k, e in counts.items()]) if names else None
        made = cls(rows, names, [np.unique(np.asarray(r.s, np.float64)) for r in heads], list(counts), _of_long(len(counts)))
        made.spark = long.sparkSession
        return made

    @classmethod
    def of_columns(cls, df: DataFrame, columns: list[str], cells: int = CELLS, side: Column | None = None, stable: bool = False) -> Cells:
        """Columns without any present value are left out. Splitters come from a quantile sketch whose draws are random unless `stable`:
        answers are exact with any splitters, but steps() are at their places."""
        x = {c: F.col(f"`{c}`").cast("double") for c in columns}
        wide = df.select(*[F.when(~F.isnan(e), e).alias(f"x{j}") for j, e in enumerate(x.values())], *([side.cast("int").alias("w")] if side is not None else []))
        shares = [i / cells for i in range(1, cells)]
        spark = df.sparkSession
        if stable:
            head = wide.agg(*[F.percentile_approx(f"x{j}", shares, 4 * cells).alias(f"s{j}") for j in range(len(columns))]).first() if columns else []
        else:
            sketch = wide.agg(*[F.kll_sketch_agg_double(f"x{j}", F.lit(min(65_535, 4 * cells))).alias(f"s{j}") for j in range(len(columns))], *[F.count(f"x{j}").alias(f"n{j}") for j in range(len(columns))])
            # One row a column, so that the shares are written into the plan once.
            each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"s{j}").alias("s"), F.col(f"n{j}").alias("n")) for j in range(len(columns))])).alias("e")
            marks = F.kll_sketch_get_quantile_double("e.s", F.array(*[F.lit(s) for s in shares]))
            head = {r.j: r.q for r in sketch.select(each).where("e.n > 0").select("e.j", marks.alias("q")).collect()} if columns else {}
            head = [head.get(j) for j in range(len(columns))]
        have = [j for j in range(len(columns)) if head[j]]
        keys = ["n"] if side is None else ["a", "b"]
        made = cls(wide.select(*[f"x{j}" for j in have], *(["w"] if side is not None else [])) if have else None, [columns[j] for j in have], [np.unique(np.asarray(head[j], np.float64)) for j in have], keys, _of_wide(len(keys)))
        made.spark = spark
        return made

    @classmethod
    def of_two(cls, first: DataFrame, second: DataFrame, columns: list[str], cells: int = CELLS) -> Cells:
        pick = lambda d, w: d.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], F.lit(w).alias("_side"))
        return cls.of_columns(pick(first, 1).unionByName(pick(second, 0)), columns, cells, F.col("_side"))

    def _count(self) -> None:
        splits, keys, feed = self.splits, self.keys, self.feed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = np.concatenate([[0], np.cumsum([len(s) + 1 for s in splits])])
            n = np.zeros((len(keys), start[-1]), np.int64)
            lo, hi = np.full(start[-1], np.inf), np.full(start[-1], -np.inf)
            for b in batches:
                for c, x, w in feed(b):
                    if not len(x):
                        continue
                    order = np.argsort(x) if len(keys) > 1 else None
                    v = np.sort(x) if order is None else x[order]
                    ends = np.concatenate([[0], np.searchsorted(v, splits[c], "right"), [len(v)]])
                    full = np.flatnonzero(ends[1:] > ends[:-1])
                    at = start[c] + full
                    lo[at], hi[at] = np.minimum(lo[at], v[ends[full]]), np.maximum(hi[at], v[ends[full + 1] - 1])
                    for k, e in enumerate(w):
                        if order is None:
                            total = np.concatenate([[0], np.cumsum(e[np.argsort(x)])]) if (e != 1).any() else np.arange(len(v) + 1)
                        else:
                            total = np.concatenate([[0], np.cumsum(e[order])])
                        n[k, at] += total[ends[full + 1]] - total[ends[full]]
            have = np.flatnonzero(lo <= hi)
            yield pa.RecordBatch.from_arrays([pa.array(have), *[pa.array(n[k, have]) for k in range(len(keys))], pa.array(lo[have]), pa.array(hi[have])], names=["cell", *keys, "lo", "hi"])

        schema = "cell bigint, " + "".join(f"{k} bigint, " for k in keys) + "lo double, hi double"
        found = self.rows.mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(k).alias(k) for k in keys], F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        start = np.concatenate([[0], np.cumsum([len(s) + 1 for s in splits])])
        for r in found:
            j = int(np.searchsorted(start, r.cell, "right")) - 1
            i = r.cell - start[j]
            for k in keys:
                self.n[k][j][i] = r[k]
            self.lo[j][i], self.hi[j][i] = r.lo, r.hi

    def total(self, c: str, k: str) -> int:
        return int(self.n[k][self.place[c]].sum())

    def settled(self, j: int, i: int) -> bool:
        return not self.lo[j][i] < self.hi[j][i]

    def values(self, open_: dict[int, list[int]]) -> DataFrame:
        """(o, x, counts): the distinct values of the open cells {column: cells}; o numbers them in the order of the dict."""
        splits, keys, feed = self.splits, self.keys, self.feed
        number = {j: np.full(len(splits[j]) + 1, -1, np.int64) for j in open_}
        at = 0
        for j, cells in open_.items():
            number[j][cells] = np.arange(at, at + len(cells))
            at += len(cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c, x, w in feed(b):
                    if c in number:
                        o = number[c][np.searchsorted(splits[c], x, "left")]
                        have = np.flatnonzero(o >= 0)
                        yield pa.RecordBatch.from_arrays([pa.array(o[have]), pa.array(x[have]), *[pa.array(e[have]) for e in w]], names=["o", "x", *keys])

        schema = "o bigint, x double" + "".join(f", {k} bigint" for k in keys)
        return self.rows.mapInArrow(run, schema).groupBy("o", "x").agg(*[F.sum(k).alias(k) for k in keys])

    def pick(self, asked: dict[tuple[str, str], list[int]]) -> dict[tuple[str, str], list[float]]:
        """The values at 0-based ranks of (column, count name)."""
        out: dict[tuple[str, str], list[float]] = {}
        todo: dict[tuple[int, int], list[tuple[tuple[str, str], int, int]]] = {}
        for (c, k), ranks in asked.items():
            j = self.place[c]
            upto = np.cumsum(self.n[k][j])
            out[c, k] = [float("nan")] * len(ranks)
            for place, r in enumerate(ranks):
                i = int(np.searchsorted(upto, r, "right"))
                if self.settled(j, i):
                    out[c, k][place] = float(self.hi[j][i])
                else:
                    todo.setdefault((j, i), []).append(((c, k), place, int(r - (upto[i] - self.n[k][j][i]))))
        if not todo:
            return out
        open_: dict[int, list[int]] = {}
        for j, i in sorted(todo):
            open_.setdefault(j, []).append(i)
        cells = [(j, i) for j, own in open_.items() for i in own]
        values = self.values(open_)
        if sum(int(self.n[k][j][i]) for j, i in cells for k in self.keys) <= GATHERED:
            table = values.toPandas().sort_values(["o", "x"])
            for o, part in table.groupby("o"):
                for (c, k), place, r in todo[cells[int(o)]]:
                    out[c, k][place] = float(part["x"].to_numpy()[int(np.searchsorted(np.cumsum(part[k].to_numpy()), r, "right"))])
            return out
        run = running_sums(values, ["o"], ["x"], self.keys)
        wanted = self.spark.createDataFrame([(o, k, c, place, r) for o, cell in enumerate(cells) for (c, k), place, r in todo[cell]], "o bigint, k string, c string, place int, r bigint")
        hit = F.lit(False)
        for k in self.keys:
            hit = hit | ((F.col("k") == k) & (F.col("r") >= F.col(f"{k}_upto") - F.col(k)) & (F.col("r") < F.col(f"{k}_upto")))
        for r in run.join(F.broadcast(wanted), "o").where(hit).select("c", wanted["k"], "place", "x").collect():
            out[r.c, r.k][r.place] = r.x
        return out

    def steps(self, c: str, k: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, shares): the exact share of the values at most each end of a cell, from the least value on; a cell of one value is a step."""
        j = self.place[c]
        have = np.flatnonzero(self.n[k][j])
        upto = np.cumsum(self.n[k][j][have]) / max(1, self.n[k][j].sum())
        before = np.concatenate([[0.0], upto[:-1]])
        return np.column_stack([self.lo[j][have], self.hi[j][have]]).ravel(), np.column_stack([before, upto]).ravel()


def order_statistics(long: DataFrame, counts: dict[str, Column], ranks: dict[str, Column]) -> DataFrame:
    """(c, i, one column a name): for each name the values at its 0-based `ranks`, an array expression over name_all, by place i in the
    array."""
    cells = Cells.of_long(long, counts)
    spark, names = long.sparkSession, list(ranks)
    schema = T.StructType([T.StructField("c", T.StringType()), T.StructField("i", T.IntegerType()), *[T.StructField(k, T.DoubleType()) for k in names]])
    if not cells.names:
        return spark.createDataFrame([], schema)
    totals = spark.createDataFrame([(c, *[cells.total(c, k) for k in counts]) for c in cells.names], "c string, " + ", ".join(f"{k}_all bigint" for k in counts))
    asked = {(r.c, k): r[k] for r in totals.select("c", *[F.when(F.col(f"{k}_all") > 0, e).alias(k) for k, e in ranks.items()]).collect() for k in names if r[k] is not None}
    found = cells.pick(asked)
    rows = []
    for c in cells.names:
        own = {k: found.get((c, k), []) for k in names}
        rows += [(c, i, *[own[k][i] if i < len(own[k]) else None for k in names]) for i in range(max(map(len, own.values())))]
    return spark.createDataFrame(rows, schema)


def _interpolated(cells: Cells, probabilities: list[float]) -> DataFrame:
    asked, at = {}, {}
    for c in cells.names:
        at[c] = [(cells.total(c, "n") - 1) * p for p in probabilities]
        asked[c, "n"] = [k for a in at[c] for k in (int(np.floor(a)), int(np.ceil(a)))]
    found, rows = cells.pick(asked) if asked else {}, []
    for c in cells.names:
        v = found[c, "n"]
        rows.append((c, cells.total(c, "n"), *[float(v[2 * i] + (v[2 * i + 1] - v[2 * i]) * (a - np.floor(a)) if v[2 * i] != v[2 * i + 1] else v[2 * i]) for i, a in enumerate(at[c])]))
    return cells.spark.createDataFrame(rows, "c string, n bigint" + "".join(f", q{i} double" for i in range(len(probabilities))))


def quantiles(long: DataFrame, probabilities: list[float]) -> DataFrame:
    """(c, n, q0, q1, ...): exact quantiles with linear interpolation between neighbours, of a long table (c, x)."""
    return _interpolated(Cells.of_long(long, {"n": F.lit(1)}), probabilities)


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """quantiles() of columns of a table as it stands: no row is multiplied by the number of columns."""
    return _interpolated(Cells.of_columns(df, columns), probabilities)
