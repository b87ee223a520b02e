"""Lineage cuts, size-checked broadcasts and ranks that survive a hot group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a side is sent to every executor; beyond it the join shuffles and adaptive execution splits skew.
BROADCAST_BYTES = 24 << 20


#: Folders of materialize() to be removed when the scope() they were made in ends; one list a nested scope.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is set: a temporary one in a local session, in which all
    tasks run on this machine, and an error on a cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("no shared folder: set spark.checkpoint.dir to one that all executors reach")
        found = tempfile.mkdtemp(prefix="tabweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    The table is removed when the scope() it was made in ends, else when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Frees the tables that operators materialize inside it once it ends: write the result within the scope."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target, files = _folder(spark, path)
            files.delete(target, True)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark `df` for broadcast if `rows` x `row_bytes`, a counted size, is within BROADCAST_BYTES; else leave it to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, ignoring case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


class Veil:
    """A table under column names of its own, so that no name of the input can clash with one an operator uses."""

    def __init__(self, df: DataFrame) -> None:
        self.names = list(df.columns)
        self.inner = [f"in{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def name(self, column: str) -> str:
        """The inner name of `column`: the first of that name, else the first of it ignoring case."""
        low = [n.lower() for n in self.names]
        return self.inner[self.names.index(column) if column in self.names else low.index(column.lower())]

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def back(self) -> list[Column]:
        return [F.col(i).alias(n) for i, n in zip(self.inner, self.names)]


def dense_rank_within(df: DataFrame, keys: list[str], unique: list[Column], name: str, rows: int = 0) -> DataFrame:
    """Number the rows of each group 1..n in an order that is random but fixed by the hash of `unique`.

    Groups are cut by that hash into parts which are numbered apart and shifted by the sizes of the parts before, so that a group
    holding a third of all rows occupies many tasks instead of one: one part for each million of `rows`, the counted size of the
    whole table, between 8 and 8,192. The numbers are a permutation for any number of parts. `unique` must identify a row; `keys` must not be null (rows
    where one is are left out).
    """
    spread = min(8192, max(8, rows // 1_000_000))
    part, order, shift = free_name(df, "_part"), free_name(df, "_order"), free_name(df, "_shift")
    df = df.withColumn(order, F.xxhash64(*unique)).withColumn(part, F.pmod(F.shiftright(order, 20), F.lit(spread)))
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(order, *unique)))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(shift))
    shifts = sizes.withColumn(shift, F.coalesce(F.sum(shift).over(before), F.lit(0)))
    return local.join(shifts, [*keys, part]).withColumn(name, F.col(name) + F.col(shift)).drop(part, order, shift)


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """`df` with, for each of `values`, v_upto (its sum over the rows of the group up to this one by `order`, which must tell the rows
    of a group apart) and v_all (its sum over the group).

    The rows are cut into ranges of (keys, order) at sampled splitters, so a range is a share of all rows whatever their values and
    however large a group is; windows run inside a range, and only the sums of ranges are added up across them. The cut is written
    once, as the number of a range must not change.
    """
    part = free_name(df, "_part")
    if not keys:
        every = free_name(df, "_every")
        return running_sums(df.withColumn(every, F.lit(0)), [every], order, values).drop(every)
    cut = materialize(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    every, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, part).agg(*[F.sum(v).alias(f"{v}_part") for v in values])
    sizes = sizes.select(*keys, part, *[F.coalesce(F.sum(f"{v}_part").over(before), F.lit(0)).alias(f"{v}_before") for v in values], *[F.sum(f"{v}_part").over(every).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    local = cut.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values])
    return local.join(sizes, [*keys, part]).select(*df.columns, *[(F.col(f"{v}_in") + F.col(f"{v}_before")).alias(f"{v}_upto") for v in values], *[f"{v}_all" for v in values])


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add `value` as a column that is computed once: a generator keeps the optimizer from copying a costly expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def one_row(df: DataFrame) -> Column:
    """The single row of `df` as a struct, evaluated as a scalar subquery: totals reach every row without a join."""
    return df.select(F.struct("*")).scalar()
