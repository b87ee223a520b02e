"""A catalog of stored tables in a folder: one Parquet table each, and one row of facts each."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "id string, owner string, name string, rows bigint, columns int, created_at timestamp, deleted boolean"


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """`limit` rows (1..100) from `offset` on in a total order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def search(df: DataFrame, text: str, column: str, **equal) -> DataFrame:
    """Rows whose `column` contains `text` ignoring case and whose other columns equal the given values; both as text, not patterns."""
    t = df.where(F.lower(column).contains(text.lower())) if text else df
    for k, v in equal.items():
        t = t.where(F.col(k) == v)
    return t


def rollup(df: DataFrame, rows: str, size: str) -> DataFrame:
    """One row: datasets, rows, largest, of a table of facts."""
    return df.agg(F.count(F.lit(1)).alias("datasets"), F.sum(rows).alias("rows"), F.max(size).alias("largest"))


class Catalog:
    """Append-only: a table is deleted by a later fact about it. Names are searched as text, not as patterns."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _facts(self) -> DataFrame:
        try:
            log = self.spark.read.schema(FACTS).parquet(f"{self.root}/_facts")
        except AnalysisException:
            return self.spark.createDataFrame([], FACTS)
        last = log.groupBy("id").agg(F.max(F.struct("created_at", "deleted", "owner", "name", "rows", "columns")).alias("f"))
        return last.select("id", "f.owner", "f.name", "f.rows", "f.columns", "f.created_at", "f.deleted").where(~F.col("deleted")).drop("deleted")

    def _note(self, id_: str, owner: str, name: str, rows: int, columns: int, deleted: bool) -> None:
        one = self.spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, t, v in (("id", "string", id_), ("owner", "string", owner), ("name", "string", name), ("rows", "bigint", rows), ("columns", "int", columns))], F.current_timestamp().alias("created_at"), F.lit(deleted).alias("deleted"))
        one.coalesce(1).write.mode("append").parquet(f"{self.root}/_facts")

    def _path(self, id_: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", id_):
            raise ValueError(f"not an id: {id_!r}")
        return f"{self.root}/{id_}"

    def put(self, id_: str, df: DataFrame, owner: str = "", name: str = "") -> None:
        df.write.mode("overwrite").parquet(self._path(id_))
        self._note(id_, owner, name or id_, self.get(id_).count(), len(df.columns), False)

    def get(self, id_: str) -> DataFrame:
        return self.spark.read.parquet(self._path(id_))

    def delete(self, id_: str) -> bool:
        found = self._facts().where(F.col("id") == id_).first()
        if found is not None:
            self._note(id_, found.owner, found.name, found.rows, found["columns"], True)
        return found is not None

    def update(self, id_: str, owner: str | None = None, name: str | None = None) -> bool:
        """Notes another owner or name; False if there is no such table."""
        found = self._facts().where(F.col("id") == id_).first()
        if found is not None:
            self._note(id_, found.owner if owner is None else owner, found.name if name is None else name, found.rows, found["columns"], False)
        return found is not None

    def find(self, **facts) -> DataFrame:
        """The facts of the tables that have all of these values."""
        t = self._facts()
        for k, v in facts.items():
            t = t.where(F.col(k).eqNullSafe(F.lit(v)))
        return t

    def rollup(self) -> DataFrame:
        """One row: tables, their rows, the most rows of one."""
        return rollup(self._facts(), "rows", "rows")

    def export(self, path: str) -> None:
        """Copies all tables and their facts into a folder that another catalog can take in."""
        for r in self._facts().collect():
            self.get(r.id).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{r.id}")
        self._facts().withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_facts")

    def take_in(self, path: str) -> int:
        """Puts the tables of an exported folder into this catalog, in place of ones of the same id; their number."""
        facts = self.spark.read.schema(FACTS).parquet(f"{path.rstrip('/')}/_facts").collect()
        for r in facts:
            self.put(r.id, self.spark.read.parquet(f"{path.rstrip('/')}/{r.id}"), r.owner, r.name)
        return len(facts)

    def clear(self) -> int:
        """Deletes all tables' facts; their number."""
        return sum(self.delete(r.id) for r in self._facts().collect())

    def list(self, owner: str | None = None, search: str = "", offset: int = 0, limit: int = 20) -> DataFrame:
        t = self._facts()
        t = t.where(F.col("owner") == owner) if owner is not None else t
        t = _search(t, search, "name")
        return page(t, [F.desc("created_at"), "id"], offset, limit)


_search = search


class ActionLog:
    """An append-only table of who did what to which resource; `note` never fails the action it notes."""

    SCHEMA = "actor string, action string, resource string, status string, details string, at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def note(self, actor: str, action: str, resource: str = "", status: str = "ok", details: dict | None = None) -> bool:
        values = {"actor": actor, "action": action, "resource": resource, "status": status, "details": json.dumps(details or {})}
        try:
            self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(self.path)
        except Exception:
            return False
        return True

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)
