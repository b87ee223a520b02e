"""Tables as CSV, JSON and SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.scalars import PLAIN, csv_field, sql_literal, trim
from tabweave.plans.physical import one_row, running_sums


def safe_filename(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_.-]", "_", name)


def safe_table(name: str) -> str:
    return (re.sub(r"[^a-zA-Z0-9_]", "_", name).lower().lstrip("_"))[:63] or "synthetic_data"


def safe_columns(names: list[str]) -> list[str]:
    """Lower-case names of letters, digits and underscores; one that comes out twice gets _2, _3."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        c = re.sub(r"[^a-zA-Z0-9_]", "_", n or f"col_{i}").lower().lstrip("_")
        c = f"col_{c}" if not c or c[0].isdigit() else c
        out.append(c if c not in out else next(f"{c}_{k}" for k in range(2, len(names) + 2) if f"{c}_{k}" not in out))
    return out


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(line): each row as one CSV line; nested values as JSON."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.to_json(F.col(f"`{c}`")) if kinds[c].startswith(("struct", "array", "map")) else F.col(f"`{c}`")
    return df.select(F.concat_ws(",", *[csv_field(cell(c)) for c in columns or df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str, crlf: bool = True) -> None:
    """A folder of CSV files with headers, one a task."""
    df.write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n" if crlf else "\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))


def json_structured(df: DataFrame, key: str, filename: str, exported_at: str) -> DataFrame:
    """(place, line): one JSON document {metadata, records} as lines in the order of `place`: metadata (filename, exportedAt, rowCount,
    columnCount, headers), then one record a line in the order of `key`, which must tell rows apart."""
    import json

    kinds = dict(df.dtypes)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = running_sums(df.select(record.alias("r"), F.col(f"`{key}`").alias("k")).withColumn("one", F.lit(1)), [], ["k"], ["one"])
    n = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    facts = json.dumps({"filename": filename, "exportedAt": exported_at}, ensure_ascii=False)[:-1]
    head = F.concat(F.lit('{"metadata":' + facts.replace(": ", ":").replace(", ", ",") + ',"rowCount":'), n.cast("string"), F.lit(f',"columnCount":{len(kinds)},"headers":{json.dumps(df.columns, ensure_ascii=False, separators=(",", ":"))}}},"records":['))
    first = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("place"), head.alias("line"))
    last = df.sparkSession.range(1).select((n + 1).alias("place"), F.lit("]}").alias("line"))
    body = rows.select(F.col("one_upto").alias("place"), F.concat("r", F.when(F.col("one_upto") < F.col("one_all"), ",").otherwise("")).alias("line"))
    return first.unionByName(body).unionByName(last)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def sql_types(df: DataFrame, columns: list[str] | None = None, sample: int | None = None, order: str | None = None) -> DataFrame:
    """(column_name, sql_type): BOOLEAN, BIGINT, NUMERIC(14, 4), TIMESTAMP, TEXT or VARCHAR(255), the first that all values are. All rows decide, or the
    first `sample` ones by `order`."""
    columns = columns or df.columns
    part = df.select(*columns, *([order] if order and order not in columns else []))
    if sample:
        part = (part.orderBy(order) if order else part).limit(sample)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in columns])
    v = F.col("v")
    t = part.select(F.explode(cells).alias("e")).select("e.*").groupBy("c").agg(
        F.count(F.nullif(v, F.lit(""))).alias("n"),
        F.min(F.when(v != "", F.lower(v).isin("0", "1", "true", "false"))).alias("boolean"),
        F.min(F.when(v != "", F.rlike(v, F.lit(PLAIN)) & F.coalesce(v.try_cast("double") == F.floor(v.try_cast("double")), F.lit(False)))).alias("whole"),
        F.min(F.when(v != "", F.rlike(v, F.lit(PLAIN)))).alias("number"),
        F.min(F.when(v != "", F.rlike(v, F.lit("^[0-9]{4}[-/.]")) & (F.length(v) >= 8) & F.try_to_timestamp(F.regexp_replace(v, "[/.]([0-9]{2})[/.]([0-9]{2})", "-$1-$2")).isNotNull())).alias("moment"),
        F.max(F.length(v)).alias("longest"))
    kind = (
        F.when(F.col("n") == 0, "VARCHAR(255)").when(F.col("boolean"), "BOOLEAN").when(F.col("whole"), "BIGINT").when(F.col("number"), "NUMERIC(14, 4)")
        .when(F.col("moment"), "TIMESTAMP").when(F.col("longest") > 255, "TEXT").otherwise("VARCHAR(255)"))
    return t.select(F.col("c").alias("column_name"), kind.alias("sql_type"))


def sql_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(values_text): each row as a parenthesised list of literals."""
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(f"`{c}`")) for c in columns or df.columns]), F.lit(")")).alias("values_text"))


def sql_inserts(df: DataFrame, table: str, key: str, batch: int = 100, columns: list[str] | None = None, blocks: int = 256) -> DataFrame:
    """(batch, statement): multi-row INSERTs of up to `batch` rows (1..1000). Rows are batched within `blocks` of key hashes, so no
    task sees the whole table; every row is in one statement."""
    columns, size = columns or df.columns, min(1000, max(1, batch))
    names = ", ".join(f'"{c}"' for c in safe_columns(columns))
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    rows = df.select(block.alias("block"), F.col(key).alias("k"), F.concat(F.lit("  ("), F.concat_ws(", ", *[sql_literal(F.col(f"`{c}`")) for c in columns]), F.lit(")")).alias("v"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("block").orderBy("k", "v")))
    grouped = numbered.groupBy("block", F.floor((F.col("i") - 1) / size).alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs"))
    head = f'INSERT INTO "{safe_table(table)}" ({names}) VALUES\n'
    text = F.concat(F.lit(head), F.array_join(F.transform("vs", lambda e: e["v"]), ",\n"), F.lit(";"))
    return grouped.select(F.concat_ws(".", "block", "part").alias("batch"), text.alias("statement"))


def sql_schema(df: DataFrame, table: str, drop: bool = True, sample: int | None = None, key: str = "row_key") -> str:
    """DROP and CREATE TABLE text with a serial key, named `key` (or key_2 if a column has that name)."""
    kinds = {r.column_name: r.sql_type for r in sql_types(df, df.columns, sample).collect()}
    name = safe_table(table)
    first, *others = safe_columns([key, *df.columns])
    body = ",\n".join([f'  "{first}" SERIAL PRIMARY KEY', *[f'  "{s}" {kinds[c]}' for c, s in zip(df.columns, others)]])
    return (f'DROP TABLE IF EXISTS "{name}";\n' if drop else "") + f'CREATE TABLE "{name}" (\n{body}\n);\n'
