"""CSV and JSON files of unknown layout as tables of text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.describe import infer_types
from tabweave.functions.missing import SERVICE_TOKENS, text_missing
from tabweave.functions.scalars import clean_number, parse_datetime, strict_number, trim
from tabweave.operators.records import SEPARATORS, _cut, cut_record, sniff_separator
from tabweave.plans.physical import materialize


def sniff(lines: list[str], profile: str = "service") -> str:
    """service: the separator most frequent in the first line. client: over five lines, a count that is the same in each scores double."""
    if profile == "service":
        return sniff_separator(lines[0] if lines else "")
    bare = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in lines[:5] if x.strip()]

    def score(s: str) -> float:
        counts = [x.count(s) for x in bare]
        return sum(counts) * (2 if counts and counts[0] > 0 and len(set(counts)) == 1 else 1)

    return max(SEPARATORS, key=score)


def normalize_headers(names: list[str]) -> list[str]:
    """Trimmed; blank ones become column_i, repeated ones get _1, _2."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names, 1):
        base = n.strip() or f"column_{i}"
        k = seen.get(base)
        seen[base] = 0 if k is None else k + 1
        out.append(base if k is None else f"{base}_{k + 1}")
    return out


def read_csv(spark: SparkSession, path: str, profile: str = "service", typed: bool = True, sep: str | None = None) -> DataFrame:
    """A CSV file or folder with a header: separator sniffed, quotes doubled inside quotes, line breaks allowed in quotes, blank rows
    dropped, short rows filled with null, columns typed by content when `typed`."""
    head = [r.value for r in spark.read.text(path).limit(5).collect()]
    if not head:
        raise ValueError("EMPTY_CSV")
    head[0] = head[0].lstrip("﻿")
    sep = sep or sniff(head, profile)
    names = normalize_headers(cut_record(head[0], sep)[1])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # Only where a line holds an odd number of quotes may a quoted field hold a line break; else files are split between tasks.
    odd = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    broken = spark.read.text(path).agg(F.max(odd % 2 == 1).alias("b")).first().b
    raw = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=bool(broken), enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)
    df = raw.toDF(*names)
    keep = F.lit(False)
    for n in names:
        keep = keep | (F.btrim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) != "")
    df = df.where(keep)
    return coerce(df, profile) if typed else df


def coerce(df: DataFrame, profile: str = "service") -> DataFrame:
    """Text columns as numbers, UTC moments or trimmed text, by infer_types()."""
    kinds = {r.column_name: r.data_type for r in infer_types(df, df.columns, profile).collect()}
    out = {}
    for c in df.columns:
        v = F.col(f"`{c}`")
        if kinds[c] == "numeric":
            out[c] = strict_number(v) if profile == "service" else clean_number(v)
        elif kinds[c] == "datetime":
            out[c] = parse_datetime(v)
        else:
            out[c] = F.when(~text_missing(v, SERVICE_TOKENS), trim(v))
    return df.withColumns(out)


def json_records(text: str) -> list[tuple[list[str], list[str | None]]]:
    """(names, cells) of each record of one JSON document in one of four layouts: records; rows of arrays, the first a header; {headers,
    data or rows}; {data, rows or records}. Nested values are JSON text; a value that is neither object nor array is a record of one
    column, value."""
    doc, headers = json.loads(text), None
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    if isinstance(doc, dict):
        headers = doc.get("headers") if isinstance(doc.get("headers"), list) else None
        doc = next((doc[k] for k in ("data", "rows", "records") if isinstance(doc.get(k), list)), [doc])
    elif not isinstance(doc, list):
        doc = [doc]
    if headers is None and doc and isinstance(doc[0], list):
        headers, doc = doc[0], doc[1:]
    if headers is not None:
        names = normalize_headers([str(h) for h in headers])
        return [(names, [cell(v) for v in ([*r, *[None] * len(names)][: len(names)] if isinstance(r, list) else [r.get(k) for k in headers] if isinstance(r, dict) else [r, *[None] * len(names)][: len(names)])]) for r in doc]
    rows = [r if isinstance(r, dict) else {"value": r} for r in doc]
    return [(list(r), [cell(v) for v in r.values()]) for r in rows]


def _json_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for doc, text in zip(b["doc"], b["value"]):
            try:
                rows = json_records(text)
            except ValueError:  # several documents, one a line
                rows = [r for line in text.splitlines() if line.strip() for r in json_records(line)]
            if rows:
                yield pd.DataFrame({"doc": doc, "record": range(len(rows)), "names": [r[0] for r in rows], "cells": [r[1] for r in rows]})


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file or a folder of them, in any of the layouts of json_records(), as text columns in first-seen order; nested values as
    JSON text. Where every line is a document of its own (JSON lines), lines are read in parallel; else every file is one value, read
    by one task, never by the driver. Documents with other columns have null in those they lack."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    seen = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("value").isNull()).alias("bad")).first()
    if not seen.n:
        raise ValueError("EMPTY_JSON")
    docs = spark.read.text(path, wholetext=True) if seen.bad else lines
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("doc"), "value").mapInPandas(_json_rows, "doc bigint, record bigint, names array<string>, cells array<string>"), "json")
    first = rows.select("doc", "record", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("doc", "record", "at")).alias("o"))
    names = [r.name for r in first.orderBy("o").collect()]
    if not names:
        return spark.createDataFrame([], "value string")
    cells = F.map_from_arrays("names", "cells")
    return rows.withColumn("m", cells).select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in names])


def ragged_rows(lines: DataFrame, column: str, sep: str, width: int) -> DataFrame:
    """One row: records whose number of fields, quoted ones counted as one, is not `width` or whose quoting is broken."""
    return lines.select(_cut(F.col(column), F.lit(sep)).alias("f")).agg(F.count_if((F.size("f.fields") != width) | F.col("f.broken")).alias("ragged"))
