"""Separating records that cannot be read from those that can, with one reason each.

The text is read permissively under an explicit schema of strings, keeping the raw text of what the reader calls corrupt.
Records it calls corrupt, and those whose text holds a quote or a line break (where a permissive reader may repair silently),
are cut again by an exact tokenizer and classed by quoting, then count, then casts. All others never leave the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import ALL_TOKENS, text_missing
from tabweave.plans.physical import Veil, free_name, pin, small_side

# Separators in the order in which a tie is settled.
SEPARATORS = (",", ";", "\t", "|")
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
BROKEN, COUNT, VALUE, HEADLESS = "broken_quoting", "column_count", "invalid_value", "no_header"

CUT = T.StructType([T.StructField("broken", T.BooleanType()), T.StructField("fields", T.ArrayType(T.StringType()))])
HEAD = T.StructType([T.StructField("sep", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])


def cut_record(text: str, sep: str) -> tuple[bool, list[str]]:
    """(broken, fields) of one record. A field that begins with a quote ends at the next lone quote, which a separator or the end
    must follow; elsewhere quotes are plain text. Linear in the length of the text."""
    fields, at, n, broken = [], 0, len(text), False
    while True:
        if text.startswith('"', at):
            end = at + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    return True, fields
                if text.startswith('"', end + 1):
                    end += 2
                    continue
                break
            fields.append(text[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < n and text[at] != sep:
                return True, fields
        else:
            end = text.find(sep, at)
            end = n if end < 0 else end
            fields.append(text[at:end])
            at = end
        if at >= n:
            return broken, fields
        at += 1


def sniff_separator(header: str) -> str:
    """The separator most frequent in the header outside quotes; ties keep the earlier candidate."""
    outside = re.sub(r'"(?:[^"]|"")*"', "", header)
    return max(SEPARATORS, key=outside.count)


@F.pandas_udf(CUT)
def _cut(text: pd.Series, sep: pd.Series) -> pd.DataFrame:
    rows = [cut_record(t, s) if t is not None and s is not None else (None, None) for t, s in zip(text, sep)]
    return pd.DataFrame(rows, columns=["broken", "fields"])


@F.pandas_udf(HEAD)
def _head(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        h = (t or "").lstrip("\ufeff")
        s = sniff_separator(h)
        rows.append((s, [x.strip(" \t") for x in cut_record(h, s)[1]]))
    return pd.DataFrame(rows, columns=["sep", "names"])


def bare_number(c: Column) -> Column:
    """Outer blanks, one pair of parentheses, one leading $ or euro sign and one trailing % taken off, in that order."""
    t = F.btrim(c, F.lit(" \t"))
    t = F.regexp_replace(t, r"(?s)^\((.*)\)\z", "$1")
    t = F.regexp_replace(t, "^[$€]", "")
    return F.regexp_replace(t, r"%\z", "")


def signed_number(bare: Column, written: Column, percent_as_fraction: bool = True) -> Column:
    """The value of `bare`, a bare_number() of `written`: negative if written in parentheses, a hundredth if in percent; else null."""
    t = F.btrim(written, F.lit(" \t"))
    x = F.when(F.rlike(bare, F.lit(NUMBER)), F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))
    x = F.when(t.startswith("("), -x).otherwise(x)
    return F.when(F.rlike(t, F.lit(r"%\)?\z")), x / 100).otherwise(x) if percent_as_fraction else x


def is_date(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def parse_records(
    df: DataFrame,
    text: str = "raw_text",
    upload: str = "upload_id",
    number: str = "record_no",
    numeric: tuple[str, ...] = ("annual_income", "credit_score", "debt_ratio"),
    dates: tuple[str, ...] = ("applied_on",),
    strings: tuple[str, ...] = ("applicant_id", "applicant_name", "loan_approved"),
    tokens: tuple[str, ...] = ALL_TOKENS,
) -> DataFrame:
    """`df` without headers and blank records, plus `reason`, `reason_column`, `raw_kept` and one typed column per name of the schema.

    The header of an upload is its record number 1 (the first by text if that is repeated); a byte order mark is dropped, its names
    say which field is which. reason is null for a record that reads, else the first that applies of broken_quoting, column_count,
    invalid_value (a numeric or date column named in the header holds what is neither missing nor such a value; reason_column names
    it) and, before all, no_header. raw_kept is the text of a rejected record; its typed columns are null. Missing values are null.
    A null text is a blank record. Repeated records come out as often as they come in. Columns of `df` that bear one of the new
    names keep theirs; the new ones get a trailing underscore.
    """
    v = Veil(df)
    t, u, no = v.col(text), v.col(upload), v.col(number)
    first = v.df.where(no == 1).groupBy(u.alias("_u")).agg(F.min(t).alias("_h"))
    heads = first.select("_u", _head("_h").alias("_head")).select("_u", F.col("_head.sep").alias("_sep"), F.col("_head.names").alias("_names"))
    body = v.df.where(F.coalesce(no != 1, F.lit(True)) & (F.btrim(t, F.lit(" \t\r\n")) != ""))
    width = len(numeric) + len(dates) + len(strings)
    rows = body.join(small_side(heads, heads.count(), 400), u.eqNullSafe(F.col("_u")), "left")

    schema = ", ".join(f"c{i} string" for i in range(width)) + ", _corrupt string"
    n_seps = lambda s: F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))
    read = None
    for s in SEPARATORS:  # the reader gives up on records of more than 20,480 fields; the tokenizer takes those
        options = {"sep": s, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
        part = F.when((F.col("_sep") == s) & (n_seps(s) < 20_000), F.from_csv(t, schema, options))
        read = part if read is None else F.coalesce(read, part)
    rows = pin(rows, "_read", read)
    doubt = F.col("_read").isNull() | F.col("_read._corrupt").isNotNull() | F.rlike(t, F.lit('["\r\n]')) | (F.size("_names") != width)
    rows = rows.withColumn("_cut", _cut(F.when(doubt, t), F.when(doubt, F.col("_sep"))))
    clean = F.array(*[F.coalesce(F.col(f"_read.c{i}"), F.lit("")) for i in range(width)])
    rows = pin(rows, "_fields", F.when(F.col("_cut.broken").isNotNull(), F.col("_cut.fields")).otherwise(clean))

    cell = lambda name: F.get(F.col("_fields"), F.nullif(F.array_position("_names", name), F.lit(0)).cast("int") - 1)
    rows = pin(rows, "_cells", F.struct(*[cell(n).alias(n) for n in (*numeric, *dates, *strings)]))
    at = lambda name: F.col(f"_cells.`{name}`")
    seen = [F.when(~text_missing(at(n), tokens), bare_number(at(n)) if n in numeric else F.btrim(at(n), F.lit(" \t")) if n in dates else at(n)).alias(n) for n in (*numeric, *dates, *strings)]
    rows = pin(rows, "_seen", F.struct(*seen))
    have = lambda name: F.col(f"_seen.`{name}`")
    wrong = [F.when(~F.rlike(have(n), F.lit(NUMBER)), F.lit(n)) for n in numeric] + [F.when(have(n).isNotNull() & ~is_date(have(n)), F.lit(n)) for n in dates]
    rows = rows.withColumn("_wrong", F.coalesce(*wrong, F.lit(None).cast("string")))
    reason = (
        F.when(F.col("_sep").isNull(), HEADLESS)
        .when(F.coalesce(F.col("_cut.broken"), F.lit(False)), BROKEN)
        .when(F.size("_fields") != F.size("_names"), COUNT)
        .when(F.col("_wrong").isNotNull(), VALUE)
    )
    rows = pin(rows, "_reason", reason)
    ok = F.col("_reason").isNull()
    typed = {n: signed_number(have(n), at(n)) for n in numeric} | {n: F.try_to_timestamp(have(n), F.lit("yyyy-MM-dd")).cast("date") for n in dates} | {n: have(n) for n in strings}
    out = [F.col("_reason").alias(free_name(df, "reason")), F.when(F.col("_reason") == VALUE, F.col("_wrong")).alias(free_name(df, "reason_column")), F.when(~ok, t).alias(free_name(df, "raw_kept"))]
    out += [F.when(ok, e).alias(free_name(df, n)) for n, e in typed.items()]
    return rows.select(*v.back(), *out)
