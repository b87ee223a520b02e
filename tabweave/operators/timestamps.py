"""Mixed timestamp formats and zones, normalised through a dictionary of distinct strings.

Only distinct (source, text, zone) triples are parsed, once and for good: the dictionary is kept as a table, later calls parse only
what it lacks, and rows get their instants by a join. Parsing cost follows the number of distinct strings; a string held by
a third of all rows is one dictionary row a source, and adaptive execution splits its rows in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.instants import read_instant, to_micros
from tabweave.functions.missing import ALL_TOKENS, text_missing
from tabweave.plans.physical import Veil, free_name, materialize

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z\z"
KEYS = ["source", "raw", "zone"]
DICTIONARY = "source string, raw string, zone string, outcome string, micros bigint"
#: Raised whenever the parser reads a string in another way, so that what an older one stored is parsed anew.
VERSION = 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        outcome = [read_instant(r, z) for r, z in zip(b["raw"], b["zone"])]
        yield pd.DataFrame({"source": b["source"], "raw": b["raw"], "zone": b["zone"], "outcome": outcome, "micros": pd.array([to_micros(o) for o in outcome], dtype="Int64")})


def is_canonical(c: Column) -> Column:
    """Written exactly as YYYY-MM-DDTHH:MM:SS.ffffffZ and an existing moment; never null."""
    return F.coalesce(F.rlike(c, F.lit(CANONICAL)) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def extend_dictionary(keys: DataFrame, path: str | None) -> DataFrame:
    """The dictionary rows of `keys` (source, raw, zone; distinct). With `path`, what that table already holds is not parsed again and
    what it lacked is appended to it; without, a table of this session is made. Two calls at once may append the same string: it is
    read as one row."""
    spark = keys.sparkSession
    if path is None:
        return materialize(keys.mapInPandas(_parse, DICTIONARY), "instants")
    own = f"{path.rstrip('/')}/version={VERSION}"
    try:
        known = spark.read.schema(DICTIONARY).parquet(own)
        keys = keys.join(known.select(*KEYS), KEYS, "left_anti")
    except AnalysisException:
        pass
    materialize(keys.mapInPandas(_parse, DICTIONARY), "instants").write.mode("append").parquet(own)
    once = spark.read.schema(DICTIONARY).parquet(own).groupBy(*KEYS).agg(F.min(F.struct("outcome", "micros")).alias("e"))
    return once.select(*KEYS, "e.outcome", "e.micros")


def normalize_timestamps(df: DataFrame, raw: str, zone: str | None = None, dictionary: str | None = None, tokens: tuple[str, ...] = ALL_TOKENS, source: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `outcome` (canonical UTC text, or invalid / nonexistent / ambiguous), `micros` (since 1970) and `status`.

    status is `missing` (null or a missing token: outcome and micros null), `canonical` (already so written: outcome is the text
    itself) or `read`. Names that `df` already has get a trailing underscore. Every row comes out once, repeated rows and columns
    of any name included; an empty table gives an empty one; texts of any length are read whole. A null zone or one
    that is a missing token is UTC. `source` names the columns that say where a string comes from, part of the dictionary's key.
    """
    v = Veil(df)
    c = v.col(raw)
    z = F.when(text_missing(v.col(zone), tokens), "").otherwise(F.btrim(v.col(zone), F.lit(" \t"))) if zone else F.lit("")
    tagged = v.df.withColumn("status", F.when(text_missing(c, tokens), "missing").when(is_canonical(c), "canonical").otherwise("read"))
    plain = tagged.where(F.col("status") != "read").withColumn("outcome", F.when(F.col("status") == "canonical", c))
    plain = plain.withColumn("micros", F.when(F.col("status") == "canonical", F.unix_micros(F.try_to_timestamp(c))))
    todo = tagged.where(F.col("status") == "read").withColumn("k_raw", F.btrim(c, F.lit(" \t"))).withColumn("k_zone", z)
    todo = todo.withColumn("k_source", F.concat_ws("\x1f", *[F.coalesce(v.col(k).cast("string"), F.lit("\x00")) for k in source]) if source else F.lit(""))
    words = extend_dictionary(todo.select(*[F.col(f"k_{k}").alias(k) for k in KEYS]).distinct(), dictionary)
    words = words.select(*[F.col(k).alias(f"k_{k}") for k in KEYS], "outcome", "micros")
    done = todo.join(words, [f"k_{k}" for k in KEYS], "left").drop(*[f"k_{k}" for k in KEYS]).unionByName(plain)
    return done.select(*v.back(), *[F.col(n).alias(free_name(df, n)) for n in ("outcome", "micros", "status")])
