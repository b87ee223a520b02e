"""What counts as no value, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that stand for no value in a service upload and in a client upload.
SERVICE_TOKENS = ("", "na", "n/a", "nan", "null", "none", "nil", "undefined", "?", "#n/a")
CLIENT_TOKENS = ("", "nan", "null", "na", "n/a", "none", "missing", "?", "-")
WORKER_TOKENS = ("", "nan", "null")
ALL_TOKENS = tuple(dict.fromkeys(SERVICE_TOKENS + CLIENT_TOKENS))


def bare(c: Column) -> Column:
    """Text without outer blanks and tabs, in lower case."""
    return F.lower(F.btrim(c, F.lit(" \t")))


def text_missing(c: Column, tokens: tuple[str, ...] = ALL_TOKENS) -> Column:
    """True where text is null or one of `tokens`; never null."""
    return c.isNull() | F.coalesce(bare(c).isin(*tokens), F.lit(False))


def number_missing(c: Column, negative: bool = True) -> Column:
    """True where a number is null, NaN or, with `negative`, below zero; never null."""
    found = c.isNull() | F.coalesce(F.isnan(c), F.lit(False))
    return found | F.coalesce(c < 0, F.lit(False)) if negative else found
