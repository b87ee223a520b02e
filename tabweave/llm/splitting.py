"""Cutting documents above a limit into pieces at cell ends, else line ends, else between tokens, with an overlap.

The token offsets of a document are its prefix sums: a boundary in characters becomes a place in the token order by binary
search, and so does the last boundary under the limit. A document is one row of one task, read whole; only its cut places
leave Python, and the text of a piece is a substring taken by the engine where a plan asks for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.tokens import code_points, token_starts
from tabweave.plans.physical import pin, small_side

_PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("token_from", "token_to", "char_from", "char_to", "repeated")] + [T.StructField("cut", T.StringType())])
PLAN = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("finest_cut", T.StringType()), T.StructField("pieces", T.ArrayType(_PIECE))])


def last_under(bounds: np.ndarray, low: int, high: int) -> int | None:
    """The last boundary in (low, high]."""
    at = int(np.searchsorted(bounds, high, "right")) - 1
    return int(bounds[at]) if at >= 0 and bounds[at] > low else None


def cut_places(n: int, limit: int, overlap: int, cells: np.ndarray, lines: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(from, to, repeated, cut) in tokens; cut says what the piece ends at: cell, line, inside, or end."""
    overlap = min(max(overlap, 0), limit - 1)
    out, start, repeated = [], 0, 0
    while n - start > limit:
        low, high = start + overlap, start + limit
        end, cut = last_under(cells, low, high), "cell"
        if end is None:
            end, cut = last_under(lines, low, high), "line"
        if end is None:
            end, cut = high, "inside"
        out.append((start, end, repeated, cut))
        start, repeated = end - overlap, overlap
    out.append((start, n, repeated, "end"))
    return out


def plan_split(text: str | None, cell_chars: list[int] | None, limit: int, overlap: int) -> tuple | None:
    """(tokens, finest_cut, pieces) of a document above `limit`; None of one within it."""
    if not text or limit < 1:
        return None
    points = code_points(text)
    starts = token_starts(points)
    n = len(starts)
    if n <= limit:
        return None
    sizes = np.asarray([np.nan if c is None else c for c in (cell_chars if cell_chars is not None else [])], np.float64)
    ends = np.cumsum((sizes if np.isfinite(sizes).all() else np.zeros(0)).astype(np.int64) + 2)
    if len(ends) == 0 or ends[-1] - 2 != len(points):  # cells that do not add up to the text say nothing
        ends = np.zeros(0, np.int64)
    lines = np.flatnonzero(points == 10) + 1
    at = [np.unique(np.searchsorted(starts, e)) for e in (ends, lines)]
    cells, lines = (a[(a > 0) & (a < n)] for a in at)
    longest = [int(np.diff(np.concatenate(([0], a, [n]))).max()) for a in (cells, lines)]
    finest = "cell" if longest[0] <= limit else "line" if longest[1] <= limit else "inside"
    char = lambda t: int(starts[t]) if 0 < t < n else 0 if t == 0 else len(points)
    pieces = [dict(token_from=a, token_to=b, char_from=char(a), char_to=char(b), repeated=r, cut=c) for a, b, r, c in cut_places(n, limit, overlap, cells, lines)]
    return n, finest, pieces


@F.pandas_udf(PLAN)
def _plan(text: pd.Series, cells: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if pd.isna(m) else plan_split(t, c, int(m), int(0 if pd.isna(o) else o)) or (None, None, None) for t, c, m, o in zip(text, cells, limit, overlap)]
    out = pd.DataFrame(rows, columns=["tokens", "finest_cut", "pieces"])
    out["tokens"] = out["tokens"].astype("Int64")
    return out


def split_documents(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, finest_cut, piece, pieces, token_from, token_to, char_from, char_to, repeated, cut, piece_text).

    docs: doc_id, text, source, cells (array of structs with n_chars, joined in text by two line ends); limits: source, piece_tokens,
    overlap_tokens (the least limit counts if a source is named twice). Only documents with more tokens than their source's limit
    come out. Each piece but the first repeats the last overlap_tokens of the one before; pieces end at the last cell end under the
    limit, else the last line end, else at the limit. finest_cut says which ends would do for cutting without overlap: cell if no
    cell exceeds the limit, else line if no line does, else inside. Cells that are null or do not add up to the text are not used.
    Null and empty texts and sources without a limit give nothing; repeated rows give repeated pieces; other columns are ignored.
    """
    limits = limits.groupBy("source").agg(F.min(F.struct(F.col("piece_tokens").cast("bigint").alias("m"), F.col("overlap_tokens").cast("bigint").alias("o"))).alias("_x"))
    rows = docs.select("doc_id", "source", "text", F.col("cells.n_chars").alias("_cells")).join(small_side(limits, limits.count(), 64), "source")
    planned = pin(rows, "_p", _plan("text", "_cells", "_x.m", "_x.o")).where(F.col("_p.tokens").isNotNull())
    each = planned.select("doc_id", "source", "text", F.col("_p.tokens").alias("tokens"), F.col("_p.finest_cut").alias("finest_cut"), F.size("_p.pieces").alias("pieces"), F.posexplode("_p.pieces").alias("piece", "_e"))
    return each.select(
        "doc_id", "source", "tokens", "finest_cut", (F.col("piece") + 1).alias("piece"), "pieces", "_e.*",
        F.substring(F.col("text"), F.col("_e.char_from").cast("int") + 1, (F.col("_e.char_to") - F.col("_e.char_from")).cast("int")).alias("piece_text"))
