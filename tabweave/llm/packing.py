"""Filling containers of fixed capacity with whole items, several permitted lengths at once.

Sizes are whole numbers up to the capacity, so all that packing needs to know is how many items there are of each size: a
table of at most `capacity` rows for each source, whatever the number of items. Best-fit decreasing runs on that table,
moving whole ranges of equal items into whole ranges of equal bins, and gives back ranges again: items of this size with
ranks from-to go into the bins from this one on, so many to a bin. Items are ranked within their size (hot sizes in many
parts at once) and find their bin by a join on the size. No task ever sees the items of a source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.tokens import count_tokens
from tabweave.plans.physical import dense_rank_within, materialize, small_side

RANGES = "source string, size bigint, rank_from bigint, rank_to bigint, per_bin bigint, first_bin bigint, length bigint, used bigint"


def pack_histogram(sizes: list[int], counts: list[int], lengths: list[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Ranges (size, rank_from, rank_to, per_bin, first_bin, length, used) that place every item.

    Items go from the largest to the smallest, each into the bin with the least room that holds it. Where none does, the bin of
    the least cost is opened: the permitted length with the fewest tokens of length to a token it can be filled with, counting
    on smaller items still to come that no open bin has room for. In the end every bin is cut down to the smallest permitted length that holds its contents.
    """
    lengths = sorted(lengths)
    top = lengths[-1]
    volume = np.zeros(top + 1, np.int64)
    for s, c in zip(sizes, counts):
        volume[s] += s * c
    smaller = np.cumsum(volume)
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    total_room, next_bin, placed = 0, 0, []

    def add(room: int, first: int, n: int, length: int) -> None:
        nonlocal total_room
        if n:
            if room not in open_:
                insort(rooms, room)
            open_[room].append((first, n, length))
            total_room += room * n

    def take(room: int) -> tuple[int, int, int]:
        nonlocal total_room
        first, n, length = open_[room].pop()
        total_room -= room * n
        if not open_[room]:
            del open_[room]
            rooms.pop(bisect_left(rooms, room))
        return first, n, length

    for s, c in sorted(zip(sizes, counts), reverse=True):
        rank = 1
        while c:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, n, length = take(room)
            else:
                best = None
                for b in (b for b in lengths if b >= s):
                    k = min(c, b // s)
                    rest = b - k * s
                    fill = min(rest, max(0, int(smaller[min(rest, s - 1)]) - total_room))
                    cost = (b / (k * s + fill), -b)
                    if best is None or cost < best[0]:
                        best = (cost, b, k, rest, fill)
                _, length, k, rest, fill = best
                n = max(1, c // k)
                if rest and fill == rest:
                    n = min(n, max(1, (int(smaller[min(rest, s - 1)]) - total_room) // rest))
                first, room = next_bin, length
                next_bin += n
            k = room // s
            full = min(n, c // k)
            if full:
                placed.append((s, rank, rank + full * k - 1, k, first))
                add(room - k * s, first, full, length)
                rank, c = rank + full * k, c - full * k
            if full < n and c:
                placed.append((s, rank, rank + c - 1, c, first + full))
                add(room - c * s, first + full, 1, length)
                add(room, first + full + 1, n - full - 1, length)
                c = 0
            elif full < n:
                add(room, first + full, n - full, length)
    groups = sorted((first, n, length - room) for room, g in open_.items() for first, n, length in g)
    starts, out = [g[0] for g in groups], []
    for s, a, z, k, first in placed:
        bin_, last = first, first + (z - a) // k
        while bin_ <= last:  # a range of bins may have fallen apart later
            g = groups[bisect_left(starts, bin_ + 1) - 1]
            end = min(last, g[0] + g[1] - 1)
            lo, hi = a + (bin_ - first) * k, min(z, a + (end - first + 1) * k - 1)
            out.append((s, lo, hi, k, bin_, lengths[bisect_left(lengths, g[2])], g[2]))
            bin_ = end + 1
    return out


def _pack_source(fractions: tuple[float, ...]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        lengths = sorted({max(1, int(capacity * f)) for f in fractions} | {capacity})
        rows = pack_histogram(pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist(), lengths)
        out = pd.DataFrame(rows, columns=["size", "rank_from", "rank_to", "per_bin", "first_bin", "length", "used"])
        out.insert(0, "source", key[0])
        return out

    return run


def pack_documents(docs: DataFrame, limits: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(doc_id, source, tokens, capacity, part, parts, part_tokens, container, container_length, container_used): every document's place.

    docs: doc_id, text, source; limits: source, capacity_tokens (the least counts if a source is named twice). A document within
    its capacity has one part; a larger one is cut into containers it fills alone and one remainder that is packed like an item.
    Containers have one of the permitted lengths, `fractions` of the capacity, and belong to one source. Documents without tokens
    (null and empty texts) or of a source without a limit have a null container. Repeated rows are items of their own; other columns are ignored.
    """
    limits = limits.where(F.col("capacity_tokens") > 0).groupBy("source").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    sized = materialize(docs.select("doc_id", "source", count_tokens("text").alias("tokens")), "sized")
    items = sized.join(small_side(limits, limits.count(), 64), "source", "left")
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    items = items.withColumn("parts", F.coalesce(parts, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    last = F.col("part") == F.col("parts")
    items = items.withColumn("part_tokens", F.when(last, F.col("tokens") - (F.col("parts") - 1) * F.col("capacity")).otherwise(F.col("capacity")))
    items = items.withColumn("part_tokens", F.coalesce("part_tokens", "tokens"))
    loose = last & F.col("capacity").isNotNull() & (F.col("tokens") > 0)
    packed = items.where(loose)
    counts = packed.groupBy("source", F.col("part_tokens").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("capacity").alias("capacity"))
    ranges = materialize(counts.groupBy("source").applyInPandas(_pack_source(fractions), RANGES), "ranges")
    ranked = dense_rank_within(packed.withColumn("size", F.col("part_tokens")), ["source", "size"], [F.col("doc_id")], "rank", sized.count())
    placed = ranked.join(small_side(ranges, ranges.count(), 96), ["source", "size"]).where(F.col("rank").between(F.col("rank_from"), F.col("rank_to")))
    names = ["doc_id", "source", "tokens", "capacity", "part", "parts", "part_tokens"]
    number = F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_bin"))
    placed = placed.select(*names, F.concat_ws("#", "source", number.cast("string")).alias("container"), F.col("length").alias("container_length"), F.col("used").alias("container_used"))
    alone = items.where(~F.coalesce(loose, F.lit(False)))
    whole = F.col("part") < F.col("parts")
    alone = alone.select(
        *names, F.when(whole, F.concat_ws("#", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("part").cast("string"))).alias("container"),
        F.when(whole, F.col("capacity")).alias("container_length"), F.when(whole, F.col("capacity")).alias("container_used"))
    return placed.unionByName(alone)
