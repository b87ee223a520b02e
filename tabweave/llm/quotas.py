"""Samples whose class shares are as asked: integer quotas by min-cost flow, then rows drawn at random.

Each request is a small network with capacities and costs. The source feeds floors without a bound and margins, where a sample must
keep its size, up to what the floors leave of it, so there the classes compete. A class has an arc for its floor, one for its fair
part of the margins (what it asks for beyond its floor, in proportion to the room there is) and a dearer one for the rest of what it
asks for, which it gets only where others have no rows for theirs; it feeds the strata in which it has rows, as far as they go; a
stratum drains at no cost up to its share of the sample and at unit cost beyond. A slack arc, dearer than any detour, takes what the
rows of a class do not supply: its flow is the shortfall.

Rows meet the requests only as counts. Requests are dealt to a counted number of tasks, since solving is work for the processor and
little data. The draw numbers the rows of each cell in a hashed order (hot cells in parts) and a request takes a run of that order from
a random place, so only drawn rows are joined.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.missing import ALL_TOKENS, bare, text_missing
from tabweave.plans.physical import dense_rank_within, materialize

UNKNOWN = "unknown"
QUOTAS = "request_id bigint, label string, stratum string, need bigint, have bigint, quota bigint, short bigint, given_up bigint, over bigint, cell_rows bigint"
#: Requests solved by one task.
REQUESTS_PER_TASK = 250
#: Costs of a unit by the arc it takes, each more than any detour at the level below; a stratum beyond its share costs 1.
FAIR, REST, LACKING = 10, 1_000, 100_000


class Network:
    """Integer minimum-cost flow: shortest paths by cost give potentials, and all paths of the least cost are filled before the next."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        while len(self.out) <= max(a, b):
            self.out.append([])
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def _distances(self, s: int) -> list[float]:
        """Cost of the cheapest path with room from `s` to each node."""
        far = [float("inf")] * len(self.out)
        far[s], queue, queued = 0, [s], {s}
        for x in queue:
            queued.discard(x)
            base = far[x]
            for e in self.out[x]:
                if self.room[e] and base + self.cost[e] < far[self.to[e]]:
                    y = self.to[e]
                    far[y] = base + self.cost[e]
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        return far

    def run(self, s: int, t: int) -> int:
        total, to, room, cost = 0, self.to, self.room, self.cost
        while True:
            far = self._distances(s)
            if far[t] == float("inf"):
                return total
            at, seen = [0] * len(self.out), [False] * len(self.out)
            while True:  # fill the paths of this cost one after the other, leaving dead ends behind
                path, x, on = [], s, {s}
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        y = to[e]
                        if room[e] and far[x] + cost[e] == far[y] and not seen[y] and y not in on:
                            break
                        at[x] += 1
                    if at[x] == len(self.out[x]):
                        seen[x] = True
                        if not path:
                            break
                        on.discard(x)
                        x = to[path.pop() ^ 1]
                        at[x] += 1
                        continue
                    path.append(e)
                    on.add(y)
                    x = y
                if x != t:
                    break
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                total += push


def fair_parts(wants: dict[str, int], room: int) -> dict[str, int]:
    """Whole parts of `room` in proportion to `wants`, the largest remainders rounded up (ties by name), none above its want."""
    whole = sum(wants.values())
    if whole <= room:
        return dict(wants)
    exact = {c: w * room for c, w in wants.items()}
    parts = {c: e // whole for c, e in exact.items()}
    for c in sorted(wants, key=lambda c: (-(exact[c] % whole), c))[: room - sum(parts.values())]:
        parts[c] += 1
    return parts


def solve_quotas(needs: dict[str, tuple[int, int]], cells: dict[tuple[str, str], int], seed: int, size: int | None = None) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """(quota of each cell, what the load lacks of each class): solve_sample() without what classes give up."""
    quota, short, _ = solve_sample(needs, cells, seed, size)
    return quota, short


def solve_sample(needs: dict[str, tuple[int, int]], cells: dict[tuple[str, str], int], seed: int, size: int | None = None) -> tuple[dict[tuple[str, str], int], dict[str, int], dict[str, int]]:
    """(quota of each cell, what the load lacks of each class, what each class gives up). needs: class -> (floor, margin), of which the
    larger is asked for. With `size` the sample has no more rows than that unless the floors alone have."""
    rng = random.Random(seed)
    classes, strata = sorted(needs), sorted({k for _, k in cells})
    asked = {c: max(needs[c]) for c in classes}
    have, by = dict.fromkeys(classes, 0), dict.fromkeys(strata, 0)
    for (c, k), n in cells.items():
        by[k] += n
        have[c] += n
    floor = {c: min(needs[c][0], asked[c]) for c in classes}
    rest = {c: asked[c] - floor[c] for c in classes}
    room = sum(rest.values()) if size is None else min(sum(rest.values()), max(0, size - sum(min(floor[c], have[c]) for c in classes)))
    fair = fair_parts(rest, room)
    whole, total = sum(by.values()), sum(floor.values()) + room
    # Integer shares of the strata by systematic rounding from a random start.
    at, target, passed = rng.random(), {}, 0
    run = 0.0
    for k in strata:
        run += total * by[k] / whole if whole else 0
        target[k], passed = int(run + at) - passed, int(run + at)
    net, s, t, margins = Network(), 0, 1, 2
    node = {c: 3 + i for i, c in enumerate(classes)} | {("", k): 3 + len(classes) + i for i, k in enumerate(strata)}
    order = list(cells)
    rng.shuffle(order)
    arcs = {ck: net.arc(node[ck[0]], node["", ck[1]], cells[ck]) for ck in order}
    for k in strata:
        net.arc(node["", k], t, target[k])
        net.arc(node["", k], t, total, 1)
    net.arc(s, margins, room)
    for c in classes:
        net.arc(s, node[c], floor[c])
        net.arc(margins, node[c], fair[c], FAIR)
        net.arc(margins, node[c], rest[c] - fair[c], REST)
    slack = {c: net.arc(node[c], t, asked[c], LACKING) for c in classes}
    net.run(s, t)
    quota, got = {ck: net.flow(a) for ck, a in arcs.items()}, dict.fromkeys(classes, 0)
    for (c, _), q in quota.items():
        got[c] += q
    # Without a size all that is asked for flows, and slack holds what the load lacks; with one, slack may hold part of it.
    short = {c: net.flow(slack[c]) if size is None else max(0, asked[c] - have[c]) for c in classes}
    return quota, short, {c: asked[c] - short[c] - got[c] for c in classes}


def _solve(seed: int, keep_size: bool):
    names = [x.split()[0] for x in QUOTAS.split(", ")]

    def solved(request: int, rows: list[tuple]) -> Iterator[tuple]:
        needs = {label: (int(f), int(m)) for label, _, f, m, _, _ in rows}
        cells = {(label, k): int(n) for label, k, _, _, n, _ in rows if n is not None}
        size = max(0, int(rows[0][5] or 0)) if keep_size else None
        quota, short, given = solve_sample(needs, cells, seed * 1_000_003 + request, size)
        have = dict.fromkeys(needs, 0)
        for (c, _), n in cells.items():
            have[c] += n
        over = max(0, sum(quota.values()) - size) if keep_size else 0
        for (c, k), q in quota.items():
            yield request, c, k, max(needs[c]), have[c], q, short[c], given[c], over, cells[c, k]
        for c in needs:
            if not have[c]:
                yield request, c, None, max(needs[c]), 0, 0, short[c], given[c], over, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        out: list[tuple] = []
        for request, own in groupby(rows, key=lambda r: r[0]):
            out += solved(request, [r[1:] for r in own])
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("label", "stratum") else pa.int64()) for n, c in zip(names, zip(*out))], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("label", "stratum") else pa.int64()) for n, c in zip(names, zip(*out))], names=names)

    return run


def label_of(c: Column, tokens: tuple[str, ...] = ALL_TOKENS) -> Column:
    return F.when(text_missing(c, tokens), F.lit(UNKNOWN)).otherwise(bare(c))


def _members(rows: DataFrame, label: str, stratum: str) -> DataFrame:
    """One row a distinct (dataset_id, load_no, row_no) and class: label, stratum (the least if copies differ) and the least row_id."""
    base = rows.select("dataset_id", "load_no", "row_no", label_of(F.col(label)).alias("label"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "row_id")
    return base.groupBy("dataset_id", "load_no", "row_no", "label").agg(F.min("stratum").alias("stratum"), F.min("row_id").alias("row_id"))


def quotas(rows: DataFrame, targets: DataFrame, label: str = "churn_risk", stratum: str = "site_code", seed: int = 42, members: DataFrame | None = None, keep_size: bool = False) -> DataFrame:
    """(request_id, label, stratum, need, have, quota, short, given_up, over, cell_rows, dataset_id, load_no, class_label): how many rows of
    each cell a request takes.

    targets: request_id, dataset_id, load_no, sample_size, min_per_class, class_label, target_share. A class needs the larger of its
    minimum and its share of the sample rounded half up; short is what its load lacks. Without `keep_size` every class gets what it
    needs as far as there are rows, and minima may lift a sample above its size. With it the sample has at most sample_size rows:
    minima are kept and margins give way in proportion (given_up, by class); only where the minima alone pass the size does the sample,
    by `over` rows. Labels are compared trimmed and ignoring case; UNKNOWN is a missing label; a null target share, minimum or size is
    0. A class without rows has one line with a null stratum. Rows with a null load or row number are left out, as are requests without
    an id or load.
    """
    members = _members(rows, label, stratum) if members is None else members
    cells = members.groupBy("dataset_id", "load_no", "label", "stratum").agg(F.count("row_no").alias("n"))
    share = F.coalesce(F.col("target_share").try_cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)")) * F.coalesce(F.col("sample_size"), F.lit(0))
    asked = targets.where(F.col("request_id").isNotNull()).select(
        "request_id", "dataset_id", "load_no", "class_label", label_of(F.col("class_label")).alias("label"), F.coalesce(F.col("sample_size"), F.lit(0)).cast("bigint").alias("size_"),
        F.greatest(F.coalesce(F.col("min_per_class"), F.lit(0)), F.lit(0)).cast("bigint").alias("floor_"), F.floor(share + F.lit(0.5).cast("decimal(2,1)")).cast("bigint").alias("margin"))
    asked = asked.groupBy("request_id", "dataset_id", "load_no", "label").agg(F.min("class_label").alias("class_label"), F.max("floor_").alias("floor_"), F.sum("margin").alias("margin"), F.max("size_").alias("size_"))
    net = asked.select("request_id", "dataset_id", "load_no", "label", "floor_", "margin", "size_").join(cells, ["dataset_id", "load_no", "label"], "left")
    tasks = max(1, min(100_000, -(-targets.count() // (4 * REQUESTS_PER_TASK))))
    dealt = net.select("request_id", "label", "stratum", "floor_", "margin", "n", "size_").repartition(tasks, "request_id").sortWithinPartitions("request_id", "label", "stratum")
    solved = dealt.mapInArrow(_solve(seed, keep_size), QUOTAS)
    return solved.join(asked.select("request_id", "label", "dataset_id", "load_no", "class_label"), ["request_id", "label"])


def draw_sample(rows: DataFrame, targets: DataFrame, label: str = "churn_risk", stratum: str = "site_code", seed: int = 42, keep_size: bool = False) -> DataFrame:
    """(request_id, class_label, dataset_id, load_no, row_no, row_id): the drawn rows, each at most once a request, by quotas()."""
    members = materialize(_members(rows, label, stratum).where(F.col("dataset_id").isNotNull() & F.col("load_no").isNotNull() & F.col("row_no").isNotNull()), "members")
    keys = ["dataset_id", "load_no", "label", "stratum"]
    wanted = quotas(rows, targets, label, stratum, seed, members, keep_size).where(F.col("quota") > 0)
    start = F.pmod(F.xxhash64(F.lit(seed), "request_id", "label", "stratum"), F.col("cell_rows"))
    wanted = wanted.withColumn("start", start).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)))
    wanted = wanted.select("request_id", "class_label", *keys, (F.pmod(F.col("start") + F.col("step"), F.col("cell_rows")) + 1).alias("place"))
    ranked = dense_rank_within(members, keys, [F.lit(seed), F.col("row_no")], "place", members.count())
    return wanted.join(ranked, [*keys, "place"]).select("request_id", "class_label", "dataset_id", "load_no", "row_no", "row_id")


def sample_report(quota: DataFrame) -> DataFrame:
    """(request_id, class_label, need, have, got, short, given_up, share, over): what each class of a request asked for, has and got; its
    share of the sample, and by how many rows the minima alone pass the sample's size."""
    one = quota.groupBy("request_id", "class_label").agg(*[F.max(k).alias(k) for k in ("need", "have", "short", "given_up", "over")], F.sum("quota").alias("got"))
    sizes = quota.groupBy("request_id").agg(F.sum("quota").alias("drawn"))
    return one.join(sizes, "request_id").select("request_id", "class_label", "need", "have", "got", "short", "given_up", (F.col("got") / F.nullif(F.col("drawn"), F.lit(0))).alias("share"), "over")


def shortfalls(quota: DataFrame) -> DataFrame:
    """(request_id, class_label, need, have, short) of the classes that fall short."""
    return quota.where(F.col("short") > 0).groupBy("request_id", "class_label").agg(F.max("need").alias("need"), F.max("have").alias("have"), F.max("short").alias("short"))
