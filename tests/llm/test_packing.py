import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.llm.packing import pack_documents, pack_histogram
from tabweave.llm.tokens import code_points, count, token_starts

DOCS = "doc_id bigint, text string, source string"
LIMITS = "source string, capacity_tokens int"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1_ \n\t.,é²½́ 　漢🙂-"), max_size=40))
def test_tokens_are_those_of_the_regex(text):
    found = [m.start() for m in re.finditer(r"\w+|[^\w\s]+", text)]
    assert count(text) == len(found)
    assert not text or token_starts(code_points(text)).tolist() == found


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30), st.sampled_from([[64], [16, 32, 64], [64, 48, 32]]))
def test_every_item_has_one_place_and_no_bin_overflows(sizes, lengths):
    used, room, seen = defaultdict(int), {}, Counter()
    for s, lo, hi, k, first, length, content in pack_histogram(list(sizes), list(sizes.values()), lengths):
        for rank in range(lo, hi + 1):
            b = first + (rank - lo) // k
            used[b] += s
            room[b] = (length, content)
            seen[s, rank] += 1
    assert set(seen) == {(s, r) for s, n in sizes.items() for r in range(1, n + 1)} and set(seen.values()) == {1}
    for b, total in used.items():
        length, content = room[b]
        assert total == content <= length and length == min(x for x in lengths if x >= total)


def test_little_room_is_left():
    import random

    r = random.Random(4)
    sizes = Counter(r.randint(20, 900) for _ in range(20_000))
    bins = {}
    for s, lo, hi, k, first, length, content in pack_histogram(list(sizes), list(sizes.values()), [1024, 768, 512, 256]):
        for b in range(first, first + (hi - lo) // k + 1):
            bins[b] = (length, content)
    assert sum(c for _, c in bins.values()) / sum(n for n, _ in bins.values()) > 0.99


def test_documents(spark):
    rows = [(1, "a " * 25, "s"), (2, "a " * 4, "s"), (3, "a " * 6, "s"), (3, "a " * 6, "s"), (4, "", "s"), (5, None, "s"), (6, "a b", "none"), (7, "a b", None), (None, "a", "s")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", rank int")
    out = pack_documents(docs, spark.createDataFrame([("s", 10), ("s", 12), ("x", 5)], LIMITS)).collect()
    assert len(out) == len(rows) + 2
    load = defaultdict(int)
    for r in out:
        if r.container:
            load[r.container, r.container_length, r.container_used] += r.part_tokens
    assert all(used == total <= length for (_, length, used), total in load.items())
    assert sorted(r.part_tokens for r in out if r.doc_id == 1) == [5, 10, 10]
    assert {r.doc_id for r in out if r.container is None} == {4, 5, 6, 7}
    assert pack_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LIMITS)).count() == 0


def test_hot_size(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source")
    out = pack_documents(docs, spark.createDataFrame([("s", 10)], LIMITS))
    assert out.groupBy("container").count().agg({"count": "max"}).first()[0] == 3 and out.select("container").distinct().count() == 300
