import random
import re

from tabweave.llm.splitting import plan_split, split_documents

DOCS = "doc_id bigint, text string, source string, cells array<struct<cell_no int, n_chars int>>"
LIMITS = "source string, piece_tokens int, overlap_tokens int"


def tokens(text):
    return re.findall(r"\w+|[^\w\s]+", text)


def brute(text, cells, limit, overlap):
    """Token by token: the last cell end, else line end, else the limit."""
    spans = [m.start() for m in re.finditer(r"\w+|[^\w\s]+", text)]
    at = lambda pos: sum(s < pos for s in spans)
    ends, p = set(), 0
    for n in cells:
        p += n + 2
        ends.add(at(p))
    lines = {at(i + 1) for i, c in enumerate(text) if c == "\n"}
    out, start = [], 0
    while len(spans) - start > limit:
        span = range(start + limit, start + overlap, -1)
        end = next((e for e in span if e in ends and e < len(spans)), None) or next((e for e in span if e in lines and e < len(spans)), None) or start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(spans))]


def test_against_brute_force():
    r = random.Random(7)
    for _ in range(200):
        cells = ["\n".join(" ".join(r.choice(["a", "b1", "é", "x.", "-"]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))]
        text, limit = "\n\n".join(cells), r.randint(2, 20)
        overlap = r.randint(0, limit - 1)
        got = plan_split(text, [len(c) for c in cells], limit, overlap)
        if len(tokens(text)) <= limit:
            assert got is None
            continue
        n, finest, pieces = got
        assert n == len(tokens(text)) and [(p["token_from"], p["token_to"]) for p in pieces] == brute(text, [len(c) for c in cells], limit, overlap)
        fit = lambda parts: all(len(tokens(x)) <= limit for x in parts)
        assert finest == ("cell" if fit(cells) else "line" if fit(text.split("\n")) else "inside")
        for p in pieces:
            assert p["token_to"] - p["token_from"] <= limit and tokens(text[p["char_from"] : p["char_to"]]) == tokens(text)[p["token_from"] : p["token_to"]]
        assert pieces[0]["char_from"] == 0 and pieces[-1]["char_to"] == len(text)


def test_documents(spark):
    text = "a b c\nd e 🙂\n\n" + "w " * 10
    rows = [(1, text, "s", [(1, 11), (2, 20)]), (2, text, "s", [(1, 5)]), (3, text, "s", None), (3, text, "s", None), (4, None, "s", None), (5, "", "s", []), (6, "a b", "s", None), (7, text, "t", None), (8, text, "s", [(1, None)]), (None, text, "s", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", piece string")
    out = split_documents(docs, spark.createDataFrame([("s", 6, 2), ("s", 9, 0)], LIMITS)).orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 8, None} and all(len(tokens(r.piece_text)) == r.token_to - r.token_from <= 6 for r in out)
    one = [r for r in out if r.doc_id == 1]
    assert one[0].cut == "cell" and one[0].piece_text == "a b c\nd e 🙂\n\n" and one[0].finest_cut == "inside" and one[1].repeated == 2
    assert split_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LIMITS)).count() == 0


def test_overlap_beyond_the_limit_still_ends():
    n, _, pieces = plan_split("a " * 50, None, 5, 99)
    assert n == 50 and pieces[-1]["token_to"] == 50 and all(p["token_to"] - p["token_from"] <= 5 for p in pieces)
