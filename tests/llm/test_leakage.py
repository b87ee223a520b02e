import random

from tabweave.llm.leakage import BAND, LEAST, RATE, ItemIndex, leaked_items, words_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, suite string, prompt string"


def qualifies(item, doc):
    """Whether a stretch of 20 item words or more stands in doc within one edit in eight: edit distances from every start, no candidates."""
    for s in range(len(item) - LEAST + 1):
        row = [0] * (len(doc) + 1)
        for i in range(s, min(len(item), s + 2 * LEAST)):
            new = [row[0] + 1]
            for j, w in enumerate(doc, 1):
                new.append(min(row[j - 1] + (w != item[i]), row[j] + 1, new[-1] + 1))
            row = new
            if i - s + 1 >= LEAST and min(row) * RATE <= i - s + 1:
                return True
    return False


def edited(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(f"z{r.randint(0, 9)}" if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(f"y{r.randint(0, 9)}")
    return out


def test_against_every_alignment():
    r = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    items = {i: [r.choice(pool) for _ in range(r.randint(15, 50))] for i in range(12)}
    index = ItemIndex([(i, " ".join(w)) for i, w in items.items()])
    pairs = hits = 0
    for d in range(120):
        item = r.choice(list(items))
        n = r.randint(14, len(items[item]))
        a = r.randint(0, len(items[item]) - n)
        doc = [r.choice(pool) for _ in range(r.randint(0, 15))] + edited(r, items[item][a : a + n], r.choice([0, 0.05, 0.1, 0.15, 0.2])) + [r.choice(pool) for _ in range(r.randint(0, 15))]
        got = {x[1] for x in index.hits(d, " ".join(doc))}
        want = {i for i, w in items.items() if qualifies(w, doc)}
        assert got == want
        pairs, hits = pairs + len(items), hits + len(want)
    assert 20 < hits < pairs and BAND == 4


def test_marks_do_not_matter():
    assert words_of("<p>The **Old**\n> _mill_, 5&nbsp;oars;<br>run\\nfast a_b __x__</p>") == ["the", "old", "mill", "5", "oars", "run", "fast", "a_b", "x"]
    assert words_of("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_documents(spark):
    prompt = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, "a", prompt, "k"), (2, "b", prompt.upper(), "k"), (3, "a", "short one", "k"), (4, "a", None, "k"), (None, "a", prompt, "k")], ITEMS + ", doc_id string")
    rows = [(1, "x " * 500 + "> " + prompt.replace(" ", "\n> ") + " y" * 500), (1, "x " * 500 + prompt), (2, " ".join(prompt.split()[:17])), (3, None), (4, ""), (5, "z" * 300_000), (6, " ".join(prompt.split()[5:25]).replace("word9 ", "other ").replace("word15 ", "")), (None, prompt)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", item_id int")
    expected = {(1, 1), (1, 2), (6, 1), (6, 2)}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == expected and leaked_items(docs, items).count() == 4
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items, per_block=1).collect()} == expected
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_markup_of_any_length():
    words = [f"word{i}" for i in range(40)]
    index = ItemIndex([(1, " ".join(words))])
    tag = '<img src="data:image/png;base64,' + "A" * 400 + '" alt="a picture of words">'
    assert [x[1] for x in index.hits(1, f" {tag} ".join(words))] == [1]
    assert [x[1] for x in index.hits(1, " <!-- a note\nof two lines, " + "x " * 300 + "--> ".join(words))] == [1]
    assert words_of("if a<b and c>d: " + "e " * 200) == ["if", "a", "d"] + ["e"] * 200 and words_of("a<b " + "e " * 200 + "c>d")[-1] == "d"


def test_long_documents_are_cut_without_loss(spark):
    r = random.Random(2)
    items = [(i, " ".join(f"i{i}w{r.randint(0, 30)}" for _ in range(30))) for i in range(40)]
    text = " ".join(p for _ in range(6) for _, p in r.sample(items, 40))
    index = ItemIndex(items)
    assert {x[1] for x in index.hits(1, text)} == set(range(40))
    docs = spark.createDataFrame([(1, text), (2, " ".join(w for w in items[3][1].split())[:-1])], DOCS)
    found = {(x.doc_id, x.item_id) for x in leaked_items(docs, spark.createDataFrame([(i, "s", p) for i, p in items], ITEMS)).collect()}
    assert found == {(1, i) for i in range(40)} | {(2, 3)}


def test_a_shared_template_is_no_leak(spark):
    """Items share a template of 12 words, which many documents hold: none of them holds 20 words of an item."""
    template = " ".join(f"t{i}" for i in range(12))
    items = spark.createDataFrame([(i, "s", template + " " + " ".join(f"q{i}x{j}" for j in range(15))) for i in range(200)], ITEMS)
    docs = spark.createDataFrame([(i, f"before {template} after {i}") for i in range(300)] + [(999, template + " " + " ".join(f"q7x{j}" for j in range(15)))], DOCS)
    assert [(x.doc_id, x.item_id) for x in leaked_items(docs, items).collect()] == [(999, 7)]


def test_thresholds_are_the_fewest_left():
    from tabweave.llm.leakage import size_class, thresholds

    def cuts(kept, runs):
        if runs == 1:
            yield (kept,)
            return
        for r in range(kept + 1):
            yield from ((r, *rest) for rest in cuts(kept - r, runs - 1))

    shingles = min(sum(max(0, r - 4) for r in c) for n in range(20, 24) for c in cuts(n - 2, 3))
    elements = min(sum(max(0, r - 4) // 2 for r in c) for n in range(20, 24) for c in cuts(n - 2, 3))
    assert thresholds(23) == (elements, shingles) == size_class(21) and size_class(100)[0] == 1
