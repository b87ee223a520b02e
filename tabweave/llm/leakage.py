"""Which documents hold passages of which held-out items: MinHash containment search over size-partitioned passages.

A whole document is hundreds of times longer than the stretch of an item that may have leaked into it, so the Jaccard
similarity that a MinHash of whole sets estimates drowns. Both sides are therefore cut to passages of one size before they are
sketched: WINDOW neighbouring shingles of WORDS words. The sketch of a passage is the minimum of its hashed shingles, and the
signature of a text is the set of those minima with their places. Two passages that hold the same words have the same minimum, so
equal minima are the candidates. With five words and two shingles a passage is six words long, and that makes the search complete: a
stretch of 20 words with at most one word in eight changed, dropped or inserted has at most two edits, which leave a run of six
words or more (longer ones likewise).

Items are partitioned by size, and each partition has its own thresholds (see thresholds()): how many elements of its signature an
item must have in common with a document's neighbourhood, and how many of its shingles must be contained in it. Both are the fewest
that a qualifying stretch of an item of that size can leave, so nothing that qualifies is lost.

Candidates are verified on the words themselves: by exact containment of the item's shingles in the stretch of the document
around them, then by edits. A stretch of L item words qualifies if L >= 20 and its edits are at most L / 8. A qualifying
stretch of 40 words or more has a qualifying part under 40, so at most 4 edits and a band of 4 diagonals either side of the
candidate need be looked at.

The documents are read once, whatever the number of items. Words are 64-bit hashes, the same everywhere, so that both sides meet by a
join of minima. A Bloom filter of the items' shingles, whose size has a bound, goes to the workers; of a document only the neighbourhoods
of minima that pass it leave its task, as hashed words, and only where as many shingles around pass it as the smallest threshold of
containment asks for. What the filter lets through by chance, the join drops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.physical import materialize

WORDS, WINDOW, LEAST, RATE, BAND = 5, 2, 20, 8, 4
REACH = 2 * LEAST
HITS = "doc_id bigint, item_id bigint, item_word bigint, words bigint, edits bigint, shared_shingles bigint, item_shingles bigint"
#: Lower ends of the size partitions of items, in words.
SIZES = (20, 24, 32, 64, 128, 256, 1024)
#: Bits of the filter for each minimum, hashed places of one, and the most bits there are (16 MB).
BITS_EACH, PROBES, MOST_BITS = 64, 3, 1 << 27
#: Words of a neighbourhood after which it is cut, parts overlapping by more than a stretch spans.
NEAR = 512

# A tag of up to 300 characters on a line, one of any length whose attributes have values, or a comment.
TAG = re.compile(r"</?[A-Za-z!][^<>\n]{0,300}>|<[A-Za-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))+\s*/?>|<!--.*?-->", re.DOTALL)
ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#[0-9]{1,6}|#x[0-9A-Fa-f]{1,5});")
ESCAPE = re.compile(r"\\[nrtfv\"'/]")
WORD = re.compile(r"\w+")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[str]:
    """Words in lower case; mark-up tags, entities, written escapes, punctuation and underscores around words do not count."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(" ", text)
    if "\\" in text:
        text = ESCAPE.sub(" ", text)
    found = WORD.findall(text.lower())
    return [w for x in found if (w := x.strip("_"))] if "_" in text else found


class _Hashes(dict):
    """64-bit hashes of words, worked out once a word; forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63
        self[word] = h = h if h != OUTSIDE else OUTSIDE + 1
        return h


#: Stands for no word in a row of item words.
OUTSIDE = -2
_HASHES = _Hashes()


def hashed_words(text: str) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.int64, len(found))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    wide, h = words.view(np.uint64), np.zeros(n, np.uint64)
    for k in range(WORDS):
        part = wide[k : k + n] + MIX[k]
        h = (h ^ (part * MIX[(k + 1) % WORDS])) * MIX[k]
        h ^= h >> np.uint64(29)
    return h


def signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the shingles that are the MinHash of a passage of WINDOW shingles, the first one if tied."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for k in range(1, WINDOW):
        less = h[k : k + n] < least
        least[less], at[less] = h[k : k + n][less], np.flatnonzero(less) + k
    places = np.unique(at)
    return places, h[places].view(np.int64)


@lru_cache(None)
def thresholds(most: int) -> tuple[int, int]:
    """(elements of the signature, shingles): the fewest that a qualifying stretch of an item of at most `most` words leaves unharmed,
    over all ways in which its edits cut it into runs."""
    def fewest(kept: int, runs: int, of: int) -> int:
        best = {0: 0}
        for _ in range(runs):
            new: dict[int, int] = {}
            for used, got in best.items():
                for r in range(kept - used + 1):
                    v = got + max(0, r - WORDS + 1) // of
                    if v < new.get(used + r, 1 << 30):
                        new[used + r] = v
            best = new
        return best[kept]

    lengths = [(L, L // RATE) for L in range(LEAST, min(most, REACH - 1) + 1)]
    return tuple(max(1, min(fewest(L - e, e + 1, of) for L, e in lengths)) for of in (WINDOW, 1))


def size_class(n: int) -> tuple[int, int]:
    """(elements, shingles) that the partition of items of n words asks for."""
    above = [b for b in SIZES if b > n]
    return thresholds(above[0] - 1 if above else 1 << 20)


def fewest_edits(a: np.ndarray, b: np.ndarray, p: int, d: int) -> tuple[int, int, int] | None:
    """(first item word, words, edits) of a qualifying stretch of item words `a` near the diagonal `d` around item word `p`, or None.

    `a` runs down, the document's words `b` along 2 x BAND + 1 diagonals; every row may begin a stretch, all at once.
    """
    lo, hi = max(0, p - REACH + WORDS + WINDOW - 1), min(len(a), p + REACH)
    if hi - lo < LEAST:
        return None
    offs = np.arange(-BAND, BAND + 1)
    cols = np.arange(lo, hi)[:, None] + d + offs
    inside = (cols >= 0) & (cols < len(b))
    same = inside & (b[np.clip(cols, 0, max(len(b) - 1, 0))] == a[lo:hi, None])
    far = 1_000
    best = np.full((hi - lo, 2 * BAND + 1), far, np.int32)
    for r in range(hi - lo):
        best[r] = 0
        live = best[: r + 1]
        new = live + np.where(same[r], 0, np.where(inside[r], 1, far))
        new[:, :-1] = np.minimum(new[:, :-1], live[:, 1:] + 1)
        new = np.minimum.accumulate(new - offs, axis=1) + offs
        best[: r + 1] = new
        length = r + 1 - np.arange(r + 1)
        least = new.min(1)
        good = np.flatnonzero((length >= LEAST) & (least * RATE <= length))
        if len(good):
            s = int(good[0])
            return lo + s, int(length[s]), int(least[s])
    return None


def may_qualify(rows: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which candidates can hold a qualifying stretch at all. rows: item words around each candidate (OUTSIDE outside the item); at: the
    document place that belongs to each candidate's first row. An item word that stands nowhere in the band costs at least one edit,
    so a stretch with a negative sum of 1 a word found and 1 - RATE a word not found cannot qualify."""
    cols = at[:, None, None] + np.arange(rows.shape[1])[None, :, None] + np.arange(-BAND, BAND + 1)
    inside = (cols >= 0) & (cols < len(b))
    found = (inside & (b[np.clip(cols, 0, len(b) - 1)] == rows[:, :, None])).any(2)
    run = np.where(rows == OUTSIDE, -10_000, np.where(found, 1, 1 - RATE)).cumsum(1)
    run = np.concatenate([np.zeros((len(rows), 1), run.dtype), run], axis=1)
    return ((run[:, LEAST:] - np.minimum.accumulate(run[:, :-LEAST], axis=1)) >= 0).any(1)


#: Shingles that any qualifying stretch leaves, whatever the size of its item.
FEWEST = min(thresholds(b)[1] for b in (*SIZES, 1 << 20))


def verify(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray, places: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(item word, words, edits, shared shingles, item shingles) of the first qualifying stretch of item words `a` in the neighbourhood
    `b`, at candidates given by their place in the item and the diagonal they lie on; None if there is none."""
    order = np.lexsort((places, diagonals))
    places, diagonals = places[order], diagonals[order]
    gap = np.full(REACH, OUTSIDE, np.int64)
    flat = np.concatenate([gap, a, gap])
    able = np.concatenate([may_qualify(flat[places[k : k + 1000, None] + np.arange(2 * REACH)], b, (places + diagonals)[k : k + 1000] - REACH) for k in range(0, len(places), 1000)])
    if not able.any():
        return None
    mine, theirs = shingle_hashes(a), shingle_hashes(b)
    least = size_class(len(a))[1]
    for i in np.flatnonzero(able):
        p, d = int(places[i]), int(diagonals[i])
        near = theirs[max(0, p + d - REACH - BAND) : max(0, p + d + REACH + BAND)]
        shared = int(np.isin(mine[max(0, p - REACH) : p + REACH], near).sum())
        if shared >= least:
            found = fewest_edits(a, b, p, d)
            if found:
                return *found, shared, len(mine)
    return None


def probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of each value in a filter of `bits` (a power of two) bits."""
    v = values.view(np.uint64)
    return [((v * MIX[k]) >> np.uint64(20)) & np.uint64(bits - 1) for k in range(PROBES)]


class Filter:
    """A Bloom filter as an array of 64-bit words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def passes(self, values: np.ndarray) -> np.ndarray:
        ok = np.ones(len(values), bool)
        for at in probes(values, 64 * len(self.words)):
            ok &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def neighbourhoods(words: np.ndarray, sieve: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, values, places): the parts of a document around the elements of its signature that pass the filter, if enough shingles
    around them do. Elements within REACH words of each other share a part; a part of many is cut so that whatever a stretch spans lies
    whole in one."""
    h = shingle_hashes(words)
    passed = sieve.passes(h.view(np.int64)) if len(h) else np.zeros(0, bool)
    if passed.sum() < FEWEST:
        return
    places, values = signature(h)
    upto, near = np.concatenate([[0], np.cumsum(passed)]), REACH + BAND
    around = upto[np.minimum(places + near, len(h))] - upto[np.maximum(places - near, 0)]
    have = np.flatnonzero(passed[places] & (around >= FEWEST))
    if not len(have):
        return
    places, values = places[have], values[have]
    for own in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > REACH) + 1):
        first, last = places[own[0]], places[own[-1]]
        for at in range(int(first), int(last) + 1, NEAR - 2 * (REACH + BAND)):
            part = own[(places[own] >= at) & (places[own] < at + NEAR)]
            if len(part) and (at == first or places[part[-1]] >= at + 2 * (REACH + BAND)):
                lo = max(0, int(places[part[0]]) - REACH - BAND)
                hi = int(places[part[-1]]) + REACH + BAND + WORDS + WINDOW
                yield words[lo:hi], values[part], places[part] - lo


class ItemIndex:
    """The search over items held in memory, for texts one at a time: what leaked_items() does by joins."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.words: dict[int, np.ndarray] = {}
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        for item, prompt in items:
            a = hashed_words(prompt or "")
            if len(a) >= LEAST:
                self.words[item] = a
                for place, value in zip(*(x.tolist() for x in signature(shingle_hashes(a)))):
                    self.seeds.setdefault(value, []).append((item, place))
        every = [shingle_hashes(a).view(np.int64) for a in self.words.values()]
        values, bits = np.concatenate(every) if every else np.zeros(0, np.int64), 1 << 16
        words = np.zeros(bits // 64, np.uint64)
        for at in probes(values, bits):
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.sieve = Filter(words)

    def hits(self, doc: int, text: str) -> Iterator[tuple]:
        done: set[int] = set()
        for b, values, places in neighbourhoods(hashed_words(text), self.sieve):
            found: dict[int, dict[tuple[int, int], int]] = {}
            common: dict[int, set[int]] = {}
            for value, at in zip(values.tolist(), places.tolist()):
                for item, place in self.seeds.get(value, ()):
                    common.setdefault(item, set()).add(place)
                    key = (at - place, place // WORDS)
                    found.setdefault(item, {})[key] = min(place, found.get(item, {}).get(key, place))
            for item, own in found.items():
                if item not in done and len(common[item]) >= size_class(len(self.words[item]))[0]:
                    hit = verify(self.words[item], b, np.array([d for d, _ in own], np.int64), np.array(list(own.values()), np.int64))
                    if hit:
                        done.add(item)
                        yield doc, item, *hit


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(int(i), w, size_class(len(w))[0]) for i, t in zip(b["item_id"], b["prompt"]) if len(w := hashed_words(t)) >= LEAST]
        yield pd.DataFrame(rows, columns=["item_id", "words", "least"])


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, place, value) for k, w in zip(b["item"].tolist(), b["words"]) for place, value in zip(*(x.tolist() for x in signature(shingle_hashes(np.asarray(w, np.int64)))))]
        yield pd.DataFrame(rows, columns=["item", "place", "value"])


def _filter_of(own: DataFrame) -> Filter:
    """The filter of all shingles of the items: made of words that hold a bit, of which there are at most MOST_BITS / 64."""
    bits, many = 1 << 16, own.agg(F.sum(F.size("words"))).first()[0] or 0
    while bits < min(MOST_BITS, BITS_EACH * many):
        bits *= 2

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [shingle_hashes(np.asarray(w, np.int64)).view(np.int64) for w in b["words"]]
            at = np.concatenate(probes(np.concatenate(values), bits)) if values else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    held = own.select("words").mapInPandas(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(words)


def leaked_items(docs: DataFrame, items: DataFrame, per_block: int | None = None) -> DataFrame:
    """(doc_id, item_id, item_word, words, edits, shared_shingles, item_shingles): each pair of a document and an item it gives away.

    docs: doc_id, text; items: item_id, prompt. item_word is where in the prompt a qualifying stretch of `words` words begins (from
    0), shared_shingles how many of the item's five-word shingles stand in that part of the document. Every item that qualifies
    counts, also one with the words of another. A word dropped at an end is an edit like any other: 18 words as they stand qualify as 20
    with two dropped. Items of under 20 words, null and empty texts give nothing; a pair comes out once,
    however often its rows are repeated; other columns are ignored. Documents are read once whatever `per_block` says: it cut items into
    blocks before they met by a join.

    A minimum that many items share (a prompt's template) and many documents hold is a hot key of the join of minima, which adaptive
    execution splits on either side; texts are not part of that join.
    """
    spark = docs.sparkSession
    listed = items.select(F.col("item_id").cast("bigint").alias("item_id"), "prompt").where(F.col("item_id").isNotNull() & F.col("prompt").isNotNull()).distinct()
    own = materialize(listed.mapInPandas(_item_words, "item_id bigint, words array<bigint>, least int").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = own.select("item", "words").mapInPandas(_item_seeds, "item bigint, place int, value bigint")
    sieve = spark.sparkContext.broadcast(_filter_of(own))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(doc), *part) for doc, t in zip(b["doc_id"], b["text"]) for part in neighbourhoods(hashed_words(t), sieve.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "near", "values", "places"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    parts = text.mapInPandas(near, "doc_id bigint, near array<bigint>, values array<bigint>, places array<int>").withColumn("part", F.monotonically_increasing_id())
    parts = materialize(parts, "neighbourhoods")
    seen = parts.select("part", F.explode(F.arrays_zip("values", "places")).alias("e")).select("part", F.col("e.values").alias("value"), F.col("e.places").alias("at"))
    met = seen.join(seeds, "value").select("part", "item", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    # Neighbouring elements of one diagonal lead to the same stretch: one in WORDS words is tried.
    tried = met.groupBy("part", "item", "diagonal", F.floor(F.col("place") / WORDS).alias("slot")).agg(F.min("place").alias("place"), F.collect_set("place").alias("all"))
    pairs = tried.groupBy("part", "item").agg(F.collect_list(F.struct("diagonal", "place")).alias("tried"), F.size(F.array_distinct(F.flatten(F.collect_list("all")))).alias("common"))
    full = pairs.join(own, "item").where(F.col("common") >= F.col("least")).join(parts.select("part", "doc_id", "near"), "part")
    full = full.select("doc_id", "item_id", "words", "near", F.col("tried.diagonal").alias("diagonals"), F.col("tried.place").alias("places"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for doc, item, *arrays in zip(b["doc_id"], b["item_id"], b["words"], b["near"], b["diagonals"], b["places"]):
                hit = verify(*(np.asarray(x, np.int64) for x in arrays))
                if hit:
                    found.append((doc, item, *hit))
            yield pd.DataFrame(found, columns=[x.split()[0] for x in HITS.split(", ")])

    return full.mapInPandas(check, HITS).groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "item_word", "words", "shared_shingles", "item_shingles")).alias("h")).select(
        "doc_id", "item_id", "h.item_word", "h.words", "h.edits", "h.shared_shingles", "h.item_shingles")


def leak_report(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents, longest): every leaked item with the number of documents that give it away."""
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest")).join(items.select("item_id", "suite"), "item_id")
