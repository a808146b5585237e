"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over the whole corpus give IDF weights. A word weighs
   sqrt(tf) idf^2 on either side, so that rare words decide.
2. Benchmark items are cut into passages of 32 words, every 16. A distributed randomised SVD of their
   TF-IDF rows gives a latent space of half as many dimensions as passages, 256 at most: it spans what is searched for,
   so its size follows the benchmark and not the corpus. A large benchmark is dealt into groups, each with a space
   of its own; a pass over the corpus searches all of them, so there are two passes however many items there are.
3. Every passage of every document is folded into that space and compared by cosine. Its norm counts
   words the benchmark doesn't have at the mean weight of those it has. A passage whose benchmark words
   can't reach the threshold (their norm bounds its projection's) needs no product.
   Beside it, a passage with half of an item passage's rarest words is a candidate too, whatever their frequency
   and the corpus's size: of the two passages around an exact copy one has that many.
4. A candidate is confirmed by the longest common subsequence of the item's words and the words around
   the passage, and by an answer check: enough of the item's rarest words must be there, of those that
   some document has. Both allow for words that were changed, dropped or added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, settle, text_list

WORD = re.compile(r"[^\W_]+")
HALF = 16
#: Places of words that the benchmark doesn't have, and of its stop words.
UNKNOWN, STOP = -1, -2
#: Words of texts that are searched together, and passages in a product.
WORDS, PRODUCT = 1 << 15, 1 << 12
#: Characters of a group's items: bounds its latent space, about 25 MB, and what a task holds of a group.
GROUP = 1 << 20
#: Characters of a benchmark. What is broadcast is about 25 times this; a larger one is an error: search for its parts.
MOST = 16 << 20


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.25
    lcs: float = 0.5
    answer: float = 0.3
    answer_words: int = 8
    #: Dimensions of the latent space at most, and part of the number of passages.
    rank: int = 256
    part: float = 0.5
    #: Part of an item passage's rarest words that makes a passage a candidate.
    keys: float = 0.375
    #: Words in more than this share of documents are stop words.
    common: float = 0.3
    energy: float = 0.99
    extra: int = 16


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary (of a bounded benchmark) occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n, vocabulary = 0, shared.value
        for batch in batches:
            for text in text_list(batch, "text"):
                n += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, ""]), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    total = map_arrow(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: int(r["n"]) for r in total.collect()}  # at most the vocabulary, which is bounded
    return found, found.pop("", 0)


def passages(n_words: int) -> list[tuple[int, int]]:
    """(start, end) of passages of two halves, every half; a short text is one passage."""
    last = max(1, math.ceil(n_words / HALF) - 1)
    return [(i * HALF, min(n_words, (i + 2) * HALF)) for i in range(last)]


@dataclass(frozen=True)
class Index:
    """A group's latent space: words' places (stop words after those with weights), weights and vectors, and the folded passages of its items.

    keyed and key_of list (place, item passage) of each item passage's rarest words, by place; need is how many a candidate has.
    """

    place: dict[str, int]
    weight: np.ndarray
    other: float
    vectors: np.ndarray
    folded: np.ndarray
    owner: np.ndarray
    items: list[tuple[int, list[str]]]
    answers: list[frozenset[str]]
    keyed: np.ndarray
    key_of: np.ndarray
    need: np.ndarray


def _rows(words: list[str], place: dict[str, int], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF of each passage (word places, weights), normalised. With sqrt(tf), squared weights add up by occurrence."""
    out = []
    for s, e in passages(len(words)):
        tf = Counter(place[w] for w in words[s:e] if 0 <= place.get(w, UNKNOWN) < len(weight))
        at = np.fromiter(tf, np.int64, len(tf))
        value = np.sqrt(np.fromiter(tf.values(), np.float64, len(tf))) * weight[at]
        out.append((at, value / max(1e-12, float(np.linalg.norm(value)))))
    return out


def randomised_svd(items: DataFrame, place: dict[str, int], weight: np.ndarray, rank: int, extra: int, energy: float, seed: int = 11) -> np.ndarray:
    """Word vectors (places x rank at most): right singular vectors of the items' TF-IDF passages.

    Two distributed passes. The first sends each task's part of (A W)'(A W) for a random W, whose Cholesky
    factor orthonormalises A W; the second sends each task's part of Q'A. Both sums have a size that the
    group bounds. items: (item_id, text).
    """
    n, width = len(weight), min(len(weight), rank + extra)
    test = np.random.default_rng(seed).normal(0, 1, (n, width))

    def parts(batches: Iterator[pa.RecordBatch], solve: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width) if solve is None else (width, n))
        for batch in batches:
            for text in text_list(batch, "text"):
                for at, value in _rows(words_of(text), place, weight):
                    y = value @ test[at]
                    if solve is None:
                        total += np.outer(y, y)
                    else:
                        total[:, at] += np.outer(y @ solve, value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def summed(solve: np.ndarray | None) -> np.ndarray:
        rows = items.select("text").mapInArrow(lambda b: parts(b, solve), "part binary").toLocalIterator()
        return sum(np.frombuffer(r["part"]).reshape((width, width) if solve is None else (width, n)) for r in rows)

    value, basis = np.linalg.eigh(summed(None))
    good = value > value.max() * 1e-10
    solve = np.zeros((width, width))
    solve[:, : good.sum()] = basis[:, good] / np.sqrt(value[good])
    _, s, vt = np.linalg.svd(summed(solve), full_matrices=False)
    share = np.cumsum(s**2) / max(1e-300, float((s**2).sum()))
    return vt[: min(rank, int(np.searchsorted(share, energy)) + 1)].T.astype(np.float32)


def build_index(items: DataFrame, frequencies: dict[str, int], n_docs: int, settings: Settings) -> Index | None:
    """The index of one bounded group of items (item_id, text)."""
    listed = sorted((r["item_id"], words) for r in items.collect() if (words := words_of(r["text"] or "")))
    if not listed:
        return None
    idf = lambda w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0)))
    stop = settings.common * n_docs
    vocabulary = sorted({w for _, words in listed for w in words})
    useful = [w for w in vocabulary if frequencies.get(w, 0) <= stop] or vocabulary
    kept = set(useful)
    place = {w: i for i, w in enumerate(useful + [w for w in vocabulary if w not in kept])}
    weight = np.array([max(idf(w), 1e-3) ** 2 for w in useful])
    n_passages = sum(len(passages(len(words))) for _, words in listed)
    vectors = randomised_svd(items, place, weight, max(1, min(settings.rank, int(n_passages * settings.part))), settings.extra, settings.energy)
    folded, owner = [], []
    for i, (_, words) in enumerate(listed):
        for at, value in _rows(words, place, weight):
            z = value @ vectors[at]
            folded.append(z / max(1e-12, float(np.linalg.norm(z))))
            owner.append(i)
    # words that no document has come last: they tell no document from another, and in a paraphrase they are the changed ones
    rarest = lambda words: sorted(set(words), key=lambda w: (not frequencies.get(w), frequencies.get(w, 0), w))[: settings.answer_words]
    answers = [frozenset(rarest([w for w in words if w in kept] or words)) for _, words in listed]
    keys = [[place[w] for w in rarest(words[s:e])] for _, words in listed for s, e in passages(len(words))]
    keyed = np.array(sorted((x, i) for i, k in enumerate(keys) for x in k), np.int64)
    need = np.array([max(1, math.ceil(len(k) * settings.keys)) for k in keys])
    return Index(place, weight, float((weight**2).mean()), vectors, np.array(folded, np.float32), np.array(owner), listed, answers, keyed[:, 0], keyed[:, 1], need)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def confirm(words: list[str], start: int, item: list[str], answer: frozenset[str], settings: Settings) -> tuple[float, float]:
    """Shares of the item's words in the common subsequence, and of its answer words, around a passage."""
    near = words[max(0, start - len(item)) : start + 2 * HALF + len(item)]
    have = set(near)
    answered = len(answer & have) / max(1, len(answer))
    return (common_subsequence(item, near) / len(item) if answered >= settings.answer else 0.0), answered


def by_keys(full: np.ndarray, half: np.ndarray, starts: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """(passage, place of the item) of passages that have enough of an item passage's rarest words. full: words' places, half: their halves."""
    first = np.searchsorted(index.keyed, np.arange(len(index.place) + 1))
    lists = np.append(np.diff(first), 0)  # item passages of each place; the last is of unknown words
    hit = np.flatnonzero(lists[full] > 0) if len(full) else np.zeros(0, np.int64)
    seen = np.concatenate([half[hit], half[hit] - 1])
    seen, place = np.divmod(np.unique((seen * len(lists) + np.tile(full[hit], 2))[(seen >= 0) & starts[np.maximum(seen, 0)]]), len(lists))
    enough = np.bincount(seen, minlength=len(starts))[seen] >= index.need.min()
    seen, place = seen[enough], place[enough]
    ends = np.cumsum(lists[place])
    for s in range(0, len(seen), PRODUCT):  # passages never end up in two parts: each part takes whole ones
        lo, hi = np.searchsorted(seen, (seen[s], seen[s + PRODUCT] if s + PRODUCT < len(seen) else len(starts)))
        if lo == hi:
            continue
        n = lists[place[lo:hi]]
        entry = np.repeat(first[place[lo:hi]], n) + np.arange(n.sum()) - np.repeat(ends[lo:hi] - n - (ends[lo] - n[0]), n)
        pair, count = np.unique(np.repeat(seen[lo:hi], n) * len(index.need) + index.key_of[entry], return_counts=True)
        p, o = np.divmod(pair, len(index.need))
        good = count >= index.need[o]
        yield from zip(p[good].tolist(), index.owner[o[good]].tolist(), strict=True)


def matches(listed: list[list[str]], index: Index, settings: Settings) -> Iterator[tuple[int, int, float, float]]:
    """(place of the text, item_id, common subsequence share, cosine) of each item found in each text's words, with its best figures.

    Halves of all texts are numbered through, with an empty half after each text, so that arrays cover many texts.
    """
    sizes = np.array([len(w) for w in listed])
    halves = -(-sizes // HALF)
    base = np.cumsum(halves + 1) - (halves + 1)
    total = int((halves + 1).sum())
    if not sizes.sum():
        return
    full = np.fromiter(map(index.place.get, chain.from_iterable(listed), repeat(UNKNOWN)), np.int64, int(sizes.sum()))
    at = np.where(full < len(index.weight), full, STOP)
    first = np.cumsum(sizes) - sizes
    half = np.repeat(base, sizes) + (np.arange(len(at)) - np.repeat(first, sizes)) // HALF
    pair = lambda w: (x := np.bincount(half, weights=w, minlength=total + 1))[:-1] + x[1:]
    known = pair(np.where(at >= 0, index.weight[np.maximum(at, 0)] ** 2, 0))
    norm = known + pair(np.where(at == UNKNOWN, index.other, 0))
    strong = (known > 0) & (known >= settings.cosine**2 * norm)
    starts = np.ones(total, bool)
    starts[base[halves > 1] + halves[halves > 1] - 1] = False  # the last half starts no passage of its own
    starts[base + halves] = False
    passage = np.flatnonzero(strong & starts)
    row = np.full(total + 1, -1)
    row[passage] = np.arange(len(passage))
    # occurrences of benchmark words in strong passages: a half belongs to its own passage and to the one before
    places, owners = [], []
    hit = np.flatnonzero(at >= 0)
    for shift in (0, 1):
        r = row[half[hit] - shift]
        keep = (r >= 0) & (half[hit] >= shift)
        places.append(at[hit][keep])
        owners.append(r[keep])
    key, tf = np.unique(np.concatenate(owners) * len(index.weight) + np.concatenate(places), return_counts=True)
    owner, place = key // len(index.weight), key % len(index.weight)
    value = (np.sqrt(tf) * index.weight[place]).astype(np.float32)
    cuts = np.searchsorted(owner, np.arange(len(passage)))
    found: dict[tuple[int, int], tuple[float, float]] = {}

    def check(p: int, o: int, c: float) -> None:
        d = int(np.searchsorted(base, p, "right")) - 1
        item_id, item = index.items[o]
        best = found.get((d, item_id))
        if best and best[0] == 1:
            return
        share, _ = confirm(listed[d], int(p - base[d]) * HALF, item, index.answers[o], settings)
        if share >= settings.lcs:
            found[d, item_id] = max(best or (0.0, 0.0), (share, c))

    for s in range(0, len(passage), PRODUCT):
        e = min(s + PRODUCT, len(passage))
        lo, hi = cuts[s], cuts[e] if e < len(passage) else len(key)
        z = np.add.reduceat(index.vectors[place[lo:hi]] * value[lo:hi, None], cuts[s:e] - lo)
        cosine = z @ index.folded.T / np.sqrt(norm[passage[s:e]])[:, None]
        pairs: dict[tuple[int, int], float] = {}
        for p, o in np.argwhere(cosine >= settings.cosine).tolist():
            k = (s + p, int(index.owner[o]))
            pairs[k] = max(pairs.get(k, 0.0), float(cosine[p, o]))
        for (p, o), c in pairs.items():
            check(int(passage[p]), o, c)
    for p, o in sorted(set(by_keys(full, half, starts, index))):
        check(p, o, 0.0)
    for (d, item_id), (share, c) in sorted(found.items()):
        yield d, item_id, share, c


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, lcs, cosine): one row for each benchmark item found in each document.

    lcs is the share of the item's words that stand in the document's passage in order. docs (doc_id, text),
    benchmark (item_id, text). Nulls: null and empty texts match nothing; a null doc_id is kept, items
    with a null item_id are ignored. Repeated documents come back repeated, repeated items once. Differing
    texts of an item_id are variants of one item and stay in one group. An empty table
    on either side gives an empty result.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, lcs double, cosine double"
    rows = id_text(docs)
    items = settle(id_text(benchmark, "item_id").where("item_id is not null and text is not null").distinct())
    size = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    if not size:
        return spark.createDataFrame([], schema)
    if size > MOST:
        raise ValueError(f"a benchmark has at most {MOST} characters: search for its parts one after another")
    groups = math.ceil(size / GROUP)
    dealt = settle(items.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(groups))))
    vocabulary = frozenset(w for r in dealt.select("text").toLocalIterator() for w in words_of(r["text"]))
    frequencies, n_docs = document_frequencies(rows, vocabulary)
    made = (build_index(dealt.where(F.col("g") == g).select("item_id", "text").coalesce(4), frequencies, n_docs, settings) for g in range(groups))
    return _search(rows, [spark.sparkContext.broadcast(x) for x in made if x], settings, schema)


def _search(rows: DataFrame, indexes: list[Broadcast[Index]], settings: Settings, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids, listed = batch.column(0).to_pylist(), [words_of(x) for x in text_list(batch, "text")]
            for shared in indexes:
                index, start, size = shared.value, 0, 0
                for end, words in enumerate(listed, 1):
                    size += len(words)
                    if size < WORDS and end < len(listed):
                        continue
                    for d, *found in matches(listed[start:end], index, settings):
                        for column, value in zip(out, (ids[start + d], *found), strict=True):
                            column.append(value)
                    start, size = end, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "lcs", "cosine"])

    return map_arrow(rows, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, whose document holds no benchmark item. Rows with a null doc_id stay."""
    found = settle(contaminated(docs, benchmark, settings).where("doc_id is not null").select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
