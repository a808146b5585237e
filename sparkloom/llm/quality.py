"""Quality by weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on every document.
Expectation-maximisation estimates each labeller's accuracy from the vote patterns of the whole corpus
(a pattern table whose size depends on the number of labellers only, counted where the rows are),
and a pattern's posterior is the probability that its documents are good. Posterior labels of a bounded
sample then train a hashed linear scorer, which scores every document by its words alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_texts, id_text, map_arrow, settle, text_list
from .linear import BITS, WordScores

#: Marks at a word's end that plain prose doesn't have there, and ends of sentences.
MARKED = re.compile(r"(?:[^\w\s.,;:?!\"')]|!!)(?=\s|$)")
ENDED = re.compile(r"[.?!](?=\s|$)")
SENTENCE = re.compile(r"[.!?\n]+")
BARS = ("|", "-", "*", ">", "//")
LETTERS, CAPITALS, WHITE, LATER = (bytes(x) for x in ([*range(65, 91), *range(97, 123)], range(65, 91), b" \t\n\x0b\f\r", range(128, 192)))


@dataclass(frozen=True)
class Shape:
    """What the labellers look at; all of it is counted over the whole text."""

    words: int
    letters: float
    upper: float
    marked: float
    bars: float
    repeated: float
    again: float
    same: float
    distinct: float
    ended: float
    length: float


def _repeats(parts: list[str]) -> tuple[int, int]:
    """Words in parts that have occurred before, and words in all parts."""
    seen: set[str] = set()
    again = total = 0
    for part in parts:
        n = part.count(" ") + 1
        total += n
        if part in seen:
            again += n
        seen.add(part)
    return again, max(1, total)


def _sentences(text: str) -> list[str]:
    return [x for part in SENTENCE.split(text) if (x := part.strip())]


def shape(text: str) -> Shape:
    raw, words = text.encode(), text.split()
    n = max(1, len(words))
    solid = raw.translate(None, WHITE + LATER)  # a byte a character
    letters = len(solid) - len(solid.translate(None, LETTERS)) + len(solid.translate(None, bytes(range(128))))
    lines = [x for x in text.split("\n") if x.strip()]
    again, total = _repeats(_sentences(text))
    return Shape(
        words=len(words),
        letters=letters / max(1, len(solid)),
        upper=(len(solid) - len(solid.translate(None, CAPITALS))) / max(1, letters),
        marked=len(MARKED.findall(text)) / n,
        bars=sum(map(words.count, BARS)) / n,
        repeated=1 - len(set(lines)) / max(1, len(lines)),
        again=again / total,
        same=sum(map(str.__eq__, words, words[1:])) / n,
        distinct=len(set(words)) / n,
        ended=len(ENDED.findall(text)) / n,
        length=len(solid) / n,
    )


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


#: Each returns 1 for good, 0 for bad, -1 for no opinion.
LABELLERS: dict[str, Callable[[Shape], int]] = {
    "letters": lambda s: _vote(s.letters < 0.75, s.letters > 0.9),
    "capitals": lambda s: _vote(s.upper > 0.3, s.upper < 0.15),
    "symbols": lambda s: _vote(s.marked > 0.2, s.marked < 0.05),
    "bars": lambda s: _vote(s.bars > 0.1, s.bars < 0.02),
    "repeated_lines": lambda s: _vote(s.repeated > 0.3, s.repeated < 0.1 and s.words > 50),
    "repeated_sentences": lambda s: _vote(s.again > 0.3, s.again < 0.1 and s.words > 50),
    "stutter": lambda s: _vote(s.same > 0.2, s.same < 0.03 and s.words > 10),
    "variety": lambda s: _vote(s.distinct < 0.2 and 20 < s.words < 5000, s.distinct > 0.35 and s.words > 20),
    "sentences": lambda s: _vote(s.ended < 0.01 and s.words > 20, 0.02 < s.ended < 0.4),
    "word_length": lambda s: _vote(s.length > 15 or s.length < 2, 3 < s.length < 10),
}


def votes(text: str) -> str:
    """A letter for each labeller: g, b or - for no opinion."""
    s = shape(text)
    return "".join("bg-"[f(s)] for f in LABELLERS.values())


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and for each labeller how likely its votes are g and b on good and on bad documents."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, pattern: str) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for i, v in enumerate(pattern):
            if v != "-":  # having no opinion says nothing
                z += math.log(self.good[i]["gb".index(v)] / self.bad[i]["gb".index(v)])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_labels(patterns: dict[str, int], rounds: int = 100) -> LabelModel:
    """EM over pattern counts. It starts from the majority vote, which fixes which class is good."""
    k = len(LABELLERS)
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], np.float64)
    one = np.array([[[v == x for x in "gb"] for v in p] for p in names], np.float64).reshape(len(names), k, 2)
    share = np.array([(p.count("g") + 1) / (p.count("g") + 3 * p.count("b") + 2) for p in names])
    prior, good, bad = 0.5, np.full((k, 2), 1 / 2), np.full((k, 2), 1 / 2)
    for _ in range(rounds if len(names) else 0):
        w, v = n * share, n * (1 - share)
        # a few pseudo-votes keep every probability positive; a labeller is taken to be right more often than not
        good = np.einsum("p,pkv->kv", w, one) + [2, 0.5]
        bad = np.einsum("p,pkv->kv", v, one) + [0.5, 2]
        good, bad = good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True)
        prior = (w.sum() + 1) / (n.sum() + 2)
        z = math.log(prior / (1 - prior)) + np.einsum("pkv,kv->p", one, np.log(good) - np.log(bad))
        share = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return LabelModel(float(prior), good, bad)


#: What a scorer sees besides the tokens: a word that equals the one before, and a word of a repeated sentence.
SAME, AGAIN = "\0same", "\0again"


def tokens(text: str) -> tuple[list[str], int, int]:
    """Words, how many equal the one before, how many are in repeated sentences."""
    words = text.split()
    return words, sum(map(str.__eq__, words, words[1:])), _repeats(_sentences(text))[0]


def token_features(token: str) -> list[int]:
    """Buckets of a token's shape, of its last letters and, if short, of itself."""
    mask = (1 << BITS) - 1
    case = "A" if token.isupper() else "T" if token.istitle() else "a" if token.islower() else "-"
    found = [f"s{case}{token.isalpha():d}{token[-1:].isalnum():d}{min(len(token), 16)}", f"e{token[-2:]}"]
    if len(token) <= 4 or token[0] == "\0":
        found.append(f"w{token}")
    return [zlib.crc32(x.encode()) & mask for x in found]


@dataclass(frozen=True)
class Training:
    """The scorer is fitted on at most `documents` documents of at most `characters`, those with the smallest hash of doc_id."""

    documents: int = 4000
    characters: int = 20_000
    steps: int = 120
    rate: float = 0.2
    shrink: float = 1e-6


def _means(texts: list[str], features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, bucket, mean count a token)."""
    known: dict[str, list[int]] = {}
    rows, buckets, values = [], [], []
    for d, text in enumerate(texts):
        words, same, again = tokens(text)
        total: Counter = Counter()
        for token, n in (Counter(words) | Counter({SAME: same, AGAIN: again})).items():
            if token not in known:
                known[token] = features(token)
            for b in known[token]:
                total[b] += n
        rows.append(np.full(len(total), d))
        buckets.append(np.fromiter(total, np.int64, len(total)))
        values.append(np.fromiter(total.values(), np.float64, len(total)) / max(1, len(words)))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def fit_scorer(texts: list[str], posteriors: list[float], settings: Training = Training()) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes with equal weight."""
    weights, bias = np.zeros(1 << BITS), 0.0
    y = np.array(posteriors, np.float64)
    if not len(y) or y.max() < 0.5 or y.min() > 0.5:
        return weights.astype(np.float32), 4.0 if len(y) and y.min() > 0.5 else 0.0
    row, bucket, value = _means(texts, token_features)
    balance = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    squares, bias_square = np.full(1 << BITS, 1e-12), 1e-12
    for _ in range(settings.steps):
        z = np.bincount(row, weights=weights[bucket] * value, minlength=len(y)) + bias
        g = balance * (1 / (1 + np.exp(-z)) - y)
        g_bucket = np.bincount(bucket, weights=g[row] * value, minlength=1 << BITS) + settings.shrink * weights
        squares += g_bucket**2
        weights -= settings.rate * g_bucket / np.sqrt(squares)
        bias_square += g.sum() ** 2
        bias -= settings.rate * g.sum() / math.sqrt(bias_square)
    return weights.astype(np.float32), float(bias)


def mean_score(text: str, scores: WordScores) -> float:
    words, same, again = tokens(text)
    return (sum(map(scores.__getitem__, words)) + same * scores[SAME] + again * scores[AGAIN]) / max(1, len(words))


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(x) for x in text_list(batch, "text")])], ["doc_id", "votes"])

    return map_arrow(id_text(docs), run, "doc_id long, votes string")


def classify(docs: DataFrame, settings: Training = Training(), threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) of every row of docs (doc_id, text).

    `score` (0 to 1, higher is better) is the linear scorer's; keep is score >= threshold. The label
    model is fitted on the votes of all rows.
    Nulls: a null text counts as empty: its score is the bias alone. A null doc_id is kept. Repeated rows
    come back repeated; an empty table gives an empty result.
    """
    patterns = {r["votes"]: int(r["n"]) for r in vote_patterns(docs).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_labels(patterns)
    rows = id_text(docs)
    fits = rows.where(F.col("doc_id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) <= settings.characters))
    # only the chosen ids are ordered, not the texts; their number is bounded by settings.documents
    chosen = fits.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.documents)
    sample = sorted((r["doc_id"], r["text"]) for r in first_texts(fits.join(F.broadcast(settle(chosen)), "doc_id", "left_semi")).collect())
    weights, bias = fit_scorer([t for _, t in sample], [model.posterior(votes(t)) for _, t in sample], settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights, token_features)
        for batch in batches:
            z = np.array([bias + mean_score(text, scores) for text in text_list(batch, "text")], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "keep"])

    return map_arrow(rows, run, "doc_id long, score double, keep boolean")
