"""Toxicity by multiple-instance learning.

A sentence's logit is linear in the hashed features of its distinct words; a document's probability
is the noisy-or of its sentences' probabilities. Training sees document labels only: its gradient
reaches sentences through the noisy-or, so the sentences that explain a label get the weight, and
afterwards they can be located.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_texts, held_out, id_text, map_arrow, settle, text_list
from .linear import BITS, WordScores, incidence

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """Bounds of what is fitted on, and the fit's settings.

    The model is fitted on at most `documents` labelled rows, those with the smallest hash of doc_id,
    among rows of at most `characters`; so the driver holds a bounded sample at every input size.
    """

    documents: int = 6000
    characters: int = 20_000
    least_documents: int = 3
    steps: int = 200
    rate: float = 0.3
    shrink: float = 5e-3
    #: Logit of a sentence without evidence. Fixed: fitted, it would explain missed labels by length.
    prior: float = -8.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has words."""
    for m in SENTENCE.finditer(text):
        if words := set(WORD.findall(m.group().lower())):
            yield m.start(), m.end(), words


def fit(texts: list[str], labels: list[int], settings: Training = Training()) -> Model:
    """Adagrad on the exact noisy-or likelihood, over the whole sample at each step."""
    places: dict[str, int] = {}
    words, sizes, owners = array("i"), array("i"), array("i")  # a sample has millions of words
    for d, text in enumerate(texts):
        for _, _, found in sentences(text):
            words.extend(places.setdefault(w, len(places)) for w in sorted(found))
            sizes.append(len(found))
            owners.append(d)
    n_docs, y = len(texts), np.array(labels, np.float64)
    bias = settings.prior
    weights = np.zeros(1 << BITS)
    if not words or y.min() == y.max():  # nothing to learn from
        return Model(weights.astype(np.float32), bias)
    w, d = np.array(words), np.array(owners)
    s = np.repeat(np.arange(len(sizes), dtype=np.int32), np.array(sizes))
    word_at, bucket = incidence(list(places))
    # a bucket is fitted only if it is seen in several documents, so that words of one document learn nothing
    seen = np.unique(d[s].astype(np.int64) * len(places) + w) % len(places)
    documents = np.bincount(bucket, weights=np.bincount(seen, minlength=len(places))[word_at], minlength=1 << BITS)
    kept = documents >= settings.least_documents
    word_at, bucket = word_at[kept[bucket]], bucket[kept[bucket]]
    squares = np.full(1 << BITS, 1e-8)
    for _ in range(settings.steps):
        u = np.bincount(word_at, weights=weights[bucket], minlength=len(places))
        z = np.bincount(s, weights=u[w], minlength=len(sizes)) + bias
        soft = np.logaddexp(0, z)
        total = np.bincount(d, weights=soft, minlength=n_docs)
        by_doc = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-12), 1.0)
        g = by_doc[d] / (1 + np.exp(-z)) / n_docs
        g_word = np.bincount(w, weights=g[s], minlength=len(places))
        g_bucket = np.bincount(bucket, weights=g_word[word_at], minlength=1 << BITS)
        squares += g_bucket**2
        weights -= settings.rate * g_bucket / np.sqrt(squares)
        # soft threshold: what the labels don't insist on returns to zero
        weights = np.sign(weights) * np.maximum(np.abs(weights) - settings.shrink * settings.rate, 0)
    return Model(weights.astype(np.float32), float(bias))


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def score_text(text: str, scores: WordScores, bias: float, locate: float) -> tuple[float, list[dict]]:
    """The document's probability, and the sentences whose own probability is at least `locate`."""
    total, found, lookup = 0.0, [], scores.__getitem__
    for start, end, words in sentences(text):
        z = bias + sum(map(lookup, words))
        total += _softplus(z)
        p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        if p >= locate:
            found.append({"start": start, "end": end, "score": p})
    return -math.expm1(-total), found


def training_sample(docs: DataFrame, labels: DataFrame, settings: Training) -> tuple[list[str], list[int]]:
    """The bounded labelled sample; rows whose crc32(doc_id as text) mod 4 is 2 are held out.

    Labels that differ for one doc_id count as toxic; of texts that share a doc_id the smallest counts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = id_text(docs).where(F.col("doc_id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) <= settings.characters))
    # only labels of documents that are there count, so the sample is as large as they allow; ids alone are joined and ordered
    chosen = marked.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.documents)
    # the sample is bounded by settings.documents, so broadcasting it is
    chosen = F.broadcast(settle(chosen))
    texts = first_texts(rows.join(chosen, "doc_id", "left_semi"))
    rows = texts.join(chosen, "doc_id")
    sample = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect()), key=lambda r: r[0])
    return [r[1] for r in sample], [r[2] for r in sample]


def train(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> Model:
    return fit(*training_sample(docs, labels, settings), settings)


def score(docs: DataFrame, model: Model, locate: float = 0.3) -> DataFrame:
    """(doc_id, score, offending array<struct<start,end,score>>) of every row of docs (doc_id, text).

    `offending` gives the character spans of sentences whose own probability is at least `locate`.
    Nulls: a null or empty text has no sentences and score 0; a null doc_id is kept. Repeated rows come
    back repeated; an empty table gives an empty result.
    """
    weights, bias = model.weights, model.bias
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights)
        for batch in batches:
            found = [score_text(x, scores, bias, locate) for x in text_list(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], kind)], ["doc_id", "score", "offending"])

    return map_arrow(id_text(docs), run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")
