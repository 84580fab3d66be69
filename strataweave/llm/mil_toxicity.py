"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in its hashed word features; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are given: the likelihood of the noisy-or hands the gradient of a toxic document to
the sentences that explain it. The same sentence scores then point out the offending spans.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches
from strataweave.llm.hashed_text import BITS, Adam, Memo, compact, distinct_pairs, labelled_sample, slot

PER_CLASS = 3000
MAX_TRAIN_CHARS = 12_000
SENTENCE_WORDS = 48
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """The word, and its first four and five letters, which inflected forms share."""
    return [slot("w" + word), *([slot("4" + word[:4])] if len(word) > 4 else []), *([slot("5" + word[:5])] if len(word) > 5 else [])]


def sentences(text: str):
    """(from, to, words): sentences by their end marks and lines; one of over SENTENCE_WORDS words is taken in runs of that many."""
    for s in _SENTENCE.finditer(text):
        piece, start = s.group(), s.start()
        words = _WORD.findall(piece.lower())
        if len(words) <= SENTENCE_WORDS:
            if words:
                yield start, s.end(), words
            continue
        spots = list(_WORD.finditer(piece))
        for k in range(0, len(spots), SENTENCE_WORDS):
            run = spots[k : k + SENTENCE_WORDS]
            yield start + run[0].start(), start + run[-1].end(), [m.group().lower() for m in run]


@dataclass
class Model:
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Memo:
        table = np.zeros(1 << BITS)
        table[self.slots] = self.weights
        return Memo(lambda w: float(sum(table[i] for i in word_features(w))))

    def sentence_scores(self, text: str, memo: Memo) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, sums = [], []
        for a, b, words in sentences(text):
            spans.append((a, b))
            sums.append(sum(map(memo.__getitem__, dict.fromkeys(words))))
        return spans, 1 / (1 + np.exp(-np.clip(self.bias + np.array(sums, float), -60, 60)))


def noisy_or(p: np.ndarray) -> float:
    """1 - prod(1 - p); no sentence: 0."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def fit_texts(texts: list[str], y: np.ndarray, sizes: dict[int, int] | None = None, rounds: int = 400, ridge: float = 2e-5, least: int = 5, z: float = 4.0) -> Model:
    """Fits on given documents; ``sizes`` (ids per label) weights the classes back to their shares.

    Features stay that at least ``least`` documents have, and whose share of documents differs between the labels by ``z`` standard errors.
    """
    cols, lens, doc = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for _, _, words in sentences(t):
            found = {i for w in dict.fromkeys(words) for i in word_features(w)}
            cols.extend(sorted(found))
            lens.append(len(found))
            doc.append(d)
    cols, lens, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (cols, lens, doc))
    if len(set(y.tolist())) < 2 or not len(doc):
        share = float(np.mean(y)) if len(y) else 0.0
        return Model(-60.0 if share < 0.5 else 60.0, np.zeros(0, np.int64), np.zeros(0))
    slots, rows, cols = compact(cols, lens, least, doc)
    slots, rows, cols = _telling(slots, rows, cols, doc, y, z)
    have = np.bincount(y, minlength=2)
    share = np.array([(sizes or {}).get(k, have[k]) / max(have[k], 1) for k in (0, 1)])
    cost = (share / share[y].mean())[y]
    n, theta = len(y), np.zeros(len(slots) + 1)
    theta[-1] = -4.0
    opt = Adam(len(theta), 0.08)
    for _ in range(rounds):
        z = np.clip(theta[-1] + np.bincount(rows, theta[cols], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, -np.logaddexp(0, z), n)  # log prod(1 - p)
        odds = 1 / np.maximum(np.expm1(-none), 1e-12)  # prod / (1 - prod)
        dz = np.where(y[doc] == 1, -p * odds[doc], p) * cost[doc]
        grad = np.r_[np.bincount(cols, dz[rows], len(slots)) / n + ridge * theta[:-1], dz.sum() / n]
        theta += opt.step(grad)
    return Model(float(theta[-1]), slots, theta[:-1])


def _telling(slots, rows, cols, doc, y, z):
    slot, of = distinct_pairs(cols, doc[rows])
    ones, n = np.bincount(slot, y[of], len(slots)), np.bincount(slot, minlength=len(slots))
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    mean = n / len(y)
    keep = np.abs(ones / n1 - (n - ones) / n0) >= z * np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    at = np.cumsum(keep) - 1
    return slots[keep], rows[keep[cols]], at[cols[keep[cols]]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    texts, y, sizes = labelled_sample(docs, labels, label, per_class, max_chars)
    y = (y > 0).astype(np.int64)
    return fit_texts(texts, y, {k: sum(v for g, v in sizes.items() if (g > 0) == k) for k in (0, 1)})


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``_toxic``: score, and the sentences of probability ``least`` or more as (from, to, p), in characters.

    One row for each row; null and empty texts have no sentence and score 0. Other columns pass through, whatever their names
    (but ``_toxic`` itself).
    """
    out = docs.withColumn("_toxic", F.lit(None).cast("struct<score:double,sentences:array<struct<from:int,to:int,p:double>>>"))
    at, into = out.columns.index(text_col), out.columns.index("_toxic")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo = sent.value.scorer()
        for b in batches:
            found = []
            for t in b.column(at):
                spans, p = sent.value.sentence_scores(t.as_py() if t.is_valid else "", memo)
                found.append({"score": noisy_or(p), "sentences": [{"from": spans[i][0], "to": spans[i][1], "p": float(p[i])} for i in np.flatnonzero(p >= least)]})
            cols = list(b.columns)
            cols[into] = pa.array(found, b.schema.field(into).type)
            b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b if keep_text else b.select([i for i in range(len(cols)) if i != at])

    return out.mapInArrow(run, out.schema if keep_text else out.drop(text_col).schema)
