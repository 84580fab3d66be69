"""Quality by ordinal regression with cumulative links.

Ratings are ordered grades. One set of hashed-text weights w gives a document its worth s, ordered thresholds t_1 < t_2 < ...
cut it into grades: P(grade > k) = sigmoid(s - t_k). Hence the expected grade, and the probability of the upper tail by which
documents are selected. A worth is the mean over the words of their weight sums, plus weights of a few whole-text features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches
from strataweave.llm.hashed_text import BITS, WORDS, Adam, Memo, labelled_sample, shape, slot

PER_CLASS = 3000
MAX_TRAIN_CHARS = 12_000
WHOLE = 4


def word_features(word: str) -> list[int]:
    """The word without case, its shape, and its last two characters with their case."""
    return [slot("w" + word.lower()), slot("s" + shape(word)), slot("e" + word[-2:])]


def whole_features(words: list[str]) -> np.ndarray:
    """Length, share of distinct words, mean word length, whether there are none."""
    n = len(words)
    if not n:
        return np.array([0.0, 1.0, 0.0, 1.0])
    return np.array([np.log1p(n) / 8, len(set(words)) / n, min(sum(map(len, words)) / n, 40) / 8, 0.0])


@dataclass
class Model:
    grades: list[int]
    thresholds: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    whole: np.ndarray

    def scorer(self) -> Memo:
        table = np.zeros(1 << BITS)
        table[self.slots] = self.weights
        return Memo(lambda w: float(sum(table[i] for i in word_features(w))))

    def worth(self, text: str, memo: Memo) -> float:
        words = WORDS.findall(text)
        return float(whole_features(words) @ self.whole) + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0)

    def tails(self, worth: float) -> np.ndarray:
        """P(grade > grades[k]) for all k but the last."""
        return 1 / (1 + np.exp(-np.clip(worth - self.thresholds, -60, 60)))


def fit_texts(texts: list[str], y: np.ndarray, rounds: int = 250, ridge: float = 1e-6) -> Model:
    grades, k = np.unique(y, return_inverse=True)
    top = len(grades) - 1
    if top < 1:
        return Model([int(g) for g in grades] or [0], np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(WHOLE))
    rows, cols, vals, whole = [], [], [], np.zeros((len(texts), WHOLE))
    memo: Memo = Memo(word_features)
    for d, t in enumerate(texts):
        words = WORDS.findall(t)
        whole[d] = whole_features(words)
        ids = np.array([i for w in words for i in memo[w]], np.int64)
        u, n = np.unique(ids, return_counts=True)
        rows.append(np.full(len(u), d))
        cols.append(u)
        vals.append(n / max(1, len(words)))
    rows, cols, vals = map(np.concatenate, (rows, cols, vals))
    slots, df = np.unique(cols, return_counts=True)
    slots = slots[df >= 4]
    if len(slots):
        at = np.minimum(np.searchsorted(slots, cols), len(slots) - 1)
        keep = slots[at] == cols
        rows, cols, vals = rows[keep], at[keep], vals[keep]
    else:
        rows, cols, vals = rows[:0], cols[:0], vals[:0]
    cost = (len(y) / (len(grades) * np.bincount(k)))[k]  # every grade counts alike
    m, n = len(slots), len(y)
    theta = np.zeros(m + WHOLE + top)
    theta[m + WHOLE + 1 :] = 0.5
    opt = Adam(len(theta), 0.1)
    for _ in range(rounds):
        steps = theta[m + WHOLE :]
        cuts = np.cumsum(np.r_[steps[0], np.log1p(np.exp(steps[1:]))])
        s = np.bincount(rows, theta[cols] * vals, n) + whole @ theta[m : m + WHOLE]
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))  # P(grade > k)
        full = np.c_[np.ones(n), above, np.zeros(n)]
        p = np.maximum(full[np.arange(n), k] - full[np.arange(n), k + 1], 1e-12)
        slope = np.c_[np.zeros(n), above * (1 - above), np.zeros(n)]
        ds = -(slope[np.arange(n), k] - slope[np.arange(n), k + 1]) / p * cost
        dcuts = np.zeros(top)
        np.add.at(dcuts, k[k > 0] - 1, (slope[np.arange(n), k] / p * cost)[k > 0])
        np.add.at(dcuts, k[k < top], -(slope[np.arange(n), k + 1] / p * cost)[k < top])
        dsteps = np.cumsum(dcuts[::-1])[::-1].copy()
        dsteps[1:] *= 1 / (1 + np.exp(-steps[1:]))
        grad = np.r_[np.bincount(cols, ds[rows] * vals, m), whole.T @ ds, dsteps] / n
        grad[: m + WHOLE] += ridge * theta[: m + WHOLE]
        theta += opt.step(grad)
    steps = theta[m + WHOLE :]
    cuts = np.cumsum(np.r_[steps[0], np.log1p(np.exp(steps[1:]))])
    return Model([int(g) for g in grades], cuts, slots, theta[:m], theta[m : m + WHOLE])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    texts, y, _ = labelled_sample(docs, labels, label, per_class, max_chars)
    return fit_texts(texts, y)


def score(docs: DataFrame, model: Model, tail_from: int | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``_quality``: expected_grade, tail (probability of grade ``tail_from`` or more; the second lowest grade by default).

    One row for each row; null texts count as empty; other columns pass through, whatever their names (but ``_quality`` itself).
    With fewer than two grades to learn from, every text has the one grade and tail 1.
    """
    out = docs.withColumn("_quality", F.lit(None).cast("struct<expected_grade:double,tail:double>"))
    at, into = out.columns.index(text_col), out.columns.index("_quality")
    grades = model.grades
    cut = grades.index(tail_from) if tail_from is not None else min(1, len(grades) - 1)
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        memo, gaps = model.scorer(), np.diff(model.grades)
        for b in batches:
            found = []
            for t in b.column(at):
                tails = model.tails(model.worth(t.as_py() if t.is_valid else "", memo))
                found.append({"expected_grade": float(model.grades[0] + gaps @ tails), "tail": float(tails[cut - 1]) if cut else 1.0})
            cols = list(b.columns)
            cols[into] = pa.array(found, b.schema.field(into).type)
            b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b if keep_text else b.select([i for i in range(len(cols)) if i != at])

    return out.mapInArrow(run, out.schema if keep_text else out.drop(text_col).schema)
