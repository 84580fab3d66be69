"""What the two text classifiers share: hashed word features, a bounded labelled sample, and scoring by word.

Both models are linear in word features, so a word has one weight sum, kept in a table of bounded size per
task; scoring a text is then a lookup per word.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
MEMO = 1 << 18
WORDS = re.compile(r"\S+")


def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass"), 7) & ((1 << BITS) - 1)


def shape(word: str) -> str:
    """Runs of upper case, lower case, digits and others, each symbol as itself: 'Wow!!' is 'Aa!!'."""
    out = []
    for c in word[:24]:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if s not in "Aa0" or not out or out[-1] != s:
            out.append(s)
    return "".join(out[:12])


class Memo(dict):
    """Word -> value, computed once; emptied when full, so its size is bounded."""

    def __init__(self, value: Callable[[str], float]):
        super().__init__()
        self.value = value

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = self.value(word)
        return got


def held_out(id_col: str) -> Column:
    """The fifth of the ids that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, dict[int, int]]:
    """Texts and labels for fitting, and how many ids each label has in all.

    At most ``per_class`` ids per label value (lowest hashes of the id, held-out ids excluded), texts of at most
    ``max_chars`` characters, one an id: the bound on what reaches the driver. Every label value is taken, however many there are. Of an id's several labels the largest holds, of its
    several texts of that length the smallest; null labels, null ids and ids without a text teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect()}
    ids = _lowest_hashes(known, id_col, {y: min(per_class, n) for y, n in sizes.items()}, sizes)
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, f"id {kind}, y int"))
    text = docs.where(F.length(text_col).between(1, max_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = text.join(wanted, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = sorted(one.collect(), key=lambda r: (r["y"], r["id"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), sizes


def _lowest_hashes(known: DataFrame, id_col: str, want: dict[int, int], sizes: dict[int, int]) -> list[tuple]:
    """(id, y): of each label the ``want[y]`` ids with the lowest hashes.

    The count of a label says below which hash about 1.2 times as many ids lie; only those are sent to the driver, so no task holds a label. A label that
    falls short of its number is asked for again without a bound.
    """
    share = {y: min(1.0, (1.2 * n + 200) / sizes[y]) for y, n in want.items()}
    picked: list[tuple] = []
    while share:
        bound = {y: (1 << 63) - 1 if f >= 1 else int(-(2**63) + f * 2**64) for y, f in share.items()}
        at = F.create_map(*[F.lit(v) for kv in bound.items() for v in (kv[0], int(kv[1]))])
        h = F.xxhash64(id_col)
        rows = known.where(h <= F.try_element_at(at, F.col("y"))).select(F.col(id_col), "y", h.alias("h")).collect()
        short = {}
        for y in share:
            mine = sorted(((r["h"], r[0]) for r in rows if r["y"] == y))[: want[y]]
            if len(mine) < want[y] and share[y] < 1:
                short[y] = 1.0
            else:
                picked += [(i, y) for _, i in mine]
        share = short
    return picked


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (a, b) of non-negative numbers, by one sort of their combination."""
    if not len(a):
        return a, b
    wide = int(b.max()) + 1
    key = np.unique(a.astype(np.int64) * wide + b)
    return key // wide, key % wide


def compact(cols: np.ndarray, lens: np.ndarray, least: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(used slots, row of each entry, column of each entry) of rows laid end to end, without slots found in fewer than ``least`` groups of rows."""
    rows = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    slots, n = np.unique(distinct_pairs(cols, groups[rows])[0], return_counts=True)
    slots = slots[n >= least]
    if not len(slots):
        return slots, rows[:0], cols[:0]
    at = np.minimum(np.searchsorted(slots, cols), len(slots) - 1).astype(np.int32)
    keep = slots[at] == cols
    return slots, rows[keep], at[keep]
