"""Benchmark decontamination: windows of normalised benchmark words, looked up in every document.

The windows travel as a broadcast hash set. Its size is bounded: the benchmark is dealt into blocks of at most ``BLOCK_CHARS``
bytes of words (a longer item into pieces that share ``window - 1`` words), one broadcast per block. Up to ``CHAIN`` blocks are scanned one after
the other within one narrow plan, each adding its hits to the row; after that many the rows are checkpointed, so a task never
holds more than CHAIN * BLOCK_CHARS bytes of benchmark, about 50 bytes a word, however large the benchmark is. No document is shuffled.

A scan hashes each word once, combines runs of ``window`` word hashes with a rolling sum, screens them with a
bitmap, looks the survivors up among the sorted window hashes and compares their words with the item's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches, cut_lineage

WINDOW = 10
BLOCK_CHARS = 8_000_000
CHAIN = 4
SCREEN_BITS = 22
PIECE = 1 << 22

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((c if c in _WORD else 0x20) for c in (c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, letters and non-ASCII characters; null has none."""
    return (text or b"").translate(_TABLE).split()


def _roll(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return out


def _slot(w: np.ndarray) -> np.ndarray:
    return (w * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SCREEN_BITS)


class Windows:
    """The windows of some items, by length: their hashes in order, and the item and place of each.

    Only the items' texts travel. Words and hashes are made in the process that scans, for hashes of bytes are only equal within one process.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.items, self.window, self.by_length = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "by_length": None}

    def prepare(self) -> None:
        one: dict[bytes, bytes] = {}  # each distinct word once
        self.words = [[one.setdefault(w, w) for w in words_of(text)] for _, text in self.items]
        parts: dict[int, list] = {}
        for i, words in enumerate(self.words):
            n = min(self.window, len(words))
            if n:
                h = _roll(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), n)
                parts.setdefault(n, []).append((h, np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)))
        self.by_length = {}
        for n, found in parts.items():
            h, item, at = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((item, h))
            h, item, at = h[order], item[order], at[order]
            # a window that an item repeats needs one entry
            twin = np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1])) + 1
            keep = np.ones(len(h), bool)
            keep[[k for k in twin.tolist() if self._at(item[k], at[k], n) == self._at(item[k - 1], at[k - 1], n)]] = False
            h, item, at = h[keep], item[keep], at[keep]
            bitmap = np.zeros(1 << SCREEN_BITS, bool)
            bitmap[_slot(h)] = True
            self.by_length[n] = bitmap, h, item, at

    def _at(self, item: int, at: int, n: int) -> list[bytes]:
        return self.words[item][at : at + n]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list]:
        """Words of the text, hit word ranges [from, to) in order and merged, items whose windows occur."""
        if self.by_length is None:
            self.prepare()
        total, ranges, items = 0, [], set()
        longest = max(self.by_length, default=1)
        for base, w in _word_runs(text or b"", longest - 1):
            total = base + len(w)
            if not self.by_length or not w:
                continue
            h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
            for n, (bitmap, known, item, at) in self.by_length.items():
                rolled = _roll(h, n)
                likely = np.flatnonzero(bitmap[_slot(rolled)])
                if not len(likely):
                    continue
                lo, hi = (np.searchsorted(known, rolled[likely], side) for side in ("left", "right"))
                for i, a, b in zip(likely.tolist(), lo.tolist(), hi.tolist()):
                    own = w[i : i + n] if a < b else None
                    hits = [item[k] for k in range(a, b) if self._at(item[k], at[k], n) == own]
                    if hits:
                        items.update(self.items[k][0] for k in hits)
                        ranges.append((base + i, base + i + n))
        return total, merge(ranges), list(items)


def _word_runs(text: bytes, overlap: int):
    """(index of the first word, words): whole texts, by pieces of bounded size that share ``overlap`` words."""
    if len(text) <= PIECE:
        yield 0, text.translate(_TABLE).split()
        return
    rest, kept, base = b"", [], 0
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(_TABLE)
        w = piece.split()
        rest = w.pop() if at + PIECE < len(text) and w and piece[-1:] != b" " else b""
        if w:
            run = kept + w
            yield base, run
            kept = run[len(run) - min(overlap, len(run)) :] if overlap else []
            base += len(run) - len(kept)
    if rest:
        yield base, [*kept, rest]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(text: bytes, window: int):
    """The item's words in texts of about ``BLOCK_CHARS`` bytes that share ``window - 1`` words, so that no window is lost."""
    if len(text) <= BLOCK_CHARS:
        yield text
        return
    held, size, given = [], 0, False
    for w in words_of(text):
        held.append(w)
        size += len(w) + 1
        if size >= BLOCK_CHARS and len(held) >= 4 * window:
            yield b" ".join(held)
            held, given = held[len(held) - window + 1 :], True
            size = sum(map(len, held)) + len(held)
    if not given or len(held) >= window:
        yield b" ".join(held)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """Benchmark rows in blocks of bounded size, one block at a time on the driver; at least one, which may be empty."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where(F.col(text_col).isNotNull())
    block, chars = [], 0
    for r in rows.toLocalIterator():
        for text in _pieces(bytes(r["text"]), window):
            if block and chars + len(text) > BLOCK_CHARS:
                yield block
                block, chars = [], 0
            block.append((r["item"], text))
            chars += len(text)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``_hits``: n_words, spans (merged hit word ranges, end excluded), items (distinct, unsorted).

    All columns of ``docs`` pass through whatever they are called (but ``_hits`` itself). Null and empty
    texts have no words; an item without words has no window; a null item_id is never listed but its
    windows count. Rows, repeated ones too, map one to one. An empty benchmark hits nothing.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    kind = "struct<n_words:bigint,spans:array<struct<from:bigint,to:bigint>>,items:array<string>>"
    out = docs.withColumn("_hits", F.lit(None).cast(kind))
    names = out.columns
    at, into = names.index(text_col), names.index("_hits")
    blocks = _blocks(benchmark, item_col, bench_text_col, window)
    block, chained = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        drop = after is None and not keep_text
        out = out.mapInArrow(_scanner(sc.broadcast(Windows(block, window)), at, into, drop), out.drop(text_col).schema if drop else out.schema)
        block, chained = after, chained + 1
        if block is not None and chained % CHAIN == 0:
            out = cut_lineage(out)
    return out


def _scanner(sent, at: int, into: int, drop: bool):
    def run(batches):
        windows = sent.value
        for b in batches:
            col = b.column(at)
            texts = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            found = []
            for t, before in zip(texts, b.column(into).to_pylist()):
                n, ranges, items = windows.scan(t.as_buffer().to_pybytes() if t.is_valid else None)
                if before is not None:
                    ranges = merge(ranges + [(r["from"], r["to"]) for r in before["spans"]])
                    items = list({*items, *before["items"]})
                found.append({"n_words": n, "spans": [{"from": x, "to": y} for x, y in ranges], "items": [i for i in items if i is not None]})
            cols = list(b.columns)
            cols[into] = pa.array(found, b.schema.field(into).type)
            b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b.select([i for i in range(len(cols)) if i != at]) if drop else b

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted as strings), contaminated."""
    text = how.get("text_col", "text")
    found = scan(docs.select(F.col(id_col), F.col(text)), benchmark, keep_text=False, **how)
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("bigint"), lambda s, r: s + r["to"] - r["from"])
    return found.select(id_col, F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.array_sort("_hits.items").alias("items"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs."""
    return scan(docs, benchmark, **how).where(F.size("_hits.spans") == 0).drop("_hits")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with hit words cut out of the text, with what lies between the words of one span; the rest is left as it is."""
    found = scan(docs, benchmark, text_col=text_col, **how)
    names = found.columns
    at, into = names.index(text_col), names.index("_hits")

    def run(batches):
        for b in batches:
            texts = [cut(t, [(r["from"], r["to"]) for r in h["spans"]]) for t, h in zip(b.column(at).to_pylist(), b.column(into).to_pylist())]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return found.mapInArrow(run, found.schema).drop("_hits")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if text is None or not spans:
        return text
    raw = text.encode()
    isword = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.r_[False, isword, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : starts[a]])
        done = int(ends[b - 1])
    return b"".join([*out, raw[done:]]).decode()
