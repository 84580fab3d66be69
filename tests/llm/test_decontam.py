import re

from strataweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            bw = words(b)
            n = min(10, len(bw))
            wins = {tuple(bw[k : k + n]) for k in range(len(bw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if wins else ():
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    if item is not None:
                        items.add(str(item))
        out.append((i, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, bench):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id bigint, text string, doc_id int")
    got = sorted((tuple(r) for r in decontam.contamination(d, b).collect()), key=str)
    assert got == brute(docs, bench)
    return d, b


LONG = " ".join(f"word{i}" for i in range(40))
DOCS = [(1, None), (2, ""), (3, LONG), (4, f"before {LONG.upper()} after"), (5, "tiny item"), (6, "Tiny-ITEM, tiny item"), (7, "nothing"), (8, "é ça 漢字 x"), (8, "é ça 漢字 x"), (None, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 x word30")]
BENCH = [(10, LONG), (9, "tiny item"), (11, "!!"), (12, None), (13, "ÇA 漢字"), (14, "ça 漢字"), (None, "nothing"), (9, "tiny item")]


def test_cases(spark):
    check(spark, DOCS, BENCH)
    check(spark, DOCS, [])
    check(spark, [], BENCH)


def test_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 5)
    check(spark, DOCS, BENCH)
    monkeypatch.setattr(decontam, "PIECE", 16)
    w = decontam.Windows([(str(i), t.encode() if t else t) for i, t in BENCH if t])
    whole = [w.scan(t.encode() if t else None) for _, t in DOCS]
    monkeypatch.setattr(decontam, "PIECE", 1 << 22)
    for (n, spans, items), (_, t) in zip(whole, DOCS):
        n2, spans2, items2 = w.scan(t.encode() if t else None)
        assert (n, spans, sorted(items)) == (n2, spans2, sorted(items2))


def test_removal(spark):
    d, b = check(spark, DOCS, BENCH)
    kept = decontam.remove_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    cut = {r.doc_id: r.text for r in decontam.remove_spans(d, b).where("doc_id in (4, 6, 1)").collect()}
    assert cut[4] == "before  after" and cut[6] == "" and cut[1] is None


def test_large_benchmark_in_bounded_plans(spark, monkeypatch):
    """Many blocks: checkpoints between chains of them; items longer than a block come in pieces that lose no window."""
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontam, "CHAIN", 2)
    long_item = " ".join(f"w{i % 97}x{i // 97}" for i in range(400))
    w = long_item.split()
    docs = [(k, " ".join(["pre", *w[k : k + 10], "post"])) for k in range(0, 391, 30)] + [(1000, " ".join(w[5:14])), (1001, "tiny"), (1002, long_item)]
    check(spark, docs, [(1, long_item), (2, "tiny"), (3, long_item.upper()), (4, "p " * 500)])
    pieces = list(decontam._pieces(long_item.encode(), 10))
    assert len(pieces) > 5
    grams = lambda x: {tuple(x[i : i + 10]) for i in range(len(x) - 9)}
    assert set().union(*(grams(p.split()) for p in pieces)) == grams(long_item.encode().split())


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontam, "_roll", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    w = decontam.Windows([("a", b"one two three"), ("b", b"four five six"), ("a", b"one two nine")], 3)
    assert w.scan(b"zero four five six one two nine") == (7, [(1, 7)], w.scan(b"zero four five six one two nine")[2])
    assert sorted(w.scan(b"zero four five six one two nine")[2]) == ["a", "b"] and w.scan(b"one two four")[1] == []
