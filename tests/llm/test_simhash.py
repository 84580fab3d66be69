import numpy as np
import pytest
import xxhash

from strataweave.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, id string, component_id bigint"


def brute_fp(text):
    words, w = [], b""
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        if c == 0x20 or 9 <= c <= 13:
            if w:
                words.append(w)
            w = b""
        else:
            w += bytes([c])
    if w:
        words.append(w)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    """fps by id -> smallest id of the component."""
    ids = sorted(fps)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_fingerprint_rule():
    for t in [None, "", " \t\n", "One", "a b c", "A B c D", "the cat sat on the mat " * 30, "é È ÀB\x0bc d\x1ce f"]:
        assert simhash.fingerprint(t.encode() if t is not None else None) % 2**64 == brute_fp(t)


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    t = " ".join("w%d" % i for i in rng.integers(0, 500, 4000)) + "  " + "x" * 300 + " end of it"
    whole = simhash.fingerprint(t.encode())
    for size in (7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(t.encode()) == whole
    assert whole % 2**64 == brute_fp(t)


@pytest.mark.parametrize("size", [1 << 22, 20_000])
def test_meet_finds_all_components(monkeypatch, size):
    monkeypatch.setattr(simhash, "PASS", size)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for b in base[:20]:
        for k in (1, 2, 3, 4, 5, 9):
            x = int(b)
            for i in rng.choice(64, k, replace=False):
                x ^= 1 << int(i)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    parent = {i: i for i in range(len(fps))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = {int(f): i for i, f in enumerate(fps)}
    for bucket in range(64):
        a, b = simhash._meet(fps, bucket, 6, 2, 4)
        for x, y in zip(a.tolist(), b.tolist()):
            parent[max(root(at[x]), root(at[y]))] = min(root(at[x]), root(at[y]))
    want = brute_components({i: int(f) for i, f in enumerate(fps)})
    assert {i: root(i) for i in range(len(fps))} == want


def test_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "A b c D e f g"), (5, "quite another text of words here"), (None, "a b c d e f g"), (5, "quite another text of words here"), (9, None), (None, "alone and without any id at all")]
    docs = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert len(got) == len(rows)
    comp = [(r.doc_id, r.component_id) for r in got]
    assert sorted(comp, key=str) == sorted([(1, 1), (2, 1), (9, 1), (3, 3), (4, 3), (None, 3), (5, 5), (5, 5), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == 4


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def test_hot_key_is_salted(spark, monkeypatch):
    from strataweave.core import skew

    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    text = "the same words over and over again"
    docs = spark.createDataFrame([(i, text if i % 2 else f"text {i} has its own words {i * 7} and {i * 13}") for i in range(4000)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 4000 and {got[i] for i in range(1, 4000, 2)} == {1}


def test_repeated_ids_are_decided_by_row(spark):
    """An id over several texts stays where it is its group's smallest and goes where it is not; equal rows with one id stay together."""
    a, b, c = "the same words over and over again", "quite another text of words here", "alone and without any copy at all"
    rows = [(2, b), (5, b), (5, a), (9, a), (7, c), (7, c), (7, b), (8, c)]
    docs = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, b), (5, a), (7, c), (7, c)]


def test_buckets_stay_bounded():
    """Fingerprints a bucket receives on average: each goes to all buckets of its ball."""
    for n in (1, 10**4, 10**6, 10**8, 10**9, 10**11):
        bits = simhash._bucket_bits(n, 2)
        keys = len(np.unique(simhash._linear(simhash._masks(2), bits)))
        assert keys <= 1 + bits + bits * (bits - 1) // 2
        assert n * keys / 2**bits <= simhash.BUCKET
        assert bits == 6 or n * keys / 2 ** (bits - 1) > simhash.BUCKET / 4
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**63, 60_000, dtype=np.uint64)
    load = np.bincount(simhash._linear(fps, 8), minlength=256)
    assert load.max() < 1.4 * load.mean()


def test_keep_one_row_leaves_one_of_each_group(spark):
    a, b, c = "the same words over and over again", "quite another text of words here", "alone and without any copy at all"
    rows = [(2, b), (5, b), (5, a), (9, a), (7, c), (7, c), (7, b), (8, c), (None, c), (None, None), (None, ""), (None, "only rows without an id say this here")]
    docs = spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], "doc_id bigint, text string, fp string, root string, component_id bigint")
    kept = simhash.keep_one_row(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) in [sorted([(2, b), (5, a), (7, c), (None, x), (None, rows[-1][1])], key=str) for x in (None, "")]
    assert simhash.keep_one_row(docs.limit(0)).count() == 0
    plain = docs.where("doc_id in (2, 9, 8)")
    assert sorted(r.doc_id for r in simhash.keep_one_row(plain).collect()) == [2, 8, 9]


def test_keep_one_row_against_brute_force(spark, sf):
    """Every row twice, and ids taken together in pairs: one row for each component of the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id // 2, r.text) for r in docs.collect()] * 2
    fps = {t: brute_fp(t) for _, t in rows}
    comp = brute_components({i: f for i, f in enumerate(sorted(set(fps.values())))})
    of = {f: comp[i] for i, f in enumerate(sorted(set(fps.values())))}
    got = simhash.keep_one_row(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    low = {}
    for i, t in rows:
        low[of[fps[t]]] = min(i, low.get(of[fps[t]], i))
    assert sorted((of[fps[r.text]], r.doc_id) for r in got) == sorted(low.items())
