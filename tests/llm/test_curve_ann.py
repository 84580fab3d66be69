import itertools

import numpy as np
from pyspark.sql import functions as F

from strataweave.llm import curve_ann
from strataweave.llm.hilbert import hilbert_index, with_hilbert


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = hilbert_index(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
        df = spark.createDataFrame([tuple(map(int, c)) for c in cells], [f"c{i}" for i in range(dims)])
        got = with_hilbert(df, df.columns, bits)
        want = {tuple(c): int(k) for c, k in zip(cells.tolist(), key)}
        assert {tuple(r)[:dims]: r["_curve"] for r in got.collect()} == want
        assert got.columns == [*df.columns, "_curve"]


def brute(rows, k=10, step=5):
    """rows: (id, vector or None) -> query -> ids nearest first."""
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % step == 0}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 3, "a") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, q string")
    out = {}
    for r in curve_ann.search(df, F.col("vec_id") % 5 == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.id))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_cases_exact_with_full_window(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)]
    rows += [(300, None), (305, [0.0] * 6), (310, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (315, [float("nan")] * 6), (320, [float("inf")] * 6), (None, [1.0] * 6), (325, []), (330, [1.0, 2.0])]
    rows += [(5, rows[5][1])]  # a repeated row
    got = run(spark, rows, window=1.0)
    assert got == brute([r for r in rows if r[0] != 330])
    assert run(spark, rows[:4], window=1.0) == brute(rows[:4])
    assert run(spark, []) == {} and run(spark, [(0, [1.0, 2.0])]) == {}


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows], float)
    want = {}
    for n, (i, _) in enumerate(rows):
        if i % 50 == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
            want[i] = {rows[j][0] for j in np.argsort(d, kind="stable")[:11]} - {i}
    hits = total = 0
    for r in curve_ann.search(df, F.col("vec_id") % 50 == 0).collect():
        hits += r.id in want[r.query_id]
        total += 1
    assert total == 10 * len(want) and hits / total >= 0.9


def test_default_window_covers_small_tables(spark):
    """Up to a few hundred distinct vectors the default finds what brute force finds, also beside a vector with very many copies."""
    rng = np.random.default_rng(7)
    for n in (2, 11, 25, 100):
        rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(n)]
        assert run(spark, rows) == brute(rows), n
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(25)]
    rows += [(i, rows[0][1]) for i in range(25, 2000)]
    got, want = run(spark, rows), brute(rows[:25] + rows[25:45])
    assert {q: got[q] for q in range(0, 25, 5)} == {q: want[q] for q in range(0, 25, 5)}


def test_window_has_a_floor_in_rows():
    for n in (1, 2, 11, 25, 63, 64, 100, 500, 2000, 8191, 8192, 10_256):
        x = np.random.default_rng(n).normal(size=(n, 8))
        c = curve_ann.Curves(x, n, 2, 8, 4, curve_ann.WINDOW)
        for i in range(2):
            size = np.bincount(c.block(i, x), minlength=c.blocks)
            seen = np.array([[size[max(0, b - c.reach) : b].sum(), size[b + 1 : b + c.reach + 1].sum()] for b in range(c.blocks)])
            ends = np.array([[size[:b].sum(), size[b + 1 :].sum()] for b in range(c.blocks)])
            assert (seen >= np.minimum(ends, curve_ann.LEAST)).all(), n


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 3).astype(np.float32).tolist()) for i in range(90)] + [(500, [1.0])]
    want = {}
    for d in (3, 4, 5, 1):
        want.update(brute([r for r in rows if len(r[1]) == d]))
    got = run(spark, rows)
    assert got == {q: v for q, v in want.items() if v}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert curve_ann.search(df, F.col("vec_id") % 5 == 0).count() == sum(map(len, got.values()))


def test_narrow_window_on_clustered_vectors(spark):
    """Clusters along few directions: 0.4 % of the table on either side of each curve finds nine in ten."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24)) * 6
    rows = [(i, (centres[i % 60] + rng.normal(size=24) @ np.diag(np.r_[np.ones(3), np.full(21, 0.05)])).tolist()) for i in range(12_000)]
    x = np.array([v for _, v in rows])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    hit = total = 0
    found = {}
    for r in curve_ann.search(df, F.col("vec_id") % 200 == 0, window=0.004).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    for q, ids in found.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(ids & set(np.argsort(d)[:10].tolist()))
        total += 10
    assert total == 600 and hit / total >= 0.9
