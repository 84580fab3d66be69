"""Registered queries read all rows of their tables."""

import random

from strataweave import queries
from strataweave.operators import partitioning as K


def test_ransac_fit_uses_every_part(spark, sf):
    parts = [(r.p_partkey, r.p_brand) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand").collect()]
    pages = {}
    for k, brand in parts:
        pages.setdefault(f"{brand}:{k // 200}", []).append(k)
    got = {r.page: r for r in queries.QUERIES["ransac_fit"](spark, sf).collect()}
    assert set(got) == set(pages)
    clear = {p for p, ks in pages.items() if len(ks) >= 6 and all(k % 9 for k in ks)}
    assert clear and all(got[p]["pass"] and got[p].inliers == len(pages[p]) for p in clear)
    assert all(abs(got[p].scale - (0.0441**2 + 0.0235**2) ** 0.5) < 1e-5 for p in clear)
    assert any(not r["pass"] for r in got.values())


def test_components_use_every_supplier(spark, tmp_path):
    spark.range(1, 301).withColumnRenamed("id", "s_suppkey").where("s_suppkey > 90").write.parquet(f"{tmp_path}/supplier.parquet")
    edges = {(f"s{k % 40}", f"c{k * 7 % 60}") for k in range(91, 301)}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in queries.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == label and len(set(got.values())) == 20


def test_revisions_of_three_digits(spark, tmp_path):
    spark.range(6000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.lineage: r for r in queries.QUERIES["revision_chain"](spark, str(tmp_path)).collect()}
    assert all((got[k].latest, got[k].status) == (5950 + k, "latest") for k in range(30))
    assert all(got[k].latest is None for k in range(30, 50))


def test_lpt_bins_deal_every_item(spark, tmp_path):
    n = 100_003
    spark.range(n).selectExpr("id as item_id", "repeat('word ', cast(id % 37 as int)) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["lpt_bins"](spark, str(tmp_path)).collect()
    assert sum(r.pages for r in got) == n
    weight = lambda t: 1 + 8 * (t % 4) + 2 * (t % 3) + 2 * (t % 2) + 0.02 * t
    assert abs(sum(r.weight for r in got) - sum(weight(i % 37) for i in range(n))) < 1e-3
    assert max(r.weight for r in got) - min(r.weight for r in got) <= max(map(weight, range(37)))


def test_lpt_loads_are_those_of_the_plan():
    rnd = random.Random(3)
    for case in range(200):
        counts = {rnd.choice([0.5, 1, 1.5, 2, 7, 30, 64]): rnd.choice([1, 2, 5, 40, 300]) for _ in range(rnd.randrange(6))}
        n = rnd.choice([1, 2, 5, 16])
        items = [(f"{w}-{i}", w) for w, c in counts.items() for i in range(c)]
        want = {}
        plan = K.lpt_bins(items, n)
        for name, w in items:
            size, load = want.get(plan[name], (0, 0.0))
            want[plan[name]] = (size + 1, load + w)
        assert {k: v for k, v in enumerate(K.lpt_loads(list(counts.items()), n)) if v[0]} == want, case
