"""Legends against plain code on random pages; the extraction chain on a small drawing."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strataweave.operators import legend as L
from strataweave.operators.reconcile import hatch_style
from strataweave.plans.extraction import extract

LABELS = "page int, label int, material string, role string, confidence double, x double, y double, items array<int>"
TEXTS = "page int, item int, text string, x double, y double, size double"
PATHS = "page int, path int, closed boolean, fill_key string, hatch_key string, min_x double, min_z double, max_x double, max_z double"


def _up(v):
    return math.floor(v * 1000 + 0.5) / 1000


def _plain(labels, texts, paths):
    """The same rules on one page, item by item."""
    middle = lambda p: ((p[5] + p[7]) / 2, (p[6] + p[8]) / 2)
    code = lambda t: t.replace("-", "") if t[0].isalpha() and t[-1].isdigit() else None
    inside = lambda s, b: s[1] != b[1] and b[5] <= middle(s)[0] <= b[7] and b[6] <= middle(s)[1] <= b[8]
    strokes = [p for p in paths if p[4]]
    entries = []
    for lb in labels:
        _, label, material, role, conf, x, y, items = lb
        near = [(abs(t[4] - y) * 12 + abs(t[3] - x) + 8 * (t[3] > x), t[1], code(t[2]), t[5]) for t in texts if code(t[2]) and t[1] not in items and abs(t[4] - y) <= 4 and abs(t[3] - x) <= 180]
        swatches = []
        for p in paths:
            w, h = p[7] - p[5], p[8] - p[6]
            if not p[2] or not (3 <= w <= 84 and 3 <= h <= 84):
                continue
            n = Counter(s[4] for s in strokes if inside(s, p))
            top = min(((-v, k) for k, v in n.items() if v >= 2), default=(0, None))[1]
            dx, dy = middle(p)[0] - x, middle(p)[1] - y
            if (p[3] or top) and math.hypot(dx, dy) <= 190 and abs(dy) <= 46.2:
                swatches.append((math.hypot(dx, dy) + 12 * (dx > 0) - 3 * bool(p[3]) - 4 * bool(top), p[1], p[3], top))
        c, s = min(near, default=None), min(swatches, key=lambda v: v[:2], default=None)
        if c or s:
            entries.append(dict(label=label, material=material, ok=role == "surface", code=c and c[2], item=c and c[1], size=c and c[3], swatch=s and s[1], fill=s and s[2], hatch=s and s[3], confidence=_up(conf * (0.98 if c and s else 0.94))))
    means = {}
    for key in ("code", "fill", "hatch"):
        groups = {}
        for e in entries:
            if e["ok"] and e[key]:
                groups.setdefault(e[key], []).append(e)
        means[key] = {k: min(v, key=lambda e: (-e["confidence"], e["label"])) for k, v in groups.items() if len({e["material"] for e in v}) == 1}
    found = []
    for t in texts:
        e = means["code"].get(code(t[2]))
        if e and t[1] != e["item"] and 0.45 <= t[5] / e["size"] <= 2.4:
            found.append((e["material"], t[3], t[4], _up(min(0.82, e["confidence"] * 0.88)), "pdf-legend-code-material"))
    used = {e["swatch"] for e in entries}
    for p in paths:
        if not p[2] or p[1] in used:
            continue
        hits = []
        if p[3] in means["fill"]:
            e = means["fill"][p[3]]
            hits.append((-min(0.8, e["confidence"] * 0.86), "pdf-legend-fill-material", e["label"], e["material"]))
        for k, n in Counter(s[4] for s in strokes if inside(s, p)).items():
            if n >= 3 and k in means["hatch"]:
                e = means["hatch"][k]
                hits.append((-min(0.76, e["confidence"] * 0.8), "pdf-legend-hatch-material", e["label"], e["material"]))
        if len({h[3] for h in hits}) == 1:
            b = min(hits)
            found.append((b[3], *middle(p), _up(-b[0]), b[1]))
    best = {}
    for m, x, y, c, s in found:
        k = (m, math.floor(x * 10 + 0.5), math.floor(y * 10 + 0.5))
        best[k] = min(best.get(k, (1, "")), (-c, s))
    return {(m, x / 10, y / 10, -c, s) for (m, x, y), (c, s) in best.items()}


def test_same_as_plain_code_on_random_pages(spark):
    rnd = random.Random(11)
    labels, texts, paths, want = [], [], [], set()
    for page in range(12):
        at = lambda: (float(rnd.randrange(0, 600)), float(rnd.randrange(0, 400)))
        lb = [(page, i, rnd.choice(["asphalt", "gravel", "brick"]), rnd.choice(["surface", "surface", "wall"]), rnd.choice([0.72, 0.9, 0.95]), *at(), [i]) for i in range(8)]
        tx = [(page, i, rnd.choice(["S1", "S-2", "PV10", "words", "T3"]), *at(), rnd.choice([4.0, 8.0, 12.0, 30.0])) for i in range(8, 60)]
        tx += [(page, 100 + i, rnd.choice(["S1", "S-2", "PV10", "T3", "Q4"]), l[5] + rnd.choice([-60.0, 20.0]), l[6] + rnd.choice([0.0, 2.0, 3.0]), 8.0) for i, l in enumerate(lb)]
        pa = []
        for i in range(70):
            x, y = at()
            w, h = rnd.choice([(10, 6), (40, 20), (120, 90)])
            pa.append((page, i, True, rnd.choice([None, "fill:8,8,8", "fill:200,0,0", "fill:0,0,200", "fill:0,96,0"]), None, x, y, x + w, y + h))
        for i in range(70, 330):
            x, y = at()
            pa.append((page, i, False, None, rnd.choice(["hatch:a45", "hatch:a90", "hatch:a0"]), x, y, x + 4, y + 4))
        labels, texts, paths = labels + lb, texts + tx, paths + pa
        want |= {(page, *r) for r in _plain(lb, tx, pa)}
    l, t, p = spark.createDataFrame(labels, LABELS), spark.createDataFrame(texts, TEXTS), spark.createDataFrame(paths, PATHS)
    got = {(r.page, r.material, math.floor(r.x * 10 + 0.5) / 10, math.floor(r.y * 10 + 0.5) / 10, r.confidence, r.source) for r in L.legend_observations(L.legend_entries(l, t, p), t, p).collect()}
    assert got == want and {s for *_, s in got} == {f"pdf-legend-{k}-material" for k in ("code", "fill", "hatch")}


def test_no_rows(spark):
    l, t, p = (spark.createDataFrame([], s) for s in (LABELS, TEXTS, PATHS))
    assert L.legend_observations(L.legend_entries(l, t, p), t, p).count() == 0


def test_chain(spark):
    pages = spark.createDataFrame([(1, "unknown", "Proposed site plan", 0), (2, "landscape", None, 3), (3, None, None, 0)], "page int, class string, title string, images int")
    texts = spark.createDataFrame([(1, 0, "S1", 10.0, 50.0, 8.0, 12.0), (1, 1, "Gravel", 40.0, 50.0, 8.0, 30.0), (1, 2, "S1", 300.0, 200.0, 8.0, 12.0), (1, 3, "FFL 12.50", 100.0, 300.0, 8.0, 40.0), (1, 4, "Scale 1:200", 400.0, 10.0, 8.0, 60.0), (1, 5, None, 1.0, 1.0, 8.0, 1.0)], "page int, item int, text string, x double, y double, size double, width double")
    paths = spark.createDataFrame([(1, 7, True, True, "fill:8,8,8", None, 0.0, 0.0, 400.0, 300.0)], "page int, path int, closed boolean, meaningful boolean, fill_key string, hatch_key string, min_x double, min_z double, max_x double, max_z double")
    p, e = extract(pages, texts, paths)
    got = {r.page: r for r in p.collect()}
    assert got[1]["class"] == "site_plan" and got[1].title_block.scale == 200 and got[1].status == "extracted" and (got[1].materials, got[1].legends, got[1].levels) == (1, 1, 1)
    assert got[2]["class"] == "landscape_plan" and got[2].raster_fallback.startswith("image-dominant") and got[3].status == "raster-fallback-required" and got[3].materials == 0
    rows = {(r.kind, r.name, r.value, r.x, r.y) for r in e.collect()}
    assert ("legend", "gravel", None, 300.0, 200.0) in rows and any(r[:1] == ("material",) and r[1] == "gravel" for r in rows) and any(r[:3] == ("level", "FFL", 12.5) for r in rows)


def test_hatch_key_with_dashes(spark):
    key = lambda dash: spark.range(1).select(hatch_style(F.lit(3.0), F.lit(3.0), F.array(F.lit(10), F.lit(0), F.lit(0)), F.lit(1.0), dash).alias("k")).first().k
    assert key(None).startswith("hatch:a45:c8") and key(None).endswith(":w1.0")
    assert key(F.array(F.lit(2.0), F.lit(1.3))) == key(None) + ":d2.0,1.5" and key(F.array().cast("array<double>")) == key(None) + ":d"
