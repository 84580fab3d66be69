"""Registered queries of proofs, profiles, ground rules and bundles, each beside the SQL that must agree, where SQL can say it.

As in ``queries``, positions and labels follow from keys, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.core.session import table
from strataweave.functions import appearance as A
from strataweave.operators import details as D
from strataweave.operators import legend as N
from strataweave.operators import ordered as O
from strataweave.operators import proof as P
from strataweave.operators import spatial as J
from strataweave.plans.extraction import extract
from strataweave.queries import _BOX, _boxes, query
from strataweave.queries_rules import _pick, _sql_pick

# ---------------------------------------------------------------- ground

_BANDS = {"r": ["90", "150", "90", "130", "200", "60"], "g": ["90", "150", "90", "92", "160", "140"], "b": ["94", "146", "92", "66", "138", "60"]}
_NOISE = ["2", "3", "18", "4", "2", "5"]
_CHANNEL = "least(255, {base} + k % 10 * {noise})"


def _lab_sql(source):
    linear = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"
    root = lambda c: f"CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0 / 3) ELSE 7.787 * {c} + 16.0 / 116 END"
    return f"""(SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (SELECT *, {root('cx')} AS fx, {root('cy')} AS fy, {root('cz')} AS fz FROM (SELECT *, (lr * 0.4124564::DOUBLE + lg * 0.3575761::DOUBLE + lb * 0.1804375::DOUBLE) / 0.95047 AS cx,
 lr * 0.2126729::DOUBLE + lg * 0.7151522::DOUBLE + lb * 0.0721750::DOUBLE AS cy, (lr * 0.0193339::DOUBLE + lg * 0.1191920::DOUBLE + lb * 0.9503041::DOUBLE) / 1.08883 AS cz FROM (SELECT *, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM {source}))))"""


@query(f"""WITH s AS (SELECT p_partkey AS k, p_partkey // 10 AS patch, {', '.join(_CHANNEL.format(base=_sql_pick(v, 'p_partkey // 10 % 6').replace("'", ''), noise=_sql_pick(_NOISE, 'p_partkey // 10 % 6').replace("'", '')).replace('k %', 'p_partkey %') + f'::DOUBLE AS {c}' for c, v in _BANDS.items())} FROM part),
m AS (SELECT patch, median(r) AS r, median(g) AS g, median(b) AS b, count(*) AS n FROM s GROUP BY 1), ml AS (SELECT * FROM {_lab_sql('m')}), t AS (SELECT s.patch, avg(sqrt(pow(s.l - ml.l, 2) + pow(s.a - ml.a, 2) + pow(s.bb - ml.bb, 2))) AS t FROM {_lab_sql('s')} s JOIN ml USING (patch) GROUP BY 1),
p AS (SELECT patch, r, g, b, l, t, 0.2::DOUBLE + patch % 4 * 0.15::DOUBLE AS res, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) AS sat FROM ml JOIN t USING (patch) WHERE n >= 8),
q AS (SELECT *, CASE WHEN sat < 0.2 AND l < 52 AND t < 14 THEN 'asphalt' WHEN sat < 0.18 AND l >= 52 AND l < 86 AND t < 12 THEN 'concrete' WHEN sat < 0.24 AND t > 18 THEN 'gravel'
 WHEN r > g * 1.13::DOUBLE AND g > b * 1.12::DOUBLE AND sat BETWEEN 0.18 AND 0.62 AND l BETWEEN 28 AND 68 THEN 'earth' WHEN r > g * 1.15::DOUBLE AND g > b * 1.05::DOUBLE AND res <= 0.35 THEN 'paving_stones' END AS material FROM p)
SELECT s.patch, material, CASE WHEN q.patch IS NOT NULL THEN floor(1000 * CASE material WHEN 'asphalt' THEN greatest(0.68, least(0.92, 0.84::DOUBLE + (0.5 - res) * 0.08 - t / 180)) WHEN 'concrete' THEN greatest(0.67, least(0.9, 0.83::DOUBLE + (0.5 - res) * 0.06 - t / 180))
 WHEN 'gravel' THEN greatest(0.58, least(0.8, 0.72::DOUBLE + (0.5 - res) * 0.08)) WHEN 'earth' THEN greatest(0.68, least(0.88, 0.74::DOUBLE + greatest(0, least(1, 1 - abs(t - 10) / 18)) * 0.12 + (0.5 - res) * 0.05)) WHEN 'paving_stones' THEN 0.7 ELSE 0 END + 0.5) / 1000 END AS confidence,
 CASE WHEN t < 7 AND res <= 0.6 THEN 'solid' END AS pattern FROM (SELECT DISTINCT patch FROM s) s LEFT JOIN q ON q.patch = s.patch""")
def ground_surfaces(spark, sf):
    k = F.col("p_partkey")
    patch = F.floor(k / 10)
    band = lambda c: F.least(F.lit(255), _pick(_BANDS[c], patch % 6).cast("int") + k % 10 * _pick(_NOISE, patch % 6).cast("int")).alias(c)
    s = table(spark, sf, "part").select(patch.alias("patch"), F.struct(*[band(c) for c in "rgb"]).alias("s"))
    p = s.groupBy("patch").agg(A.ground_patch(F.collect_list("s")).alias("p"))  # ten samples a patch
    gsd = F.lit(0.2) + F.col("patch") % 4 * 0.15
    m = A.ground_material(F.col("p"), gsd)
    return p.select("patch", m["value"].alias("material"), m["confidence"].alias("confidence"), A.ground_pattern(F.col("p"), gsd)["value"].alias("pattern"))


_GROUND = ["dense-tree-canopy", "vegetation", "grass", "dry-grass", "soil-mulch", "sand", "shadow", "unclassified"]


@query()
def planted_points(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.floor(k / 400).alias("area"), (k % 20 * 2).alias("x"), (F.floor(k / 20) % 20 * 2).alias("z"), _pick(_GROUND, k % 8).alias("ground"))
    return O.blue_noise(p, "area", "x", "z", 5.0, multiplier=A.planting_factor(F.col("ground"), F.when(F.col("area") % 2 == 0, "shrubland").otherwise("tree")), target=10 + F.col("area") % 50)


# ---------------------------------------------------------------- profiles and water

@query("""WITH a AS (SELECT s_suppkey // 4 AS k, (s_suppkey * 53 % 300)::DOUBLE / 4 + CASE WHEN s_suppkey % 4 = 3 THEN 0.3 ELSE 0 END AS pos, (s_suppkey * 29 % 71)::DOUBLE AS level, 0.5::DOUBLE + s_suppkey % 50 / 100.0::DOUBLE AS conf, 's' || s_suppkey AS ref FROM supplier UNION ALL
 SELECT s_suppkey // 4, (s_suppkey * 53 % 300)::DOUBLE / 4 + 0.5, (s_suppkey * 31 % 73)::DOUBLE, 0.9, 't' || s_suppkey FROM supplier),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 0.75 THEN 1 ELSE 0 END AS gap FROM a), g AS (SELECT *, sum(gap) OVER (PARTITION BY k ORDER BY pos) AS run FROM f),
m AS (SELECT k, median(pos) AS pos, median(level) AS level, min(conf) AS conf, string_agg(DISTINCT ref, '|' ORDER BY ref) AS ref FROM g GROUP BY k, run), w AS (SELECT * FROM m WHERE k IN (SELECT k FROM m GROUP BY 1 HAVING count(*) >= 2 AND max(pos) - min(pos) >= 5)),
s AS (SELECT o_orderkey AS id, o_custkey // 60 AS k, (o_orderkey * 7 % 650)::DOUBLE / 8 AS pos FROM orders), b AS (SELECT s.*, l.pos AS la, l.level AS ll, l.conf AS lc, l.ref AS lr FROM s ASOF LEFT JOIN w l ON s.k = l.k AND s.pos > l.pos),
c AS (SELECT b.*, r.pos AS ra, r.level AS rl, r.conf AS rc, r.ref AS rr, r.pos IS NOT NULL AND (la IS NOT NULL OR b.pos = r.pos) AS inside FROM b ASOF LEFT JOIN w r ON b.k = r.k AND b.pos <= r.pos),
d AS (SELECT *, CASE WHEN NOT inside THEN 0 WHEN pos - la <= 0.45::DOUBLE THEN 1 WHEN ra - pos <= 0.45::DOUBLE THEN 2 ELSE 3 END AS how FROM c)
SELECT id, round(CASE how WHEN 1 THEN ll WHEN 2 THEN rl WHEN 3 THEN ll + (rl - ll) * ((pos - la) / (ra - la)) END, 9) AS level, round(CASE how WHEN 1 THEN lc WHEN 2 THEN rc WHEN 3 THEN least(lc, rc) * 0.82 END, 9) AS confidence,
 CASE how WHEN 1 THEN lr WHEN 2 THEN rr WHEN 3 THEN lr || '|' || rr END AS ref, CASE how WHEN 0 THEN 'none' WHEN 3 THEN 'interpolated' ELSE 'planning-verified' END AS evidence FROM d""")
def anchored_levels(spark, sf):
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    at = (k * 53 % 300).cast("double") / 4
    one = table(spark, sf, "supplier").select(F.floor(k / 4).alias("k"), (at + F.when(k % 4 == 3, 0.3).otherwise(0.0)).alias("at"), (k * 29 % 71).cast("double").alias("level"), (0.5 + k % 50 / 100.0).alias("confidence"), F.concat(F.lit("s"), k).alias("ref"))
    two = table(spark, sf, "supplier").select(F.floor(k / 4), at + 0.5, (k * 31 % 73).cast("double"), F.lit(0.9), F.concat(F.lit("t"), k))
    s = table(spark, sf, "orders").select(o.alias("id"), F.floor(F.col("o_custkey") / 60).alias("k"), ((o * 7 % 650).cast("double") / 8).alias("at"))
    p = O.anchored_profile(s, one.union(two), ["k"], "at", "level", "confidence", "ref")
    return p.select("id", F.round("level", 9).alias("level"), F.round("confidence", 9).alias("confidence"), "ref", "evidence")


_PROVIDERS = ["OpenStreetMap", "Overture Maps Foundation", "Survey Water", "Agency"]
_PREFIXES = ["override:", "planning:", "public:", "w:", "osm:"]


@query(f"""WITH p AS (SELECT p_partkey AS k, {_sql_pick(_PREFIXES, 'p_partkey % 5')} || p_partkey AS id, {_sql_pick(_PROVIDERS, 'p_partkey % 4')} AS provider, CASE WHEN p_partkey % 11 = 0 THEN 120 END AS own, p_size % 2 = 0 AS verified, CASE WHEN p_size % 3 = 0 THEN p_partkey * 7 % 260 - 20 END AS direct, CASE WHEN p_size % 5 < 2 THEN p_partkey * 13 % 600 - 20 END AS maximum FROM part),
r AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN id LIKE 'override:%' THEN 500 WHEN id LIKE 'planning:%' THEN 400 WHEN id LIKE 'public:%' THEN 300 WHEN provider = 'OpenStreetMap' THEN 100 WHEN provider = 'Overture Maps Foundation' THEN 80 WHEN verified THEN 300 ELSE 150 END AS rank FROM p),
t AS (SELECT *, rank > 100 AND provider NOT IN ('OpenStreetMap', 'Overture Maps Foundation') AS trusted FROM r),
u AS (SELECT *, CASE WHEN trusted AND direct > 0 AND direct <= 200 THEN 'measured' WHEN trusted AND maximum > 0 AND maximum <= 500 THEN 'measured-max-depth' WHEN direct IS NOT NULL OR maximum IS NOT NULL THEN 'reported-not-bathymetry' ELSE 'unknown' END AS status FROM t)
SELECT k, rank, status, CASE WHEN status = 'measured' THEN direct::DOUBLE END AS depth, CASE WHEN status = 'measured-max-depth' THEN maximum::DOUBLE END AS max_depth, CASE status WHEN 'measured' THEN 0.9 WHEN 'measured-max-depth' THEN 0.82 WHEN 'reported-not-bathymetry' THEN 0.35 END::DOUBLE AS confidence FROM u""")
def water_depths(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    d = table(spark, sf, "part").select(
        k.alias("k"), F.concat(_pick(_PREFIXES, k % 5), k).alias("id"), _pick(_PROVIDERS, k % 4).alias("provider"), F.when(k % 11 == 0, 120).alias("own"), (z % 2 == 0).alias("verified"),
        F.when(z % 3 == 0, k * 7 % 260 - 20).alias("direct"), F.when(z % 5 < 2, k * 13 % 600 - 20).alias("maximum"),
    )
    d = d.withColumn("rank", D.water_rank(F.col("id"), F.col("provider"), F.col("own"), F.col("verified")))
    return d.select("k", "rank", D.water_depth(F.col("direct"), F.col("maximum"), F.col("rank"), F.col("provider")).alias("d")).select("k", "rank", "d.status", "d.depth", "d.max_depth", "d.confidence")


# ---------------------------------------------------------------- proofs

_CLASSES = ["site_plan", "landscape_plan", "ride_layout", "location_plan", "elevation"]
_STATES = ["proposed", "current", "unknown", "refused", "superseded", "proposed", "current"]
_STATUS = ["Approved 2019", "Granted with conditions", "Pending", "Refused"]
_PAGE = "o_orderkey // 8"
_PROOF = f"""WITH pg AS (SELECT DISTINCT {_PAGE} AS page_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), pages AS (SELECT page_id, page_id % 97 AS application, {_sql_pick(_CLASSES, 'page_id % 5')} AS class, {_sql_pick(_STATES, 'page_id % 7')} AS state, CASE WHEN page_id % 2 = 0 THEN 'ambiguous-document-revision-lineage' ELSE 'none' END AS reason,
 {_sql_pick(_STATUS, 'page_id % 4')} AS consent, page_id % 13 != 0 AS registered, CASE WHEN page_id % 17 = 0 THEN 1.4 ELSE 0.5 END AS page_rmse, CASE WHEN page_id % 19 != 0 THEN DATE '1996-01-01' END AS decision_at FROM pg),
mt AS (SELECT l_orderkey // 8 AS page_id, l_partkey * 4 AS feature_id, l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 3 % 13 / 10.0::DOUBLE END AS rmse, l_shipdate AS seen FROM lineitem),
ft AS (SELECT p_partkey * 4 AS feature_id, {_sql_pick(['path', 'building', 'water'], 'p_partkey % 3')} AS feature_kind, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN DATE '1995-06-01' ELSE DATE '2023-01-01' END AS observed_at FROM part WHERE p_partkey % 23 != 0),
j AS (SELECT mt.page_id, mt.feature_id, candidate_id, rmse, feature_kind, CASE WHEN NOT registered THEN 'registration-not-passed' WHEN decision_at IS NULL THEN 'missing-planning-decision-date' WHEN page_rmse > 1 THEN 'registration-page-rmse-above-proof-gate' WHEN ft.feature_id IS NULL THEN 'registration-reference-feature-missing'
 WHEN observed_at IS NULL THEN 'current-observation-missing-timestamp' WHEN observed_at <= decision_at THEN 'observation-not-post-decision' WHEN rmse IS NULL OR rmse > 1 THEN 'registration-match-rmse-above-proof-gate' ELSE 'anchor' END AS st FROM mt JOIN pages USING (page_id) LEFT JOIN ft USING (feature_id)),
r AS (SELECT page_id, feature_id, candidate_id, feature_kind, CASE WHEN st = 'anchor' AND row_number() OVER (PARTITION BY page_id, feature_id, st ORDER BY rmse NULLS FIRST, candidate_id) > 1 THEN 'duplicate-feature' ELSE st END AS status, floor((1 - rmse / 4) * 1000 + 0.5) / 1000 AS score FROM j)"""
_CERTIFIED = _PROOF + """, a AS (SELECT page_id, feature_id, feature_kind, score, true AS own FROM r WHERE status = 'anchor' UNION ALL SELECT l_orderkey // 8, l_suppkey * 4 + 1, CASE WHEN l_suppkey % 2 = 0 THEN 'path' ELSE 'road' END, 0.5::DOUBLE + l_linenumber * 0.06::DOUBLE, false FROM lineitem),
g AS (SELECT page_id, count(*) AS n, count(DISTINCT feature_id) AS f, count(DISTINCT feature_kind) AS k, median(score) AS m, count(*) FILTER (own) AS on_, count(DISTINCT feature_id) FILTER (own) AS of_, median(score) FILTER (own) AS om FROM a GROUP BY 1),
h AS (SELECT *, on_ >= 3 AND of_ >= 3 AND coalesce(floor(om * 1000 + 0.5) / 1000, 0) >= 0.78 AS alone, n >= 4 AND f >= 2 AND (f >= 3 OR (k >= 2 AND n >= 8)) AND m >= 0.78 AS enough FROM g),
c AS (SELECT page_id, application, class, coalesce(alone, false) AS alone, CASE WHEN state IN ('refused', 'superseded') THEN 'page-explicitly-non-current' WHEN NOT registered THEN 'page-not-spatially-registered' WHEN class = 'elevation' THEN 'page-class-not-implementation-anchor'
 WHEN state = 'unknown' AND NOT (page_id % 2 = 0 AND regexp_matches(lower(consent), 'approved|granted|permitted|consent')) THEN 'page-lifecycle-not-eligible-for-corroboration' WHEN NOT coalesce(alone OR enough, false) THEN 'insufficient-independent-current-anchors'
 WHEN class = 'location_plan' THEN 'implemented-context-certified' ELSE 'implemented-plan-certified' END AS status, coalesce(CASE WHEN alone THEN on_ ELSE n END, 0) AS anchors, coalesce(CASE WHEN alone THEN of_ ELSE f END, 0) AS features, CASE WHEN alone THEN om ELSE m END AS med FROM pages LEFT JOIN h USING (page_id))"""


def _proof(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / 8))
    i, part = F.col("page_id"), F.col("p_partkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    pages = line.join(orders, "l_orderkey", "left_semi").select("page_id").distinct().select(
        "page_id", (i % 97).alias("application"), _pick(_CLASSES, i % 5).alias("class"), _pick(_STATES, i % 7).alias("state"), F.when(i % 2 == 0, "ambiguous-document-revision-lineage").otherwise("none").alias("reason"),
        F.array(_pick(_STATUS, i % 4)).alias("statuses"), (i % 13 != 0).alias("registered"), F.when(i % 17 == 0, 1.4).otherwise(0.5).alias("page_rmse"), F.when(i % 19 != 0, F.to_date(F.lit("1996-01-01"))).alias("decision_at"),
    )
    matches = line.select("page_id", (F.col("l_partkey") * 4).alias("feature_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 3 % 13 / 10.0).alias("rmse"))
    seen = F.when(part % 10 == 0, None).when(part % 3 == 0, F.to_date(F.lit("1995-06-01"))).otherwise(F.to_date(F.lit("2023-01-01")))
    features = table(spark, sf, "part").where(part % 23 != 0).select((part * 4).alias("feature_id"), _pick(["path", "building", "water"], part % 3).alias("feature_kind"), seen.alias("observed_at"))
    single = line.select("page_id", (F.col("l_suppkey") * 4 + 1).alias("feature_id"), F.when(F.col("l_suppkey") % 2 == 0, "path").otherwise("road").alias("feature_kind"), (0.5 + F.col("l_linenumber") * 0.06).alias("score"))
    return pages, P.registration_anchors(matches, pages.select("page_id", "registered", "page_rmse", "decision_at"), features), single


@query(_PROOF + " SELECT status, count(*) AS n, sum(candidate_id)::BIGINT AS ids, round(sum(CASE WHEN status = 'anchor' THEN score END), 6) AS total FROM r GROUP BY 1")
def registration_reasons(spark, sf):
    return _proof(spark, sf)[1].groupBy("status").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"), F.round(F.sum("score"), 6).alias("total"))


@query(_CERTIFIED + " SELECT page_id, class, status, alone, anchors, features, CASE WHEN status LIKE 'implemented%' THEN floor(least(0.97, 0.86::DOUBLE + greatest(0, coalesce(med, 0) - 0.78::DOUBLE) * 0.45 + least(0.06, anchors * 0.002::DOUBLE)) * 1000 + 0.5) / 1000 END AS confidence FROM c")
def certified_pages(spark, sf):
    return P.certified_pages(*_proof(spark, sf)).select("page_id", "class", "status", "alone", "anchors", "features", "confidence")


@query(_CERTIFIED + """ SELECT application, count(DISTINCT page_id) AS pages, count(*) AS anchors, count(DISTINCT feature_id) AS features, floor(least(0.96, 0.84::DOUBLE + least(0.1, 0.015::DOUBLE * count(DISTINCT feature_id)) + least(0.02, 0.001::DOUBLE * count(*))) * 1000 + 0.5) / 1000 AS confidence
FROM a JOIN c USING (page_id) WHERE status = 'implemented-plan-certified' AND (own OR NOT alone) GROUP BY 1""")
def proved_applications(spark, sf):
    pages, registered, single = _proof(spark, sf)
    return P.proved_applications(P.certified_pages(pages, registered, single), registered, single)


# ---------------------------------------------------------------- features and bundles

_NAMES = ["Mere  Lake", "mere lake ", "Oak Walk", "", "North Gate"]
_SPAN = _BOX.replace("997", "499").replace("991", "491")


@query(f"""WITH w AS (SELECT {_SPAN.format(k='p_partkey')}, 'way' AS element, {_sql_pick(_NAMES, 'p_partkey % 5')} AS name FROM part), r AS (SELECT {_SPAN.format(k='s_suppkey * 3')}, {_sql_pick(_NAMES, 's_suppkey % 5')} AS name FROM supplier), n AS (SELECT id + 1000000000 AS id, family, min_x - 6 AS min_x, min_z - 6 AS min_z, max_x + 60 AS max_x, max_z + 60 AS max_z, name FROM r),
g AS (SELECT DISTINCT w.id FROM w JOIN n ON w.family = n.family AND trim(w.name) != '' AND regexp_replace(lower(trim(w.name)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(n.name)), '\\s+', ' ', 'g') AND (least(w.max_x, n.max_x) - greatest(w.min_x, n.min_x)) / (w.max_x - w.min_x) >= 0.9 AND (least(w.max_z, n.max_z) - greatest(w.min_z, n.min_z)) / (w.max_z - w.min_z) >= 0.9)
SELECT id, 'way' AS element FROM w WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'relation' FROM n""")
def relation_ways(spark, sf):
    box = lambda df, k: _boxes(df, k, F.lit("area"), 499, 491).withColumn("kind", F.when(F.col("id") % 3 == 0, "line").otherwise("area")).drop("family").withColumn("subtype", F.lit(None).cast("string"))
    w = box(table(spark, sf, "part"), "p_partkey").withColumn("element", F.lit("way")).withColumn("name", _pick(_NAMES, F.col("id") % 5))
    r = box(table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("k"), "s_suppkey"), "k").withColumn("element", F.lit("relation")).withColumn("name", _pick(_NAMES, F.floor(F.col("id") / 3) % 5))
    r = r.withColumns({"id": F.col("id") + 1_000_000_000, "min_x": F.col("min_x") - 6, "min_z": F.col("min_z") - 6, "max_x": F.col("max_x") + 60, "max_z": F.col("max_z") + 60})
    return J.relations_over_ways(w.unionByName(r)).select("id", "element")


@query("""WITH p AS (SELECT l_orderkey % 3 AS bundle, l_orderkey * 10 + l_linenumber AS seq, 'h' || l_partkey // 3 AS h, l_linenumber AS page, l_quantity::BIGINT AS geometry, l_suppkey % 5 AS levels, l_partkey % 4 AS materials FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY h, page ORDER BY bundle, seq) AS rn FROM p)
SELECT (SELECT count(DISTINCT CASE WHEN l_partkey % 7 > 0 THEN 'h' || l_partkey // 3 END) FROM lineitem) AS documents, count(*) AS pages, sum(geometry)::BIGINT AS geometry, sum(levels)::BIGINT AS levels, sum(materials)::BIGINT AS materials, (SELECT count(*) FROM (SELECT DISTINCT h, page FROM p WHERE geometry < 5)) AS fallback_pages FROM f WHERE rn = 1""")
def merged_bundles(spark, sf):
    k = F.col("l_partkey")
    h = F.concat(F.lit("h"), F.floor(k / 3))
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3).alias("bundle"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), h.alias("content_hash"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("bigint").alias("geometry"), (F.col("l_suppkey") % 5).alias("levels"), (k % 4).alias("materials"))
    d = table(spark, sf, "lineitem").select(F.when(k % 7 > 0, h).alias("content_hash"))
    return D.merge_bundles(p, d, p.where("geometry < 5").select("content_hash", "page"), ["geometry", "levels", "materials"])


# ---------------------------------------------------------------- drawings

_WRITTEN = ["S1", "Gravel", "S-2", "Red tarmac surfacing", "FFL 12.50", "PV10", "Paving slabs", "Timber bench", "S1", "Scale 1:200", "S-2", "plain words"]
_FILLS = ["fill:8,8,8", "fill:200,0,0", None, "fill:0,0,200", None]


def _drawings(spark, sf):
    """Texts and paths of pages of forty parts: codes stand before their labels, each page has a few swatches and hatched shapes."""
    k = F.col("p_partkey")
    page = F.floor(k / 40).alias("page")
    x, z = (k * 37 % 560).cast("double"), (F.floor(k / 2) * 53 % 390).cast("double")
    parts = table(spark, sf, "part")
    texts = parts.select(page, k.alias("item"), _pick(_WRITTEN, k % 12).alias("text"), (F.floor(k / 2) * 37 % 560 + k % 2 * 30).cast("double").alias("x"), z.alias("y"), F.lit(8.0).alias("size"), F.lit(20.0).alias("width"))
    wide = F.when(k % 3 == 0, 12.0).when(k % 3 == 1, 60.0).otherwise(150.0)
    shape = parts.select(page, (k * 10).alias("path"), F.lit(True).alias("closed"), (k % 3 > 0).alias("meaningful"), _pick(_FILLS, k % 5).alias("fill_key"), F.lit(None).cast("string").alias("hatch_key"), x.alias("min_x"), z.alias("min_z"), (x + wide).alias("max_x"), (z + wide).alias("max_z"))
    step = F.explode(F.sequence(F.lit(1), F.lit(5)))
    stroke = parts.select(page, k, x.alias("x"), z.alias("z"), step.alias("i")).select("page", (k * 10 + F.col("i")).alias("path"), F.lit(False).alias("closed"), F.lit(False).alias("meaningful"), F.lit(None).cast("string").alias("fill_key"), F.concat(F.lit("hatch:a"), k % 4 * 45).alias("hatch_key"), (F.col("x") + F.col("i")).alias("min_x"), (F.col("z") + F.col("i")).alias("min_z"), (F.col("x") + F.col("i") + 4).alias("max_x"), (F.col("z") + F.col("i") + 4).alias("max_z"))
    return texts, shape.unionByName(stroke)


@query()
def legend_materials(spark, sf):
    texts, paths = _drawings(spark, sf)
    named = {"Gravel": "gravel", "Red tarmac surfacing": "red_tarmac", "Paving slabs": "paving_stones"}
    material = F.coalesce(*[F.when(F.col("text") == t, m) for t, m in named.items()])
    labels = texts.withColumn("material", material).where("material is not null").select("page", F.col("item").alias("label"), "material", F.lit("surface").alias("role"), F.lit(0.9).alias("confidence"), "x", "y", F.array("item").alias("items"))
    t = texts.drop("width")
    return N.legend_observations(N.legend_entries(labels, t, paths), t, paths)


@query()
def drawing_evidence(spark, sf):
    texts, paths = _drawings(spark, sf)
    k = F.col("p_partkey")
    pages = table(spark, sf, "part").groupBy(F.floor(k / 40).alias("page")).agg(F.min(k).alias("k"))
    pages = pages.select("page", _pick(["unknown", "site-plan", "landscape", "elevation"], F.col("page") % 4).alias("class"), F.when(F.col("page") % 3 == 0, "Proposed site plan").alias("title"), (F.col("page") % 2).alias("images"))
    return extract(pages, texts, paths)[1]
