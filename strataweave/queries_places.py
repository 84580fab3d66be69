"""More registered queries: joins in space, labels and templates, growth, masks and lines, gates and choices. Each beside the SQL that must agree, where SQL can say it.

As in ``queries``, positions and labels follow from keys, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.core.session import table
from strataweave.functions import geometry as G
from strataweave.functions import ladders as L
from strataweave.functions import scalars as S
from strataweave.operators import details as D
from strataweave.operators import fusion as U
from strataweave.operators import lines as N
from strataweave.operators import raster as R
from strataweave.operators import reconcile as C
from strataweave.operators import vector as V
from strataweave.queries import _BOX, _boxes, _match_sql, query
from strataweave.queries_rules import _HAVE, _KINDS, _pick, _sql_pick
from strataweave.sources import web as W


def _at(spark, sf, name, key, a, b, mod=499, mod2=491, more=()):
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), (k * a % mod).cast("double").alias("x"), (k * b % mod2).cast("double").alias("z"), *more)


def _at_sql(name, key, a, b, mod=499, mod2=491, more=""):
    return f"SELECT {key} AS id, ({key} * {a} % {mod})::DOUBLE AS x, ({key} * {b} % {mod2})::DOUBLE AS z{more} FROM {name}"


# ---------------------------------------------------------------- targets and neighbours

@query(f"""WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 400 * 3 + 1 END AS target, {_sql_pick(_HAVE, 'p_partkey % 7')} AS kind FROM part), f AS (SELECT s_suppkey * 3 + 1 AS id, {_sql_pick(_HAVE, 's_suppkey % 7')} AS kind FROM supplier)
SELECT CASE WHEN target IS NULL THEN 'search' WHEN f.id IS NULL THEN 'certified-target-missing' WHEN f.kind != c.kind THEN 'certified-target-incompatible' ELSE 'accepted' END AS status, count(*) AS n, sum(k)::BIGINT AS ids FROM c LEFT JOIN f ON f.id = target GROUP BY 1""")
def certified_targets(spark, sf):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    c = table(spark, sf, "part").select(k.alias("candidate_id"), F.when(k % 3 > 0, k % 400 * 3 + 1).alias("target"), _pick(_HAVE, k % 7).alias("kind"))
    f = table(spark, sf, "supplier").select((s * 3 + 1).alias("id"), _pick(_HAVE, s % 7).alias("kind"))
    return C.certified_target(c, f).groupBy("status").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))


@query(f"""WITH s AS ({_at_sql('customer', 'c_custkey', 53, 29, more=", CASE WHEN c_custkey % 10 = 0 THEN 'r' || c_custkey % 2000 END AS ref, CASE WHEN c_custkey % 7 = 0 THEN 'RIDE ' || c_custkey % 1300 END AS name")}), r AS ({_at_sql('supplier', 's_suppkey', 17, 71, more=", 'r' || s_suppkey AS ride_id, 'Ride ' || s_suppkey % 90 AS name")}),
o AS (SELECT lower(name) AS n, min(ride_id) AS named FROM r GROUP BY 1 HAVING count(*) = 1), d AS (SELECT s.id, r.ride_id, sqrt(pow(s.x - r.x, 2) + pow(s.z - r.z, 2)) AS d FROM s, r WHERE sqrt(pow(s.x - r.x, 2) + pow(s.z - r.z, 2)) <= 28),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ride_id) AS rn, lead(d) OVER (PARTITION BY id ORDER BY d, ride_id) AS second FROM d), b AS (SELECT id, ride_id AS near, CASE WHEN second IS NOT NULL AND second - d < 4 THEN 'ambiguous' ELSE 'accepted' END AS st FROM k WHERE rn = 1)
SELECT s.id, coalesce(e.ride_id, named, CASE WHEN st = 'accepted' THEN near END) AS ride_id, CASE WHEN e.ride_id IS NOT NULL THEN 'explicit' WHEN named IS NOT NULL THEN 'name' WHEN st = 'accepted' THEN 'nearest' WHEN st IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS method FROM s LEFT JOIN r e ON e.ride_id = s.ref LEFT JOIN o ON o.n = lower(s.name) LEFT JOIN b ON b.id = s.id""")
def structure_rides(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    st = _at(spark, sf, "customer", "c_custkey", 53, 29, more=(F.when(k % 10 == 0, F.concat(F.lit("r"), k % 2000)).alias("ride_ref"), F.when(k % 7 == 0, F.concat(F.lit("RIDE "), k % 1300)).alias("name")))
    r = _at(spark, sf, "supplier", "s_suppkey", 17, 71, more=(F.concat(F.lit("r"), s).alias("ride_id"), F.concat(F.lit("Ride "), s % 90).alias("name")))
    return C.structure_ride(st, r.drop("id"))


@query(f"""WITH p AS (SELECT c_custkey AS id, c_custkey * 53 % 499 + 0.5 AS x, c_custkey * 29 % 491 + 0.5 AS z FROM customer), a AS (SELECT {_BOX.format(k='s_suppkey').replace('997', '499').replace('991', '491')} FROM supplier)
SELECT a.id AS area, count(p.id) AS n, coalesce(sum(p.id), 0)::BIGINT AS children FROM a LEFT JOIN p ON p.x > a.min_x AND p.x < a.max_x AND p.z > a.min_z AND p.z < a.max_z GROUP BY 1""")
def area_children(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("bay"), (k * 53 % 499 + 0.5).alias("x"), (k * 29 % 491 + 0.5).alias("z"))
    a = _boxes(table(spark, sf, "supplier"), "s_suppkey", F.lit("area"), 499, 491).withColumnRenamed("id", "area")
    at = lambda x, z: F.struct(F.col(x).alias("x"), F.col(z).alias("z"))
    a = a.withColumn("ring", F.array(at("min_x", "min_z"), at("max_x", "min_z"), at("max_x", "max_z"), at("min_x", "max_z")))
    return C.children_of(p, a, "bay", "area").select("area", F.col("n").cast("bigint").alias("n"), F.aggregate(F.coalesce("children", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("children"))


@query(f"""WITH s AS ({_at_sql('supplier', 's_suppkey', 17, 71)}), c AS ({_at_sql('customer', 'c_custkey', 53, 29)}) SELECT s.id, count(*) AS n, sum(c.id)::BIGINT AS ids FROM s JOIN c ON pow(s.x - c.x, 2) + pow(s.z - c.z, 2) <= 100 GROUP BY 1""")
def cloud_radius(spark, sf):
    p = C.point_radius(_at(spark, sf, "supplier", "s_suppkey", 17, 71), _at(spark, sf, "customer", "c_custkey", 53, 29), 10.0)
    return p.groupBy(F.col("s.id").alias("id")).agg(F.count("*").alias("n"), F.sum("c.id").alias("ids"))


_WATER = "CASE WHEN {k} % 3 = 0 THEN NULL ELSE 'Lake ' || {k} % 2 END AS name"


@query(f"""WITH m AS (SELECT {_BOX.format(k='p_partkey').replace('997', '199').replace('991', '197')}, {_WATER.format(k='p_partkey')} FROM part), o AS (SELECT {_BOX.format(k='(s_suppkey * 3 + 1)').replace('997', '199').replace('991', '197')}, {_WATER.format(k='(s_suppkey * 3 + 1)')} FROM supplier),
p AS (SELECT m.id, greatest(0, least(m.max_x, o.max_x) - greatest(m.min_x, o.min_x)) * greatest(0, least(m.max_z, o.max_z) - greatest(m.min_z, o.min_z)) AS i, (m.max_x - m.min_x) * (m.max_z - m.min_z) AS a, (o.max_x - o.min_x) * (o.max_z - o.min_z) AS b FROM m, o WHERE m.min_x <= o.max_x AND m.max_x >= o.min_x AND m.min_z <= o.max_z AND m.max_z >= o.min_z AND (m.name IS NULL OR o.name IS NULL OR m.name = o.name))
SELECT DISTINCT id FROM p WHERE i / (a + b - i) >= 0.62""")
def suppressed_water(spark, sf):
    name = lambda k: F.when(k % 3 != 0, F.concat(F.lit("Lake "), k % 2)).alias("name")
    m = _boxes(table(spark, sf, "part"), "p_partkey", F.lit("area"), 199, 197).select("*", name(F.col("id")))
    o = _boxes(table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("k")), "k", F.lit("area"), 199, 197).select("*", name(F.col("id")))
    return D.suppress_water(m, o).select("id")


@query("""WITH s AS (SELECT l_suppkey AS k, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 1 THEN (l_suppkey % 30)::DOUBLE END AS tag, l_quantity / (1 + l_suppkey % 20) AS shore FROM lineitem), g AS (SELECT k, max(tag) AS t, median(shore) AS m, quantile_cont(shore, 0.9) - quantile_cont(shore, 0.1) AS spread FROM s GROUP BY 1)
SELECT k, round(coalesce(t, CASE WHEN spread <= 4 THEN m END), 9) AS level, CASE WHEN t IS NOT NULL THEN 'tag' WHEN spread <= 4 THEN 'shoreline' ELSE 'unknown' END AS source FROM g""")
def water_levels(spark, sf):
    k = F.col("l_suppkey")
    s = table(spark, sf, "lineitem").select(k.alias("k"), F.when((k % 5 == 0) & (F.col("l_linenumber") == 1), (k % 30).cast("double")).alias("tag_level"), (F.col("l_quantity") / (1 + k % 20)).alias("shore"))
    return D.water_level(s, "k", 4).select("k", F.round("level", 9).alias("level"), "source")


@query(f"""WITH t AS (SELECT {_BOX.format(k='p_partkey')}, p_partkey % 5 AS page FROM part), l AS ({_at_sql('supplier', 's_suppkey', 37, 91, 997, 991, more=", s_suppkey % 5 AS page, 'label ' || s_suppkey % 3 AS label")}), p AS (SELECT t.id, label FROM t JOIN l ON l.page = t.page AND l.x BETWEEN t.min_x - 12 AND t.max_x + 12 AND l.z BETWEEN t.min_z - 12 AND t.max_z + 12), g AS (SELECT id, count(DISTINCT label) AS n, min(label) AS label FROM p GROUP BY 1)
SELECT t.id, CASE WHEN n = 1 THEN label END AS label, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'labelled' ELSE 'ambiguous' END AS status FROM t LEFT JOIN g USING (id)""")
def nearby_labels(spark, sf):
    t = _boxes(table(spark, sf, "part"), "p_partkey", F.lit("area")).withColumn("page", F.col("id") % 5)
    s = F.col("s_suppkey")
    return D.nearest_label(t, _at(spark, sf, "supplier", "s_suppkey", 37, 91, 997, 991, more=((s % 5).alias("page"), F.concat(F.lit("label "), s % 3).alias("label"))).drop("id"), "id", 12.0)


@query(f"""WITH d AS ({_at_sql('customer', 'c_custkey', 53, 29, more=', c_custkey % 7 AS rank')}), w AS (SELECT s_suppkey % 40 AS building, (s_suppkey * 17 % 499)::DOUBLE AS ax, (s_suppkey * 71 % 491)::DOUBLE AS z, (s_suppkey * 17 % 499)::DOUBLE + 9 AS bx FROM supplier),
p AS (SELECT d.id, d.rank, building, sqrt(pow(greatest(ax - x, 0, x - bx), 2) + pow(d.z - w.z, 2)) AS dist FROM d, w WHERE d.z BETWEEN w.z - 8 AND w.z + 8 AND d.x BETWEEN ax - 8 AND bx + 8), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, building) AS rn FROM p WHERE dist <= 8)
SELECT building, id AS entrance FROM (SELECT *, row_number() OVER (PARTITION BY building ORDER BY rank DESC, dist, id) AS k FROM n WHERE rn = 1) WHERE k = 1""")
def building_entrances(spark, sf):
    s = F.col("s_suppkey")
    ax, z = (s * 17 % 499).cast("double"), (s * 71 % 491).cast("double")
    w = table(spark, sf, "supplier").select((s % 40).alias("building"), ax.alias("ax"), z.alias("az"), (ax + 9).alias("bx"), z.alias("bz"))
    return D.entrances(_at(spark, sf, "customer", "c_custkey", 53, 29, more=((F.col("c_custkey") % 7).alias("rank"),)), w)


@query("""WITH t AS (SELECT 'T' || s_suppkey % 80 AS code, count(*) AS n, min(s_suppkey) AS t FROM supplier GROUP BY 1) SELECT p_partkey AS k, CASE WHEN n = 1 THEN t END AS template_id, CASE WHEN n IS NULL THEN 'no-template' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM part LEFT JOIN t ON code = 'T' || p_partkey % 120""")
def support_templates(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("T"), F.col("p_partkey") % 120).alias("code"))
    t = table(spark, sf, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey") % 80).alias("code"), F.col("s_suppkey").alias("template_id"))
    return D.unique_template(p, t, "code").select("k", "template_id", "status")


@query("""WITH s AS (SELECT p_partkey % 20 AS line, (p_partkey * 7 % 200)::DOUBLE AS x, (p_partkey * 3 % 40)::DOUBLE AS z FROM part), g AS (SELECT s_suppkey % 20 AS line, (s_suppkey * 11 % 200)::DOUBLE AS ax, (s_suppkey % 40)::DOUBLE AS az, (s_suppkey * 11 % 200)::DOUBLE + 9 AS bx FROM supplier),
d AS (SELECT s.line, s.x, s.z, min(sqrt(pow(greatest(ax - x, 0, x - bx), 2) + pow(z - az, 2))) AS d FROM (SELECT DISTINCT * FROM s) s JOIN g USING (line) GROUP BY ALL), j AS (SELECT s.line, least(coalesce(d, 50), 50) AS d FROM s LEFT JOIN d USING (line, x, z))
SELECT line, round(avg(d), 9) AS mean, round(max(d), 9) AS largest, CASE WHEN max(d) <= 1 THEN 'aligned' WHEN max(d) <= 3 THEN 'close' ELSE 'review-required' END AS status FROM j GROUP BY 1""")
def line_alignment(spark, sf):
    k, n = F.col("p_partkey"), F.col("s_suppkey")
    s = table(spark, sf, "part").select((k % 20).alias("line"), (k * 7 % 200).cast("double").alias("x"), (k * 3 % 40).cast("double").alias("z"))
    ax, az = (n * 11 % 200).cast("double"), (n % 40).cast("double")
    g = table(spark, sf, "supplier").select((n % 20).alias("line"), ax.alias("ax"), az.alias("az"), (ax + 9).alias("bx"), az.alias("bz"))
    return D.alignment(s, g, "line").select("line", F.round("mean", 9).alias("mean"), F.round("largest", 9).alias("largest"), "status")


@query(_match_sql(0.78, 0.08, (0.43, 0.29, 0.18, 0.10), 0.55))
def corroborated_match(spark, sf):
    fam = lambda k: F.when(k % 3 == 0, "line").otherwise("area")
    left = _boxes(table(spark, sf, "part"), "p_partkey", fam(F.col("p_partkey"))).withColumnRenamed("id", "l_id")
    sup = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("k"))
    m = D.corroborate(left, _boxes(sup, "k", fam(F.col("k"))).withColumnRenamed("id", "r_id"), "l_id", "r_id", 16.0)
    return m.where("score >= 0.35").groupBy("status").agg(F.count("*").alias("n"), F.sum("r_id").alias("targets"), F.round(F.sum("score"), 6).alias("total"))


# ---------------------------------------------------------------- records and choices

@query("""WITH r AS (SELECT p_brand || '/' || p_size AS k, p_partkey % 5 AS rev, p_type AS v FROM part), t AS (SELECT k, max(rev) AS rev FROM r GROUP BY 1) SELECT k, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value, CASE WHEN count(DISTINCT v) = 1 THEN 'latest' ELSE 'conflict' END AS status FROM r JOIN t USING (k, rev) GROUP BY 1""")
def latest_records(spark, sf):
    r = table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), "p_size").alias("k"), (F.col("p_partkey") % 5).alias("rev"), F.col("p_type").alias("v"))
    return D.agreeing_latest(r, "k", "rev", "v")


@query("""SELECT l_partkey AS page, min(l_orderkey * 10 + l_linenumber) AS seen, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem GROUP BY 1""")
def first_pages(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return D.first_seen(l, ["page"], "seen")


@query("""SELECT p_brand AS k, p_size % 4 AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand)::DOUBLE, 9) AS share FROM part p GROUP BY 1, 2""")
def land_cover_shares(spark, sf):
    return D.land_cover(table(spark, sf, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") % 4).alias("class")), "k").select("k", "class", "n", F.round("share", 9).alias("share"))


@query("""WITH s AS (SELECT count(*) AS features, count(*) FILTER (p_size % 2 = 0) AS access, count(*) FILTER (p_size = 1) AS buildings, sum(p_size) AS route_m, sum(CASE WHEN p_partkey % 100 = 0 THEN 1 END) AS ride_m, count(*) FILTER (p_size > 20) / (count(*) * 0.6) AS chunk_ratio FROM part)
SELECT g AS gate, coalesce(CASE g WHEN 'features' THEN features >= 100 WHEN 'access' THEN access >= 20 WHEN 'buildings' THEN buildings >= 10 WHEN 'route' THEN route_m >= 1000 WHEN 'rides' THEN ride_m >= 100 ELSE chunk_ratio BETWEEN 0.9 AND 1.35 END, false) AS pass FROM s, (VALUES ('features'), ('access'), ('buildings'), ('route'), ('rides'), ('chunks')) t(g)""")
def acceptance_gates(spark, sf):
    s = F.col("p_size")
    return C.acceptance(table(spark, sf, "part").agg(F.count("*").alias("features"), F.count_if(s % 2 == 0).alias("access"), F.count_if(s == 1).alias("buildings"), F.sum(s).alias("route_m"), F.sum(F.when(F.col("p_partkey") % 100 == 0, 1)).alias("ride_m"), (F.count_if(s > 20) / (F.count("*") * 0.6)).alias("chunk_ratio")))


@query("""SELECT p_brand || '/' || p_size % 20 AS k, count(*) FILTER (p_partkey % 40 IN (1, 2)) = 0 AS exact_3d FROM part GROUP BY 1""")
def exact_models(spark, sf):
    k = F.col("p_partkey") % 40
    code = F.when(k == 1, "RIDE_VERTICAL_GEOMETRY_PARTIAL").when(k == 2, "TERRAIN_FLAT_DATUM").when(k == 3, "SOME_OTHER_CODE")
    return table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size") % 20).alias("k"), code.alias("code")).groupBy("k").agg(C.exact_3d().alias("exact_3d"))


@query("""SELECT p_partkey % 97 AS x, p_partkey * 7 % 89 AS z, p_size % 5 AS priority FROM part ORDER BY priority, pow(x - 40, 2) + pow(z - 30, 2), x, z LIMIT 1""")
def spawn_point(spark, sf):
    k = F.col("p_partkey")
    return C.spawn_cell(table(spark, sf, "part").select((k % 97).alias("x"), (k * 7 % 89).alias("z"), (F.col("p_size") % 5).alias("priority")), 40, 30)


@query("""WITH a AS (SELECT p_brand AS k, list_sort(list(p_partkey)) AS p FROM part GROUP BY 1), i AS (SELECT k, p, CASE WHEN len(p) <= 12 THEN unnest(p) END AS v FROM a WHERE len(p) <= 12 UNION ALL SELECT k, p, p[floor(unnest(range(12)) * (len(p) - 1) / 11.0 + 0.5)::BIGINT + 1] FROM a WHERE len(p) > 12) SELECT k, count(*) AS n, sum(v)::BIGINT AS total FROM i GROUP BY 1""")
def spread_samples(spark, sf):
    a = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k")).agg(F.array_sort(F.collect_list("p_partkey")).alias("p")).select("k", C.stratified(F.col("p"), 12).alias("p"))
    return a.select("k", F.size("p").cast("bigint").alias("n"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 101 = 0 AS seed, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS cut FROM orders WHERE true), g AS (SELECT *, sum(cut) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM s), k AS (SELECT DISTINCT run FROM g WHERE seed) SELECT id, seed FROM g JOIN k USING (run)""")
def grown_strokes(spark, sf):
    """Strokes end to end, broken every thirteenth and fiftieth; from the seeds along unbroken runs of one style."""
    k = F.col("o_orderkey")
    gap = F.when(k % 13 == 0, 2.0).otherwise(0.0)
    s = table(spark, sf, "orders").select(k.alias("id"), F.floor(k / 50).alias("style"), (k % 101 == 0).alias("seed"), (k * 4.0 + gap).alias("ax"), F.lit(0.0).alias("az"), (k * 4.0 + 4).alias("bx"), F.lit(0.0).alias("bz"))
    return D.grow(s)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), a AS (SELECT k, s, 1 AS layer FROM o WHERE k % 2 = 0), b AS (SELECT k, s, 2 AS layer FROM o WHERE k % 3 = 0 AND k NOT IN (SELECT k FROM a)), c AS (SELECT k, s, 3 AS layer FROM o WHERE k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b))
SELECT layer, s AS status, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2""")
def layered_sources(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    u = U.union_by_precedence(*[o.where(w).withColumn("layer", F.lit(n)) for n, w in ((1, "k % 2 = 0"), (2, "k % 3 = 0"), (3, "true"))], key="k")
    return u.groupBy("layer", "status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- gates and ladders

_SEM = ["building-footprint-or-room", "landscape-area-or-path", "landscape-edge-or-route", "site-edge-or-route", "ride-envelope-or-structure", "ride-centerline-or-edge", "other"]


@query(f"""WITH c AS (SELECT {_sql_pick(_SEM, 'p_partkey % 7')} AS s, CASE WHEN p_partkey % 2 = 0 THEN 'ride_layout' ELSE 'site_plan' END AS c, {_sql_pick(_KINDS, 'p_partkey // 7 % 7')} AS k, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 > 1 END AS auth, CASE WHEN p_partkey % 3 = 0 THEN 'proposed' ELSE 'current' END AS state FROM part)
SELECT s AS semantic, k AS kind, CASE WHEN k = 'ride_track' THEN c = 'ride_layout' AND s = 'ride-centerline-or-edge' WHEN s = 'ride-centerline-or-edge' THEN false WHEN s = 'ride-envelope-or-structure' THEN c = 'ride_layout' AND k = 'structure' WHEN s = 'building-footprint-or-room' THEN k IN ('building', 'structure') WHEN s = 'landscape-area-or-path' THEN k IN ('path', 'road', 'water', 'terrain_detail') WHEN s IN ('landscape-edge-or-route', 'site-edge-or-route') THEN k IN ('path', 'road', 'barrier') ELSE false END AS fits, coalesce(auth AND state = 'current', false) AS current, count(*) AS n FROM c GROUP BY ALL""")
def authority_gates(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(_pick(_SEM, k % 7).alias("semantic"), F.when(k % 2 == 0, "Ride Layout").otherwise("site plan").alias("c"), _pick(_KINDS, F.floor(k / 7) % 7).alias("kind"), F.when(k % 5 > 0, k % 5 > 1).alias("auth"), F.when(k % 3 == 0, "proposed").otherwise("current").alias("state"))
    return c.groupBy("semantic", "kind", D.semantic_fits(F.col("semantic"), F.col("c"), F.col("kind")).alias("fits"), D.current_authority(F.col("auth"), F.col("state")).alias("current")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'site_plan' WHEN 1 THEN 'elevation' ELSE 'decision' END AS c, p_size * 5 AS chars, p_partkey % 4 AS vectors, p_partkey % 6 AS meaning, p_partkey % 5 AS images FROM part)
SELECT CASE WHEN images > 0 AND meaning < 4 AND chars < 120 THEN 'image-dominant-page-with-insufficient-vector-evidence' WHEN vectors = 0 AND chars < 30 THEN 'no-usable-vector-or-text-evidence' WHEN c != 'decision' AND meaning = 0 THEN 'drawing-class-without-meaningful-vector-geometry' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def raster_fallbacks(spark, sf):
    k = F.col("p_partkey")
    c = F.when(k % 3 == 0, "site_plan").when(k % 3 == 1, "elevation").otherwise("decision")
    return table(spark, sf, "part").groupBy(W.raster_fallback(c, F.col("p_size") * 5, k % 4, k % 6, k % 5).alias("reason")).agg(F.count("*").alias("n"))


_TAGS = ["theme_park", "track", "support", "station", "attraction", "hedge", "rock", "footway", "road", "water", "rail", "fence", "grass", "pier", "cafe", "door", "museum", "none"]
_TAG_KEY = ["tourism", "roller_coaster", "roller_coaster", "roller_coaster", "attraction", "barrier", "natural", "highway", "highway", "natural", "railway", "barrier", "landuse", "man_made", "amenity", "entrance", "tourism", "note"]
_TAG_KIND = ["park_boundary", "ride_track", "ride_support", "building", "attraction", "vegetation", "terrain_detail", "path", "road", "water", "rail", "barrier", "surface", "structure", "amenity", "detail", "amenity", None]


@query(f"""SELECT {_sql_pick(_TAG_KIND, 'p_partkey % 18')} AS kind, count(*) AS n FROM part GROUP BY 1""")
def map_kinds(spark, sf):
    i = F.col("p_partkey") % len(_TAGS)
    return table(spark, sf, "part").groupBy(L.feature_kind(F.create_map(_pick(_TAG_KEY, i), _pick(_TAGS, i))).alias("kind")).agg(F.count("*").alias("n"))


_CODES = ["P-12a", "p 7", "AB.3", "TREE", "x_009", "12", None]


@query(f"""WITH c AS (SELECT p_partkey AS k, {_sql_pick(_CODES, 'p_partkey % 7')} AS code, [p_partkey * 7 % 256, p_partkey * 13 % 256, 250 + p_partkey % 6] AS rgb FROM part), q AS (SELECT *, [floor(v / 4.0 + 0.5)::BIGINT * 4 FOR v IN rgb] AS s FROM c)
SELECT k, CASE WHEN regexp_matches(upper(code), '^[A-Z]{{1,3}}\\s*[-_.]?\\s*\\d{{1,3}}[A-Z]?$') THEN regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') END AS legend, CASE WHEN NOT (s[1] >= 248 AND s[2] >= 248 AND s[3] >= 248) THEN 'fill:' || s[1] || ',' || s[2] || ',' || s[3] END AS fill FROM q""")
def legend_keys(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), D.legend_code(_pick(_CODES, k % 7)).alias("legend"), C.fill_style(F.array(k * 7 % 256, k * 13 % 256, 250 + k % 6)).alias("fill"))


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey % 101) / 100.0::DOUBLE AS c, (p_partkey % 7) / 6.0::DOUBLE AS m, (p_partkey % 11) / 10.0::DOUBLE AS y, (p_partkey % 3) / 4.0::DOUBLE AS b FROM part) SELECT k, floor(255 * (1 - c) * (1 - b) + 0.5)::DOUBLE AS r, floor(255 * (1 - m) * (1 - b) + 0.5)::DOUBLE AS g, floor(255 * (1 - y) * (1 - b) + 0.5)::DOUBLE AS b FROM p""")
def printed_colours(spark, sf):
    k = F.col("p_partkey")
    c = S.cmyk_to_rgb(k % 101 / 100.0, k % 7 / 6.0, k % 11 / 10.0, k % 3 / 4.0)
    return table(spark, sf, "part").select(k.alias("k"), c.alias("c")).select("k", *[F.col("c")[i].cast("double").alias(n) for i, n in enumerate("rgb")])


@query("""WITH a AS (SELECT p_partkey AS k, (p_partkey * 37 % 256) || '.' || (p_partkey * 11 % 256) || '.' || (p_partkey % 256) || '.7' AS ip FROM part), p AS (SELECT *, string_split(ip, '.')[1]::INT AS x, string_split(ip, '.')[2]::INT AS y, string_split(ip, '.')[3]::INT AS z FROM a),
o AS (SELECT *, NOT (x IN (0, 10, 127) OR x >= 224 OR (x = 169 AND y = 254) OR (x = 192 AND y = 168) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 192 AND y = 0 AND z IN (0, 2)) OR (x = 198 AND y IN (18, 19)) OR (x = 198 AND y = 51 AND z = 100) OR (x = 203 AND y = 0 AND z = 113)) AS ok FROM p)
SELECT k, ok AS public, CASE k % 4 WHEN 0 THEN ok WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS safe FROM o""")
def safe_addresses(spark, sf):
    k = F.col("p_partkey")
    ip = F.concat_ws(".", k * 37 % 256, k * 11 % 256, k % 256, F.lit("7"))
    url = F.when(k % 4 == 0, F.concat(F.lit("http://"), ip, F.lit("/x"))).when(k % 4 == 1, "https://user:pw@example.org/").when(k % 4 == 2, F.concat(F.lit("https://example.org/?q="), k)).otherwise("ftp://example.org/")
    return table(spark, sf, "part").select(k.alias("k"), S.is_public_ipv4(ip).alias("public"), S.is_safe_url(url).alias("safe"))


@query("""SELECT p_partkey AS k, floor(greatest(0, least(1, 0.08 + 0.25 * ((p_partkey % 11) / 10.0) + 0.2 * greatest(0, least(1, 1 - ((p_partkey % 9) / 10.0 - 0.1) / 0.9)) + 0.22 * greatest(0, least(1, (p_partkey % 40) / 30.0)) + 0.15 * greatest(0, least(1, 1 - (p_partkey % 13) / 10.0)) + 0.1 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END))::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM part""")
def measured_widths(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), D.cross_section_confidence(k % 11 / 10.0, k % 9 / 10.0, k % 40 / 1.0, k % 13 / 10.0, k % 2 == 0).alias("confidence"))


# ---------------------------------------------------------------- cells, masks and lines

_GRID = "SELECT o_orderkey % 40 AS x, o_orderkey // 40 % 40 AS z, max(o_totalprice) AS value FROM orders GROUP BY ALL"


def _grid(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("x"), (F.floor(F.col("o_orderkey") / 40) % 40).alias("z")).agg(F.max("o_totalprice").alias("value"))


@query(f"""WITH c AS ({_GRID}), a AS (SELECT c.x, c.z, any_value(c.value) + greatest(-5000, least(5000, median(d.value) - any_value(c.value))) AS value FROM c JOIN c d ON abs(c.x - d.x) <= 1 AND abs(c.z - d.z) <= 1 GROUP BY 1, 2), b AS (SELECT a.x, a.z, any_value(a.value) + greatest(-5000, least(5000, median(d.value) - any_value(a.value))) AS value FROM a JOIN a d ON abs(a.x - d.x) <= 1 AND abs(a.z - d.z) <= 1 GROUP BY 1, 2) SELECT x, z, round(value, 4) AS value FROM b""")
def conformed_grid(spark, sf):
    return R.median_conform(_grid(spark, sf), [], 5000.0).select("x", "z", F.round("value", 4).alias("value"))


@query(f"""WITH f AS ({_GRID}), c AS (SELECT DISTINCT c_custkey * 37 % 21 AS x, c_custkey * 53 % 19 AS z FROM customer), s AS (SELECT c.x, c.z, value FROM c, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), f WHERE f.x = 2 * c.x + i AND f.z = 2 * c.z + j) SELECT c.x, c.z, median(value) AS value, count(value) AS n FROM c LEFT JOIN s USING (x, z) GROUP BY 1, 2""")
def sub_cell_medians(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 37 % 21).alias("x"), (F.col("c_custkey") * 53 % 19).alias("z")).distinct()
    return V.sub_cell_median(c, _grid(spark, sf).withColumnsRenamed({"x": "gx", "z": "gz"}), 0.5)


@query("""WITH m AS (SELECT DISTINCT p_partkey * 7 % 151 AS x, p_partkey * 11 % 149 AS z FROM part WHERE true), d AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4) SELECT z, count(*) AS n, sum(x)::BIGINT AS sum_x FROM (SELECT DISTINCT m.x + i AS x, m.z + j AS z FROM m, d) GROUP BY 1""")
def dilated_mask(spark, sf):
    k = F.col("p_partkey")
    return V.dilate(table(spark, sf, "part").select((k * 7 % 151).alias("x"), (k * 11 % 149).alias("z")).distinct(), [], 2.0).groupBy("z").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey * 10 AS x, 10 AS y, s_suppkey % 7 AS z, 3 + s_suppkey % 5 AS h FROM supplier), r AS (SELECT *, unnest(range(1, h + 1)) AS k FROM t), s AS (SELECT *, floor(1 + (k - 1) * 2.0 / greatest(h - 1, 1) + 0.5)::INT - 1 AS src FROM r),
p(dx, dy, dz, block) AS (VALUES (0, 0, 0, 'log'), (0, 1, 0, 'log'), (1, 1, 0, 'leaves'), (0, 2, 0, 'leaves')) SELECT id, block, count(*) AS n, sum(s.x + dx)::BIGINT AS sum_x, sum(y + k)::BIGINT AS sum_y FROM s JOIN p ON dy = src GROUP BY 1, 2""")
def tree_blocks(spark, sf):
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(k.alias("id"), (k * 10).alias("x"), F.lit(10).alias("y"), (k % 7).alias("z"), (3 + k % 5).alias("height"))
    v = D.tree_voxels(t, [(0, 0, 0, "log"), (0, 1, 0, "log"), (1, 1, 0, "leaves"), (0, 2, 0, "leaves")])
    return v.groupBy("id", "block").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("""WITH e AS (SELECT user_id AS k, event_id, row_number() OVER w AS i, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT k, count(*) AS n, sum(4 * (event_id - before))::DOUBLE AS area FROM e WHERE before IS NOT NULL GROUP BY 1""")
def corridor_quads(spark, sf):
    e = F.col("event_id").cast("double")
    d = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", e.alias("lx"), F.lit(2.0).alias("lz"), e.alias("rx"), F.lit(-2.0).alias("rz"))
    return V.corridor(d, ["k"], "event_id").groupBy("k").agg(F.count("*").alias("n"), F.sum(G.ring_area("ring")).alias("area"))


@query(f"""SELECT id, (min_x + max_x) / 2 AS x, (min_z + max_z) / 2 AS z, (max_x - min_x) * (max_z - min_z) AS area, max_x - min_x AS wide, 2 * (max_x - min_x + max_z - min_z) AS round FROM (SELECT {_BOX.format(k='p_partkey')} FROM part)""")
def ring_measures(spark, sf):
    b = _boxes(table(spark, sf, "part"), "p_partkey", F.lit("area"))
    at = lambda x, z: F.struct(F.col(x).alias("x"), F.col(z).alias("z"))
    r = b.select("id", F.array(at("min_x", "min_z"), at("max_x", "min_z"), at("max_x", "max_z"), at("min_x", "max_z"), at("min_x", "min_z")).alias("r"))
    c, o = V.centroid(F.col("r")), G.bounds("r")
    return r.select("id", c["x"].alias("x"), c["z"].alias("z"), G.ring_area("r").alias("area"), (o["max_x"] - o["min_x"]).alias("wide"), G.line_length("r").alias("round"))


@query("""SELECT CASE WHEN p_partkey % 1000 / 1000.0 < 0.5 THEN 'a' WHEN p_partkey % 1000 / 1000.0 < 5 / 6.0 THEN 'b' ELSE 'c' END AS block, count(*) AS n FROM part GROUP BY 1""")
def weighted_blocks(spark, sf):
    return table(spark, sf, "part").groupBy(R.weighted_pick({"a": 3, "b": 2, "c": 1}, F.col("p_partkey") % 1000 / 1000.0).alias("block")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 17 AS a, p_partkey % 5 AS b, p_partkey % 11 AS c FROM part) SELECT id, greatest(abs(a - c), abs(b - a), abs(c - b), 1) + CASE WHEN a = b AND b = c THEN 0 ELSE 1 END AS voxels FROM p""")
def voxel_lines(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), *[(k % m).alias(n) for n, m in (("x1", 17), ("y1", 5), ("z1", 11), ("x2", 11), ("y2", 17), ("z2", 5))])
    return N.voxel_lines(p, "id", ["x1", "y1", "z1"], ["x2", "y2", "z2"]).groupBy("id").agg(F.count("*").alias("voxels"))


def _mask(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.col("p_brand").alias("k"), (k * 7 % 19).alias("x"), (k * 11 % 17).alias("z")).distinct()


@query("""WITH m AS (SELECT DISTINCT p_brand AS k, p_partkey * 7 % 19 AS x, p_partkey * 11 % 17 AS z FROM part), e AS (SELECT m.k FROM m, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(i, j) WHERE NOT EXISTS (SELECT 1 FROM m q WHERE q.k = m.k AND q.x = m.x + i AND q.z = m.z + j)) SELECT k, count(*)::DOUBLE AS length FROM e GROUP BY 1""")
def mask_outlines(spark, sf):
    o = N.outlines(_mask(spark, sf), "k")
    p = F.col("ring")
    step = F.zip_with(p, F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["z"] - b["z"]))
    return o.select("k", F.aggregate(step, F.lit(0.0), lambda s, v: s + v).alias("n")).groupBy("k").agg(F.sum("n").alias("length"))


@query()
def mask_distance(spark, sf):
    return N.chamfer_distance(_mask(spark, sf), "k")


@query()
def recovered_paths(spark, sf):
    """Two maps with a broad path and one that crosses it: every part paints a cell of each."""
    k = F.col("p_partkey")
    cell = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    two = F.array(cell(k % 100, F.floor(k / 100) % 2), cell(48 + k % 3, F.floor(k / 3) % 60))
    m = table(spark, sf, "part").select(F.explode(two).alias("c")).select(F.explode(F.array(F.lit("north"), F.lit("south"))).alias("k"), "c.x", "c.z")
    p = N.recovered_paths(m, "k")
    return p.groupBy("k").agg(F.count("*").alias("parts"), F.round(F.sum("length"), 6).alias("length"))


def _walks(spark, sf):
    k = F.col("s_suppkey")
    pts = [(0, 0), (17, 3), (23, 14), (11, 21), (4, 12)]
    line = F.array(*[F.struct((k * 40 + x).cast("double").alias("x"), (k % 11 * 30 + z).cast("double").alias("z")) for x, z in pts])
    return table(spark, sf, "supplier").select(k.alias("id"), line.alias("line"), (1.0 + k % 3).alias("a"), (2.0 + k % 5).alias("b"))


@query()
def line_samples(spark, sf):
    return N.resampled(_walks(spark, sf), "id", "line", 2.5).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.sum("z"), 6).alias("sum_z"))


@query()
def tapered_cells(spark, sf):
    return N.tapered(_walks(spark, sf), "id", "line", "a", "b").groupBy("id").agg(F.count("*").alias("n"))


@query()
def clipped_lines(spark, sf):
    c = N.clipped(N.simplified(_walks(spark, sf), "id", "line", 1.0), "id", "line", (100.0, 5.0, 2500.0, 200.0))
    return c.groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum(G.line_length("line")), 6).alias("length"))


@query()
def free_routes(spark, sf):
    k = F.col("s_suppkey")
    corner = lambda x, z: F.struct((k * 40 + 8 + x).cast("double").alias("x"), (k % 11 * 30 - 2 + z).cast("double").alias("z"))
    b = table(spark, sf, "supplier").select(k.alias("bid"), F.array(corner(0, 0), corner(4, 0), corner(4, 8), corner(0, 8)).alias("ring"), (k * 40 + 8.0).alias("min_x"), (k % 11 * 30 - 2.0).alias("min_z"), (k * 40 + 12.0).alias("max_x"), (k % 11 * 30 + 6.0).alias("max_z"))
    return N.free_routes(_walks(spark, sf), "id", "line", b).groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum(G.line_length("line")), 6).alias("length"))


@query()
def sign_places(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.floor(k / 6).alias("sign"), (k * 37 % 61).alias("x"), (k * 53 % 59).alias("z"), (k % 13).cast("double").alias("score"))
    return D.sign_cells(c, "sign")
