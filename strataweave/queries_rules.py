"""More registered queries: rules over words, tags and colours, change sets, and the small joins and placements. Each beside the SQL that must agree.

As in ``queries``, positions and labels follow from keys, the same in both engines. Constants in the SQL are written out again, not taken from the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.core.session import table
from strataweave.functions import appearance as A
from strataweave.functions import scalars as S
from strataweave.functions import vocabulary as V
from strataweave.operators import changes as H
from strataweave.operators import details as D
from strataweave.operators import fusion as U
from strataweave.operators import partitioning as K
from strataweave.operators import reconcile as C
from strataweave.queries import _BOX, _SCORE, _boxes, query


def _pick(names, key):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key + 1).cast("int"))


def _sql_pick(names, key):
    return "[" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + f"][{key} + 1]"


# ---------------------------------------------------------------- appearance

@query("""WITH c AS (SELECT (p_partkey * 7 % 256)::DOUBLE AS r, (p_partkey * 13 % 256)::DOUBLE AS g, (p_partkey * 29 % 256)::DOUBLE AS b, (p_partkey % 20)::DOUBLE AS t FROM part),
m AS (SELECT *, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 AS lum, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS sat, (g - (r + b) / 2) / 255 AS gi, (b - (r + g) / 2) / 255 AS bi, (r - b) / 255 AS warm, (least(r, g) - b) / 255 AS yg FROM c),
k AS (SELECT *, CASE WHEN lum < 0.045 THEN 1 WHEN bi > 0.1 AND b > 55 AND lum < 0.58 THEN 2 WHEN gi > 0.075 AND g > 48 AND (t >= 8 OR lum < 0.34 OR sat > 0.42) THEN 3 WHEN gi > 0.075 AND g > 48 AND lum > 0.42 THEN 4 WHEN gi > 0.075 AND g > 48 THEN 5
 WHEN r > g * 1.06::DOUBLE AND g > b * 1.04::DOUBLE AND warm > 0.08 AND lum BETWEEN 0.12 AND 0.62 THEN 6 WHEN yg > 0.08 AND warm > 0.04 AND lum > 0.24 AND g >= r * 0.84::DOUBLE THEN 7 WHEN sat < 0.2 AND t >= 8 AND lum BETWEEN 0.16 AND 0.72 THEN 8 WHEN warm > 0.03 AND sat < 0.28 AND lum > 0.62 THEN 9 WHEN sat < 0.2 AND lum > 0.08 AND lum < 0.84 THEN 10 ELSE 11 END AS c FROM m),
s AS (SELECT c, ['shadow', 'water-candidate', 'dense-tree-canopy', 'grass', 'vegetation', 'soil-mulch', 'dry-grass', 'rock-gravel', 'sand', 'neutral-hardscape-candidate', 'unclassified'][c] AS class,
 CASE c WHEN 1 THEN 0.88 WHEN 2 THEN 0.64 + bi * 1.6::DOUBLE WHEN 3 THEN 0.72 + gi * 1.45::DOUBLE + least(0.12, t / 120) WHEN 4 THEN 0.7 + gi * 1.35::DOUBLE WHEN 5 THEN 0.7 + gi * 1.35::DOUBLE WHEN 6 THEN 0.69 + least(0.14, warm * 0.7::DOUBLE) + least(0.08, t / 160) WHEN 7 THEN 0.67 + yg * 1.2::DOUBLE
 WHEN 8 THEN 0.66 + least(0.16, t / 100) WHEN 9 THEN 0.66 + least(0.16, lum * 0.16::DOUBLE) WHEN 10 THEN 0.68 - sat * 0.5::DOUBLE ELSE 0.35 END::DOUBLE AS conf FROM k)
SELECT class, c IN (3, 4, 5, 6, 7, 8, 9) AS eligible, count(*) AS n, round(sum(least(0.99, greatest(0, conf))), 1) AS confidence FROM s GROUP BY ALL""")
def aerial_classes(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(A.aerial_class(*[(k * m % 256).cast("double") for m in (7, 13, 29)], (k % 20).cast("double")).alias("a"))
    return c.groupBy(F.col("a.class").alias("class"), F.col("a.eligible").alias("eligible")).agg(F.count("*").alias("n"), F.round(F.sum("a.confidence"), 1).alias("confidence"))


@query("""WITH c AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'needleleaved' ELSE 'broadleaved' END AS leaf, CASE WHEN p_partkey % 2 = 0 THEN 'evergreen' END AS cycle, p_partkey % 5 = 0 AS unseen, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)
SELECT CASE WHEN leaf = 'needleleaved' THEN 'spruce,dark_oak' WHEN unseen AND cycle = 'evergreen' THEN 'dark_oak,oak' WHEN unseen THEN 'oak,birch' WHEN (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 < 0.24 OR g < 82 THEN 'dark_oak,spruce' WHEN g > 125 AND (r - b) / 255.0 > 0.08 THEN 'birch,azalea' WHEN g > 118 THEN 'oak,azalea' ELSE 'oak,dark_oak' END AS palette, count(*) AS n FROM c GROUP BY 1""")
def leaf_palettes(spark, sf):
    k = F.col("p_partkey")
    band = lambda m: F.when(k % 5 != 0, (k * m % 256).cast("double"))
    p = A.leaf_palette(band(7), band(13), band(29), F.when(k % 7 == 0, "needleleaved").otherwise("broadleaved"), F.when(k % 2 == 0, "evergreen"))
    return table(spark, sf, "part").groupBy(F.replace(F.array_join(p, ","), F.lit("_leaves"), F.lit("")).alias("palette")).agg(F.count("*").alias("n"))


_PATTERNS = ["solid", "checker", "herringbone", "running_bond", "grid", "slabs", "stripes", "mosaic", "mixed", "unknown"]


@query(f"""WITH c AS (SELECT {_sql_pick(_PATTERNS, 'c_custkey % 10')} AS pattern, c_custkey % 3 = 0 AS earthy, (c_custkey * 31 % 4000 - 2000) AS x, (c_custkey * 17 % 3000 - 1500) AS z FROM customer),
a AS (SELECT *, ((((x + 4294967296) % 4294967296)::HUGEINT * 374761393) % 4294967296)::BIGINT AS p, ((((z + 4294967296) % 4294967296)::HUGEINT * 668265263) % 4294967296)::BIGINT AS q FROM c),
b AS (SELECT *, xor(xor(p, q), ((5::HUGEINT * 1442695041) % 4294967296)::BIGINT) AS v FROM a), d AS (SELECT *, ((xor(v, v >> 13)::HUGEINT * 1274126177) % 4294967296)::BIGINT AS w FROM b),
h AS (SELECT *, xor(w, w >> 16) AS noise, ((x % 24) + 24) % 24 AS px, ((z % 24) + 24) % 24 AS pz FROM d)
SELECT pattern, CASE pattern WHEN 'solid' THEN 0 WHEN 'checker' THEN (px + pz) % 2 WHEN 'herringbone' THEN CASE WHEN (px + 2 * pz) % 7 = 0 THEN 2 WHEN (px + 2 * pz) % 4 = 0 OR (2 * px + pz) % 5 = 0 THEN 1 ELSE 0 END WHEN 'running_bond' THEN CASE WHEN (px + pz) % 11 = 0 THEN 2 WHEN (px + pz % 2 * 2) % 5 = 0 THEN 1 ELSE 0 END
 WHEN 'grid' THEN CASE WHEN px % 4 = 0 OR pz % 4 = 0 THEN 1 ELSE 0 END WHEN 'slabs' THEN CASE WHEN px % 5 = 0 OR pz % 7 = 0 THEN 1 ELSE 0 END WHEN 'stripes' THEN CASE WHEN px % 3 = 0 THEN 1 ELSE 0 END WHEN 'mosaic' THEN CASE WHEN noise % 100 < 20 THEN 2 WHEN noise % 100 < 48 THEN 1 ELSE 0 END
 WHEN 'mixed' THEN CASE WHEN noise % 10000 < CASE WHEN earthy THEN 6600 ELSE 7000 END THEN 0 WHEN noise % 10000 < CASE WHEN earthy THEN 9000 ELSE 9200 END THEN 1 ELSE 2 END ELSE CASE WHEN noise % 100 < 18 THEN 1 ELSE 0 END END::INT AS slot, count(*) AS n FROM h GROUP BY 1, 2""")
def laid_patterns(spark, sf):
    k = F.col("c_custkey")
    p = _pick(_PATTERNS, k % 10)
    slot = A.pattern_slot(p, k * 31 % 4000 - 2000, k * 17 % 3000 - 1500, seed=5, material=F.when(k % 3 == 0, "grass").otherwise("brick"))
    return table(spark, sf, "customer").groupBy(p.alias("pattern"), slot.alias("slot")).agg(F.count("*").alias("n"))


_ROADS = ["footway", "service", "track", "residential", "pedestrian", "living_street", None, "queue", "steps"]
_ACCESS = [None, "private", "customers", "delivery", "yes", None, "agricultural"]


@query(f"""WITH t AS (SELECT {_sql_pick(_ROADS, 'p_partkey % 9')} AS highway, {_sql_pick(_ACCESS, 'p_partkey % 7')} AS access, CASE WHEN p_partkey % 11 = 0 THEN 'Entrance Line A' ELSE p_name END AS name, CASE WHEN p_partkey % 13 = 0 THEN 'no' END AS foot, CASE WHEN p_partkey % 17 = 0 THEN 'yes' END AS staff, CASE WHEN p_partkey % 19 = 0 THEN 'yes' END AS queue, CASE WHEN p_partkey % 23 = 0 THEN 'alley' END AS service, CASE WHEN p_partkey % 2 = 0 THEN 'road' ELSE 'path' END AS kind FROM part)
SELECT kind, CASE WHEN queue = 'yes' OR coalesce(highway, '') = 'queue' OR (coalesce(access, '') = 'customers' AND regexp_matches(lower(name), 'queue|entrance line')) THEN 'queue' WHEN coalesce(access, '') IN ('private', 'no', 'permit', 'delivery', 'agricultural', 'forestry') OR foot = 'no' OR coalesce(highway, '') IN ('service', 'track') OR service IS NOT NULL OR staff = 'yes' THEN 'service'
 WHEN kind = 'road' AND coalesce(highway, '') NOT IN ('pedestrian', 'living_street') THEN 'service' ELSE 'guest' END AS role, count(*) AS n FROM t GROUP BY 1, 2""")
def path_roles(spark, sf):
    k = F.col("p_partkey")
    some = {
        "highway": _pick(_ROADS, k % 9), "access": _pick(_ACCESS, k % 7), "name": F.when(k % 11 == 0, "Entrance Line A").otherwise(F.col("p_name")), "foot": F.when(k % 13 == 0, "no"), "staff": F.when(k % 17 == 0, "yes"),
        "queue": F.when(k % 19 == 0, "yes"), "service": F.when(k % 23 == 0, "alley"),
    }
    tags = F.map_filter(F.create_map(*[x for n, v in some.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    kind = F.when(k % 2 == 0, "road").otherwise("path")
    return table(spark, sf, "part").groupBy(kind.alias("kind"), A.path_role(tags, kind).alias("role")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- words of drawings

_LABELS = [
    "Red tarmac path", "resin bound buff surfacing", "grey resin-bound", "new black asphalt", "existing tarmac", "light grey asphalt and gravel", "old concrete base", "concrete pavers", "block paving", "brickwork", "natural stone paving slabs", "granite kerb",
    "timber decking", "gravel", "amenity grass area", "topsoil", "slate roof", "clay tiles", "metal roof sheeting", "glass and steel", "asphalt", "blockpaving", "", "nothing of note", "150 mm dia pipe to outfall", "wheelchair ramp", "roof ridge line height 12.5m", "retaining wall ht 2.4 m",
    "existing oak tree T12 retained crown spread 8 m", "acoustic fence width: 0.2 m", "lighting column LC4 column height 6m", "mh 12 manhole", "attenuation basin 1:3 slope", "park bench proposed", "service gate to be removed", "silver birch stem", "rooflight 1200 x 900 mm", "RAL 7016 door set", "pitch 35 deg", "ramp 1:12 fall 8%",
]
_LABEL_AT = f"p_partkey % {len(_LABELS)}"
_MATERIAL_ROWS = ", ".join(f"({k}, '{m}', {c}::DOUBLE, '{p}')" for k, (m, _, c, ps) in enumerate(V.MATERIAL_RULES) for p in ps)
_OBJECT_ROWS = ", ".join(f"({k}, '{a}', '{b}', {c}::DOUBLE, '{p}')" for k, (a, b, p, c) in enumerate(V.OBJECT_RULES))


@query(f"""WITH t AS (SELECT p_partkey AS k, lower({_sql_pick(_LABELS, _LABEL_AT)}) AS t FROM part), r(rule_no, material, conf, pat) AS (VALUES {_MATERIAL_ROWS}),
h AS (SELECT k, t, material, min(rule_no) AS rule_no FROM t, r WHERE regexp_matches(t, pat) OR regexp_matches(replace(t, ' ', ''), pat) GROUP BY ALL), f AS (SELECT DISTINCT h.k, h.t, h.material, h.rule_no, r.conf FROM h JOIN r USING (rule_no)),
g AS (SELECT * FROM f WHERE NOT (material = 'weathered_asphalt' AND conf <= 0.72 AND k IN (SELECT k FROM f WHERE material IN ('red_tarmac', 'fresh_black_asphalt', 'light_asphalt'))) AND NOT (material = 'concrete' AND k IN (SELECT k FROM f WHERE material = 'old_concrete'))
 AND NOT (material = 'stone' AND regexp_matches(t, 'pav|flag|paver') AND k IN (SELECT k FROM f WHERE material = 'paving_stones')))
SELECT k, row_number() OVER (PARTITION BY k ORDER BY conf DESC, rule_no)::INT AS place, material, conf AS confidence FROM g""")
def material_labels(spark, sf):
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k.alias("k"), F.posexplode(V.materials(_pick(_LABELS, k % len(_LABELS)))).alias("at", "m"))
    return m.select("k", (F.col("at") + 1).cast("int").alias("place"), "m.material", "m.confidence")


@query(f"""WITH t AS (SELECT p_partkey AS k, lower({_sql_pick(_LABELS, _LABEL_AT)} || ' ' || p_partkey % 3) AS t FROM part), r(rule_no, a, b, conf, pat) AS (VALUES {_OBJECT_ROWS}), d AS (SELECT DISTINCT t FROM t),
h AS (SELECT t, rule_no, a, b, conf, length(trim(regexp_extract(t, pat, 0))) AS n FROM d, r WHERE regexp_matches(t, pat)), w AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conf DESC, n DESC, rule_no) AS rn FROM h)
SELECT k, a AS object_type, b AS subtype, conf AS confidence FROM t LEFT JOIN (SELECT * FROM w WHERE rn = 1) USING (t)""")
def object_labels(spark, sf):
    k = F.col("p_partkey")
    c = V.object_class(F.concat(_pick(_LABELS, k % len(_LABELS)), F.lit(" "), (k % 3).cast("string")))
    return table(spark, sf, "part").select(k.alias("k"), c.alias("c")).select("k", "c.object_type", "c.subtype", "c.confidence")


def _number_sql(pattern, lo, hi):
    x = f"TRY_CAST(nullif(regexp_extract(t, '{pattern}', 1), '') AS DOUBLE)"
    return f"CASE WHEN {x} BETWEEN {lo} AND {hi} THEN {x} END"


@query(rf"""WITH t AS (SELECT p_partkey AS k, lower({_sql_pick(_LABELS, _LABEL_AT)}) AS t FROM part)
SELECT k, {_number_sql(r'\b(?:overall\s+height|column\s+height|height|ht)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,3})?)\s*m\b', 0.05, 250)} AS height_m, {_number_sql(r'\b(?:overall\s+width|width|wd)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,3})?)\s*m\b', 0.05, 250)} AS width_m,
 coalesce({_number_sql(r'\b(?:dia(?:meter)?\.?\s*)?([0-9]{2,4})\s*mm\s+(?:dia(?:meter)?\.?\s*)?(?:pipe|sewer|drain|culvert)\b', 20, 5000)}, {_number_sql(r'\b(?:pipe|sewer|drain|culvert)\s+(?:dia(?:meter)?\.?\s*)?([0-9]{2,4})\s*mm\b', 20, 5000)}) AS pipe_mm,
 {_number_sql(r'\b(?:crown\s+spread|canopy\s+spread|spread)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*m\b', 0.1, 100)} AS crown_m, {_number_sql(r'\b1\s*[:/]\s*([0-9]{1,4}(?:\.[0-9]+)?)\b', 0.001, 9999)} AS gradient_ratio, {_number_sql(r'\b[0-9]{2,5}(?:\.[0-9]+)?\s*[x×]\s*([0-9]{2,5}(?:\.[0-9]+)?)\s*mm\b', 0, 99999)} AS size_b_mm, {_number_sql(r'\bral\s*[-:]?\s*([0-9]{4})\b', 0, 9999)} AS ral,
 CASE WHEN regexp_matches(t, 'silver birch') THEN 'silver birch' WHEN regexp_matches(t, '\boak\b') THEN 'oak' END AS species,
 CASE WHEN regexp_matches(t, '\b(?:to\s+be\s+removed|remove|removed|fell|felled|demolish|demolished)\b') THEN 'removed' WHEN regexp_matches(t, '\b(?:retained|retain|existing\s+to\s+remain)\b') THEN 'retained' WHEN regexp_matches(t, '\b(?:proposed|new|replacement)\b') THEN 'proposed' WHEN regexp_matches(t, '\bexisting\b') THEN 'existing' END AS status FROM t""")
def object_attributes(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(k.alias("k"), V.object_details(_pick(_LABELS, k % len(_LABELS))).alias("d"))
    return d.select("k", *[f"d.{c}" for c in ("height_m", "width_m", "pipe_mm", "crown_m", "gradient_ratio", "size_b_mm", "ral", "species", "status")])


_STUFF = ["slate_roof", "gravel", "brick", "concrete", "glass", "sand", "light_asphalt", None]
_KINDS = ["building", "structure", "path", "road", "barrier", "ride_track", "terrain_detail"]


@query(f"""WITH c AS (SELECT {_sql_pick(_STUFF, 'p_partkey % 8')} AS m, {_sql_pick(_KINDS, 'p_partkey % 7')} AS kind FROM part)
SELECT m AS material, kind, CASE WHEN m IS NULL THEN false WHEN m = 'slate_roof' THEN kind = 'building' WHEN m IN ('gravel', 'light_asphalt') THEN kind IN ('path', 'road', 'terrain_detail') WHEN m IN ('brick', 'glass') THEN kind IN ('building', 'structure', 'barrier') ELSE kind != 'terrain_detail' END AS fits,
 CASE WHEN m = 'slate_roof' AND kind = 'building' THEN 'roof' WHEN kind = 'barrier' THEN 'barrier' WHEN kind IN ('building', 'structure') THEN 'wall' ELSE 'surface' END AS role, count(*) AS n FROM c GROUP BY ALL""")
def material_kinds(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(_pick(_STUFF, k % 8).alias("material"), _pick(_KINDS, k % 7).alias("kind"))
    known = F.col("material")
    fits = F.when(known.isNull(), False).otherwise(V.material_fits(F.col("kind"), known))
    return c.groupBy("material", "kind", fits.alias("fits"), D.material_role(known, F.lit(""), F.col("kind")).alias("role")).agg(F.count("*").alias("n"))


_TITLES = ["Ride track layout", "Longitudinal section", "Section A-B", "North elevation", "Soft landscape plan", "Master plan", "General arrangement", "Schedule of works", "running rails"]
_KNOWN = ["unknown", "supporting", "decision", None]


@query(f"""WITH c AS (SELECT p_partkey AS k, {_sql_pick(_KNOWN, 'p_partkey % 4')} AS known, {_sql_pick(_TITLES, 'p_partkey % 9')} AS title, CASE WHEN p_partkey % 6 = 0 THEN 'the coaster track plan' ELSE 'north elevation' END AS body FROM part),
n AS (SELECT *, CASE title WHEN 'Ride track layout' THEN 'ride_layout' WHEN 'running rails' THEN 'ride_layout' WHEN 'Longitudinal section' THEN 'section' WHEN 'Section A-B' THEN 'section' WHEN 'North elevation' THEN 'elevation' WHEN 'Soft landscape plan' THEN 'landscape_plan' WHEN 'Master plan' THEN 'site_plan' END AS named FROM c)
SELECT k, CASE WHEN known = 'decision' THEN known WHEN named IS NOT NULL THEN named WHEN body LIKE '%coaster%' THEN 'ride_layout' ELSE known END AS classification,
 CASE WHEN known = 'decision' THEN 1 WHEN named IS NOT NULL THEN CASE named WHEN 'ride_layout' THEN 0.99 WHEN 'section' THEN 0.96 WHEN 'elevation' THEN 0.95 WHEN 'landscape_plan' THEN 0.94 ELSE 0.93 END WHEN body LIKE '%coaster%' THEN 0.94 ELSE 0 END::DOUBLE AS confidence FROM n""")
def reclassified_documents(spark, sf):
    k = F.col("p_partkey")
    r = D.reclassify(_pick(_KNOWN, k % 4), _pick(_TITLES, k % 9), F.when(k % 6 == 0, "the coaster track plan").otherwise("north elevation"))
    return table(spark, sf, "part").select(k.alias("k"), r.alias("r")).select("k", "r.classification", "r.confidence")


@query()
def text_windows(spark, sf):
    """Words of all texts of 'benchmark', laid out on lines of a page each: runs of up to four neighbours."""
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("item", "text"))
    i = F.col("item")
    return V.text_windows(b.select("item_id", "item", "text", (i % 6 * 60 + F.when(i % 5 == 0, 30).otherwise(0)).cast("double").alias("x"), (700 - F.floor(i / 6) * 12 + i % 2).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(8.0).alias("size")), ["item_id"])


# ---------------------------------------------------------------- applications

@query("""WITH a AS (SELECT n_nationkey AS anchor_id, lower(n_name) AS name, 1 - (n_nationkey % 4) / 10.0 AS w FROM nation), t AS (SELECT o_orderkey AS id, lower(CASE o_orderkey % 4 WHEN 0 THEN 'works at ' || n_name || 'land station' WHEN 1 THEN n_name || ' and ' || (SELECT n_name FROM nation x WHERE x.n_nationkey = (o_orderkey * 3) % 25) WHEN 2 THEN 'nothing' ELSE 'the ' || n_name END) AS t FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
d AS (SELECT DISTINCT t, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS p FROM t), x AS (SELECT t, w, CASE WHEN contains(p, trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g'))) THEN 1 WHEN list_contains(string_split(p, ' '), 'nation') THEN 0.72 END AS s FROM d, a), m AS (SELECT t, floor(s * w * 1000 + 0.5) / 1000 AS s FROM x WHERE s IS NOT NULL), g AS (SELECT t, max(s) AS best, count(*) AS n FROM m GROUP BY 1)
SELECT id AS application_id, floor(least(1, coalesce(best, 0) + least(0.12, greatest(0, coalesce(n, 0) - 1) * 0.02))::DOUBLE * 1000 + 0.5) / 1000 AS score, coalesce(n, 0) AS anchors FROM t LEFT JOIN g USING (t)""")
def application_ranking(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("n_nationkey") == k % 25).join(F.broadcast(n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("other"))), F.col("k2") == k * 3 % 25)
    text = F.when(k % 4 == 0, F.concat(F.lit("works at "), "n_name", F.lit("land station"))).when(k % 4 == 1, F.concat("n_name", F.lit(" and "), "other")).when(k % 4 == 2, "nothing").otherwise(F.concat(F.lit("the "), "n_name"))
    apps = o.select(k.alias("application_id"), text.alias("text"), k.alias("at"))
    anchors = n.select(F.col("n_nationkey").alias("anchor_id"), F.col("n_name").alias("name"), (1 - F.col("n_nationkey") % 4 / 10.0).alias("weight"))
    m = D.relevant_applications(anchors, apps).join(F.broadcast(anchors.select("anchor_id", "weight")), "anchor_id")
    return D.application_ranking(m, apps, "at").select("application_id", "score", "anchors")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'APP/' || o_orderkey WHEN 1 THEN 'APP/' || (o_orderkey - 1) || ' CON' ELSE 'REF/' || o_orderkey || '/X' END AS ref, CASE o_orderkey % 4 WHEN 2 THEN 'relates to app ' || (o_orderkey - 2) || ' of old' ELSE 'a description' END AS t, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN 120 WHEN o_orderkey % 4 = 0 THEN 0 ELSE 60 END AS s FROM orders),
c AS (SELECT id, CASE id % 4 WHEN 1 THEN id - 1 WHEN 2 THEN id - 2 END AS target, s FROM r)
SELECT c.id, CASE WHEN t.s > c.s THEN t.id END AS alias_of, CASE WHEN t.s > c.s THEN CASE c.id % 4 WHEN 1 THEN 'reference-suffix-alias' ELSE 'explicit-related-application-reference' END END AS reason FROM c LEFT JOIN r t ON t.id = c.target AND length('app ' || t.id) >= CASE WHEN c.id % 4 = 2 THEN 6 ELSE 0 END""")
def reference_aliases(spark, sf):
    k = F.col("o_orderkey")
    m = k % 4
    ref = F.when(m == 0, F.concat(F.lit("APP/"), k)).when(m == 1, F.concat(F.lit("app/"), k - 1, F.lit("  con"))).otherwise(F.concat(F.lit("REF/"), k, F.lit("/X")))
    text = F.when(m == 2, F.concat(F.lit("Relates to APP "), k - 2, F.lit(" of old"))).otherwise("a description")
    strength = F.when((m == 0) & (k % 8 == 0), 120).when(m == 0, 0).otherwise(60)
    return U.reference_aliases(table(spark, sf, "orders").select(k.alias("id"), ref.alias("ref"), text.alias("text"), strength.alias("s")), "id", "ref", "text", "s")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 3 = 0 THEN least(doc_id % 20, doc_id % 7) END AS own FROM documents)
SELECT doc_id, coalesce(own, ('0x' || substr(sha256(h), 1, 8))::BIGINT % 20)::INT AS shard FROM d""")
def affine_shards(spark, sf):
    i = F.col("doc_id")
    own = F.when(i % 3 == 0, F.array(i % 20, i % 7)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "documents").select("doc_id", K.affine_shard(own, F.sha2("text", 256), 64).alias("shard"))


@query("""WITH w AS (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM benchmark) SELECT item_id, (0.25 + least(2, 0.02 * n))::DOUBLE AS weight FROM w""")
def template_weights(spark, sf):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return table(spark, sf, "benchmark").select("item_id", K.template_weight(n).cast("double").alias("weight"))


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS name, CASE s_suppkey % 9 WHEN 0 THEN '2d-only' ELSE 'partial-3d' END AS status, CASE s_suppkey % 9 WHEN 0 THEN NULL ELSE 0.8 + (s_suppkey % 20) / 100.0 END AS cover, (1 + s_suppkey % 50)::DOUBLE AS length FROM supplier), n AS (SELECT * FROM r WHERE name IS NOT NULL AND trim(name) != ''),
g AS (SELECT count(*) AS n, count(*) FILTER (status = '2d-only' OR coalesce(cover, 0) <= 0) AS flat, count(*) FILTER (coalesce(cover, 0) < 0.9) AS low, count(*) FILTER (coalesce(cover, 0) > 0) AS good, sum(coalesce(cover, 0) * length) / sum(length) AS total FROM n)
SELECT 'some-ride-has-height' AS gate, n = 0 OR good > 0 AS pass, good AS n FROM g UNION ALL SELECT 'no-ride-is-flat', flat = 0, flat FROM g UNION ALL SELECT 'each-ride-is-covered', low = 0, low FROM g UNION ALL SELECT 'rides-are-covered', n = 0 OR total >= 0.9, n FROM g""")
def ride_gate(spark, sf):
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(F.when(k % 5 != 0, F.col("s_name")).alias("name"), F.when(k % 9 == 0, "2d-only").otherwise("partial-3d").alias("status"), F.when(k % 9 != 0, 0.8 + k % 20 / 100.0).alias("vertical_coverage"), (1 + k % 50).cast("double").alias("length"))
    return C.ride_gate(r)


# ---------------------------------------------------------------- change sets

_TEXT = ["new fence", "ornamental lake", "service road", "footpath", "platform", "trees", "retaining works", ""]
_SEMANTIC = ["roof-plane", "demolition-footprint", "building-footprint-or-room", "", "", "", "site-edge-or-route", "", "", ""]
_CLASS = ["Ride Layout", "floor plan", "landscape-plan", "site-plan", "site-plan", "site-plan", "site-plan", "site-plan", "site-plan"]
_EXPLICIT = ["terrain", "surface", "path", "building", None, None, None, None, None, None, None, None, None]
_HAVE = ["building", "path", "road", "water", "barrier", "structure", "vegetation"]
_CAND_SQL = f"""c AS (SELECT p_partkey AS k, {_sql_pick(_TEXT, 'p_partkey % 8')} AS t, {_sql_pick(_SEMANTIC, 'p_partkey % 10')} AS s, {_sql_pick([x.lower().replace(' ', '_').replace('-', '_') for x in _CLASS], 'p_partkey % 9')} AS cl, {_sql_pick(_EXPLICIT, 'p_partkey % 13')} AS e, CASE WHEN p_partkey % 3 = 1 THEN 'line' ELSE 'area' END AS shape,
 CASE WHEN p_partkey % 4 = 0 THEN 'gravel' END AS m, CASE p_partkey % 6 WHEN 0 THEN 'delete' WHEN 1 THEN 'add' WHEN 2 THEN 'replace' ELSE 'auto' END AS op, p_partkey % 5 != 0 AS cur, p_partkey % 17 = 0 AS dem, p_partkey % 23 != 0 AS has, CASE WHEN p_partkey % 19 = 0 THEN (p_partkey % 40) * 3 + 1 END AS cert FROM part),
f AS (SELECT {_BOX.format(k='(s_suppkey * 3 + 1)')}, {_sql_pick(_HAVE, 's_suppkey % 7')} AS have FROM supplier),
i AS (SELECT c.*, f.have AS ck, CASE WHEN e = 'terrain' THEN NULL WHEN e = 'surface' THEN 'surface' WHEN e = 'path' AND s != '' THEN CASE WHEN s = 'site-edge-or-route' THEN 'path' END WHEN e = 'building' AND s != '' THEN CASE WHEN s = 'building-footprint-or-room' THEN 'building' END WHEN e IS NOT NULL THEN e WHEN f.have IS NOT NULL THEN f.have
 WHEN cl = 'ride_layout' AND shape = 'line' THEN 'ride_track' WHEN s = 'demolition-footprint' THEN 'building' WHEN s = 'building-footprint-or-room' OR (cl = 'floor_plan' AND shape = 'area') THEN 'building' WHEN s = 'roof-plane' THEN 'building' WHEN t = 'new fence' THEN 'barrier' WHEN t = 'ornamental lake' THEN 'water' WHEN t = 'service road' THEN 'road' WHEN t = 'footpath' THEN 'path' WHEN t = 'platform' THEN 'structure'
 WHEN t = 'trees' AND shape = 'area' THEN 'vegetation' WHEN shape = 'area' AND (m IS NOT NULL OR cl = 'landscape_plan') THEN 'surface' END AS kind,
 CASE WHEN e = 'terrain' THEN 'terrain-geometry-immutable' WHEN e = 'path' AND s != '' AND s != 'site-edge-or-route' THEN 'explicit-kind-incompatible-with-planning-semantic' WHEN e = 'building' AND s != '' AND s != 'building-footprint-or-room' THEN 'explicit-kind-incompatible-with-planning-semantic' ELSE 'semantic-kind-unresolved' END AS why,
 e IS NULL AND f.have IS NOT NULL AS sure, e IS NULL AND f.have IS NULL AND NOT (cl = 'ride_layout' AND shape = 'line') AND s = 'roof-plane' AND NOT (cl = 'floor_plan' AND shape = 'area') AS only_match FROM c LEFT JOIN f ON f.id = c.cert)"""
_L = f"l AS (SELECT b.*, i.kind AS want FROM (SELECT {_BOX.format(k='p_partkey')} FROM part) b JOIN i ON i.k = b.id WHERE has AND kind IS NOT NULL AND kind != 'surface')"
_MATCH = _SCORE.format(w0="0.46::DOUBLE", w1="0.29::DOUBLE", w2="0.17::DOUBLE", w3="0.08::DOUBLE", o="0.5").replace("FROM l, r WHERE", "FROM l, f AS r WHERE l.want = r.have AND")


@query(f"""WITH {_CAND_SQL}, {_L}, s AS ({_MATCH}), w AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn, lead(score) OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS second FROM s),
b AS (SELECT l_id, r_id, CASE WHEN score < 0.7 THEN 'low' WHEN second IS NOT NULL AND score - second < 0.08 THEN 'ambiguous' ELSE 'accepted' END AS st FROM w WHERE rn = 1),
j AS (SELECT i.*, CASE WHEN sure THEN 'accepted' ELSE coalesce(st, 'none') END AS match, CASE WHEN sure THEN cert WHEN st = 'accepted' THEN r_id END AS target FROM i LEFT JOIN b ON b.l_id = i.k),
p AS (SELECT j.*, greatest(abs(x.min_x - y.min_x), abs(x.min_z - y.min_z), abs(x.max_x - y.max_x), abs(x.max_z - y.max_z)) <= 0.5 AS same FROM j JOIN (SELECT {_BOX.format(k='p_partkey')} FROM part) x ON x.id = j.k LEFT JOIN f y ON y.id = j.target),
d AS (SELECT k, coalesce(kind, 'none') AS kind, target, CASE WHEN why = 'terrain-geometry-immutable' THEN 'review' WHEN NOT has THEN 'review' WHEN op = 'delete' AND NOT cur AND NOT dem THEN 'review' WHEN NOT cur AND NOT dem THEN 'ignored' WHEN dem OR op = 'delete' THEN CASE WHEN kind IS NULL OR kind = 'surface' OR match != 'accepted' THEN 'review' ELSE 'delete' END
 WHEN kind = 'surface' THEN CASE WHEN shape = 'area' AND m IS NOT NULL THEN 'paint' ELSE 'review' END WHEN kind IS NULL THEN 'review' WHEN match = 'accepted' THEN CASE WHEN op = 'add' THEN 'review' WHEN same THEN 'retain' ELSE 'replace' END WHEN match = 'ambiguous' THEN 'review' WHEN only_match THEN 'review' ELSE 'add' END AS action FROM p)
SELECT kind, action, count(*) AS n, coalesce(sum(CASE WHEN action IN ('delete', 'replace', 'retain') THEN target END), 0)::BIGINT AS targets FROM d GROUP BY 1, 2""")
def change_set(spark, sf):
    k, fam = F.col("p_partkey"), lambda c: F.when(c % 3 == 0, "line").otherwise("area")
    p = table(spark, sf, "part")
    there = F.col("id") % 23 != 0
    boxes = _boxes(p, "p_partkey", fam(k)).withColumns({c: F.when(there, F.col(c)) for c in ("min_x", "min_z", "max_x", "max_z")}).withColumnRenamed("id", "candidate_id")
    c = p.select(
        k.alias("candidate_id"), _pick(_TEXT, k % 8).alias("text"), _pick(_SEMANTIC, k % 10).alias("semantic"), _pick(_CLASS, k % 9).alias("classification"), _pick(_EXPLICIT, k % 13).alias("kind"), F.when(k % 3 == 1, "line").otherwise("area").alias("shape"), F.when(k % 4 == 0, "gravel").alias("material"),
        F.when(k % 6 == 0, "delete").when(k % 6 == 1, "add").when(k % 6 == 2, "replace").otherwise("auto").alias("operation"), (k % 5 != 0).alias("current"), (k % 17 == 0).alias("demolished"), F.when(k % 19 == 0, k % 40 * 3 + 1).alias("certified"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("k"), _pick(_HAVE, F.col("s_suppkey") % 7).alias("kind"))
    f = _boxes(s, "k", fam(F.col("k"))).join(s.withColumnRenamed("k", "id"), "id")
    d = H.compile_changes(c.join(boxes, "candidate_id"), f)
    return d.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "action").agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0)).alias("targets"))
