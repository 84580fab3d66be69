"""Registered queries of the fusion operators over the driver tables, each with the SQL that must agree.

The tables have no geometry: positions are whole-number functions of keys, the same in both engines. Rules over words are bound to
columns whose values reach their branches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.core.session import table
from strataweave.functions import appearance as A
from strataweave.functions import geometry as G
from strataweave.functions import ladders as L
from strataweave.functions import scalars as S
from strataweave.operators import details as D
from strataweave.operators import evidence as E
from strataweave.operators import fusion as U
from strataweave.operators import ordered as O
from strataweave.operators import partitioning as K
from strataweave.operators import raster as R
from strataweave.operators import reconcile as C
from strataweave.operators import registration as T
from strataweave.operators import spatial as J
from strataweave.plans.graph import connected_components, node_degrees
from strataweave.sources import web as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- evidence

_STATES = ["current", "unknown", "proposed", "superseded", "refused", "demolished"]


def candidates(spark, sf):
    e = table(spark, sf, "events")
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")) * 60
    k = F.get_json_object("props", "$.k").try_cast("double")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 6 + 1).cast("int"))
    terms = E.quality_terms(k * 4, F.col("event_id") % 10 / 10.0, F.col("value") / 100.0, age, (F.col("event_id") % 8).cast("double"), state, F.col("event_id") % 5 / 4.0)
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("attribute"), F.col("value"), F.col("event_id").alias("ref"), (k * 4).alias("authority_rank"), E.evidence_score(terms).alias("score"))


_CAND = """
q AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) * 4 AS rank_, date_diff('day', ts::DATE, DATE '2024-02-01') * 60 AS age, (event_id % 8)::DOUBLE AS res, event_id % 6 AS st, (event_id % 5) / 4.0::DOUBLE AS sc FROM events),
cand AS (SELECT user_id AS entity, event_type AS attribute, value, event_id AS ref, rank_ AS authority_rank,
  floor((0.34::DOUBLE * coalesce(greatest(0, least(1, rank_ / 400)), 0) + 0.24::DOUBLE * ((event_id % 10) / 10.0::DOUBLE) + 0.15::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, value / 100))
  + 0.10::DOUBLE * (CASE WHEN age <= 730 THEN 1.0 WHEN age <= 1825 THEN 0.9 WHEN age <= 3650 THEN 0.76 WHEN age <= 7300 THEN 0.62 ELSE 0.48 END)::DOUBLE
  + 0.10::DOUBLE * (CASE WHEN res <= 0 THEN 0.66 WHEN res <= 0.25 THEN 1.0 WHEN res <= 0.5 THEN 0.96 WHEN res <= 1 THEN 0.92 WHEN res <= 2 THEN 0.82 WHEN res <= 5 THEN 0.68 WHEN res <= 10 THEN 0.52 ELSE 0.3 END)::DOUBLE
  + 0.07::DOUBLE * ((CASE st WHEN 0 THEN 1.0 WHEN 1 THEN 0.62 WHEN 2 THEN 0.45 WHEN 3 THEN 0.12 ELSE 0.04 END)::DOUBLE * (0.65::DOUBLE + 0.35::DOUBLE * sc))) * 1000 + 0.5) / 1000 AS score FROM q),
rk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner_up_score, lead(value) OVER w AS other, count(*) OVER (PARTITION BY entity, attribute) AS n FROM cand WINDOW w AS (PARTITION BY entity, attribute ORDER BY score DESC, authority_rank DESC NULLS LAST, ref)),
res AS (SELECT entity, attribute, value, score, ref, runner_up_score, least(n - 1, 4)::INT AS n_alternatives, coalesce(runner_up_score IS NOT NULL AND abs(value - other) > 1.0 AND abs(score - runner_up_score) < 0.12, false) AS conflict FROM rk WHERE rn = 1)
"""


def _resolved(spark, sf):
    return E.resolve(candidates(spark, sf), tolerance=F.lit(1.0))


@query(f"WITH {_CAND} SELECT * FROM res")
def evidence_winner(spark, sf):
    return _resolved(spark, sf).drop("alternatives")


@query(f"WITH {_CAND} SELECT entity, attribute, score - runner_up_score AS margin FROM res WHERE conflict")
def evidence_conflicts(spark, sf):
    return _resolved(spark, sf).where("conflict").select("entity", "attribute", (F.col("score") - F.col("runner_up_score")).alias("margin"))


@query(f"WITH {_CAND} SELECT attribute, CASE WHEN GROUPING(entity) = 1 THEN NULL ELSE entity END AS entity, count(*) AS total, count(*) FILTER (score < 0.72) AS low_confidence, count(*) FILTER (conflict) AS conflicts FROM res GROUP BY GROUPING SETS ((entity), (attribute), ())")
def evidence_summary(spark, sf):
    return E.summary(_resolved(spark, sf), ["attribute", "entity"])


@query(f"""WITH {_CAND}, req AS (SELECT DISTINCT user_id AS entity, a AS attribute FROM events, (VALUES ('view'), ('click'), ('purchase'), ('refund')) t(a))
SELECT r.entity, r.attribute, CASE WHEN res.score IS NULL THEN 'missing' ELSE 'low-confidence' END AS status, least(100, floor(60 + 2 - coalesce(res.score, 0) * 10 + 0.5))::DOUBLE AS priority
FROM req r LEFT JOIN res USING (entity, attribute) WHERE res.score IS NULL OR res.score < 0.72 ORDER BY priority DESC, r.entity, r.attribute LIMIT 500""")
def gap_queue(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct()
    req = users.withColumns({"kind": F.lit("path"), "attribute": F.explode(F.array(*map(F.lit, ["view", "click", "purchase", "refund"])))})
    return E.gaps(req, _resolved(spark, sf)).select("entity", "attribute", "status", "priority").orderBy(F.col("priority").desc(), "entity", "attribute").limit(500)


@query(f"WITH {_CAND} SELECT entity, attribute, score FROM res WHERE NOT conflict AND score >= CASE WHEN entity % 2 = 0 THEN 0.72 ELSE 0.50 END")
def evidence_materialised(spark, sf):
    known = table(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("entity"), F.col("event_type").alias("attribute"))
    return E.materialise(_resolved(spark, sf), known).select("entity", "attribute", "score")


@query("""WITH c AS (SELECT o_orderpriority AS grp, avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.75 ELSE 0.25 END)::DOUBLE AS boundary, least(1.0, count(*) / 4000.0)::DOUBLE AS planimetry, (avg(o_totalprice) / 400000.0)::DOUBLE AS rides,
  (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / count(*) AS structures, 0.95::DOUBLE AS terrain, 0.5::DOUBLE AS freshness, max(o_totalprice) > 499000 AS critical FROM orders GROUP BY 1),
t AS (SELECT *, 0.18::DOUBLE * boundary + 0.24::DOUBLE * planimetry + 0.22::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, rides)) + 0.16::DOUBLE * structures + 0.14::DOUBLE * terrain + 0.06::DOUBLE * freshness AS s FROM c),
g AS (SELECT *, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.65 THEN 'C' WHEN s >= 0.5 THEN 'D' ELSE 'E' END AS score_grade FROM t)
SELECT grp, floor(s * 1000 + 0.5) / 1000 AS score, score_grade, CASE WHEN critical AND score_grade = 'A' THEN 'B' ELSE score_grade END AS grade FROM g""")
def accuracy_score(spark, sf):
    o = table(spark, sf, "orders")
    c = o.groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.75).otherwise(0.25)).alias("boundary"), F.least(F.lit(1.0), F.count("*") / 4000.0).alias("planimetry"), (F.avg("o_totalprice") / 400000.0).alias("rides"),
        (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("structures"), F.lit(0.95).alias("terrain"), F.lit(0.5).alias("freshness"), (F.max("o_totalprice") > 499000).alias("critical"))
    return E.accuracy(c, F.col("critical")).select("grp", "score", "score_grade", "grade")


@query("""SELECT l_returnflag, l_linestatus, avg(CASE WHEN d <= 180 THEN 1.0 WHEN d <= 730 THEN 0.75 WHEN d <= 1825 THEN 0.5 ELSE 0.2 END)::DOUBLE AS freshness, avg(CASE WHEN d <= 730 THEN 1.0 WHEN d <= 1825 THEN 0.9 WHEN d <= 3650 THEN 0.76 WHEN d <= 7300 THEN 0.62 ELSE 0.48 END)::DOUBLE AS recency
FROM (SELECT *, date_diff('day', l_shipdate::DATE, DATE '2002-01-01') AS d FROM lineitem) GROUP BY ALL""")
def freshness_score(spark, sf):
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("l_shipdate"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg(S.freshness_score(age)).alias("freshness"), F.avg(S.recency_score(age)).alias("recency"))


# ---------------------------------------------------------------- ladders and text

_PHRASES = {"0": "Demolished 2019", "1": "application refused", "2": "Superseded drawing", "3": "under construction", "4": "proposed, outline", "5": "Approved", "6": "", "7": "withdrawn"}
_PHRASE_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PHRASES.items()) + " END"


@query(f"""WITH p AS (SELECT o_orderstatus, lower({_PHRASE_SQL}) AS t FROM orders)
SELECT o_orderstatus, CASE WHEN regexp_matches(t, 'demolish|demolished|removed') THEN 'demolished' WHEN regexp_matches(t, 'refused|rejected|withdrawn|cancelled') THEN 'refused' WHEN regexp_matches(t, 'superseded|obsolete') THEN 'superseded'
 WHEN regexp_matches(t, 'construction|implemented|completed|built|operational|existing|current') THEN 'current' WHEN regexp_matches(t, 'proposed|pending|submitted|outline') THEN 'proposed' WHEN regexp_matches(t, 'approved|granted|consent') THEN 'proposed'
 WHEN o_orderstatus = 'F' THEN 'current' ELSE 'unknown' END AS state,
 CASE WHEN regexp_matches(t, 'demolish') THEN 0.96 WHEN regexp_matches(t, 'refused|withdrawn|superseded') THEN 0.94 WHEN regexp_matches(t, 'construction') THEN 0.92 WHEN regexp_matches(t, 'proposed') THEN 0.9 WHEN regexp_matches(t, 'approved') THEN 0.72 WHEN o_orderstatus = 'F' THEN 0.76 ELSE 0.45 END::DOUBLE AS confidence, count(*) AS n
FROM p GROUP BY ALL""")
def temporal_state_ladder(spark, sf):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES.values())), (F.col("o_orderkey") % 8 + 1).cast("int"))
    layer = F.when(F.col("o_orderstatus") == "F", "osm").otherwise("planning")
    o = table(spark, sf, "orders").withColumn("t", L.temporal_state(phrase, layer=layer))
    return o.groupBy("o_orderstatus", F.col("t.state").alias("state"), F.col("t.confidence").alias("confidence")).agg(F.count("*").alias("n"))


_LABEL = "CASE p_partkey % 9 WHEN 0 THEN 'Proposed site-plan' WHEN 1 THEN 'Roof plan rev B' WHEN 2 THEN 'Coaster track layout' WHEN 3 THEN 'North elevations' WHEN 4 THEN 'Planting plan' WHEN 5 THEN 'Flood risk' WHEN 6 THEN p_name WHEN 7 THEN 'Decision notice' ELSE 'Level survey' END"
_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in L.DOCUMENT_RULES) + " WHEN p_partkey % 2 = 0 THEN 'supporting' ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT p_partkey, regexp_replace(regexp_replace(lower({_LABEL} || ' https://example.org/' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '/x.pdf' ELSE '/x' END), '[._+%/\\\\?&=#-]+', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM part)
SELECT classification, count(*) AS n, min(p_partkey) AS first_key FROM (SELECT p_partkey, {_CLASS_SQL} AS classification FROM p) GROUP BY 1""")
def document_classes(spark, sf):
    url = F.concat(F.lit("https://example.org/"), "p_type", F.when(F.col("p_partkey") % 2 == 0, "/x.pdf").otherwise("/x"))
    p = table(spark, sf, "part").withColumn("classification", L.document_class(F.expr(_LABEL), url))
    return p.groupBy("classification").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("""WITH r AS (SELECT p_partkey % 50 AS lineage, p_partkey AS id, CASE WHEN p_partkey % 50 < 20 THEN 'REV ' || (p_partkey // 50) WHEN p_partkey % 50 < 30 THEN 'P' || lpad((p_partkey // 50)::VARCHAR, 2, '0') WHEN p_partkey % 50 < 40 THEN CASE WHEN p_partkey % 100 < 50 THEN 'A' ELSE '3' END ELSE NULL END AS rev FROM part),
x AS (SELECT lineage, id, CASE WHEN lineage < 20 THEN 'number|' WHEN lineage < 30 THEN 'prefixed-number|P' WHEN rev = 'A' THEN 'letter|' WHEN rev = '3' THEN 'number|' END AS fam, CASE WHEN lineage < 20 OR lineage BETWEEN 20 AND 29 THEN id // 50 WHEN rev = 'A' THEN 1 WHEN rev = '3' THEN 3 END AS num FROM r),
g AS (SELECT lineage, count(DISTINCT fam) AS families, count(*) FILTER (fam IS NULL) AS unknown, max(num) AS top, count(*) AS n FROM x GROUP BY 1),
t AS (SELECT lineage, min(id) AS latest, count(*) AS tops FROM x JOIN g USING (lineage) WHERE num = top GROUP BY 1)
SELECT g.lineage, CASE WHEN families = 1 AND unknown = 0 AND tops = 1 THEN latest END AS latest, CASE WHEN families = 1 AND unknown = 0 AND tops = 1 THEN 'latest' ELSE 'ambiguous' END AS status, n FROM g LEFT JOIN t USING (lineage)""")
def revision_chain(spark, sf):
    k = F.col("p_partkey")
    n = F.floor(k / 50).cast("string")
    rev = F.when(k % 50 < 20, F.concat(F.lit("REV "), n)).when(k % 50 < 30, F.concat(F.lit("P"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), "0"))).when(k % 50 < 40, F.when(k % 100 < 50, "A").otherwise("3"))
    d = table(spark, sf, "part").select((k % 50).alias("lineage"), k.alias("id"), S.revision(rev).alias("rev"))
    return U.latest_revisions(d, "lineage", F.col("rev"), "id")


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, list_sort(list(DISTINCT source))::VARCHAR AS sources, count(*) - 1 AS duplicates FROM documents GROUP BY 1""")
def document_catalogue(spark, sf):
    c = U.catalogue(table(spark, sf, "documents"), "text", "source", "doc_id")
    return c.withColumn("sources", F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]")))


@query("""WITH k AS (SELECT doc_id, n_chars % 7 AS s, CASE WHEN length(text) >= 40 THEN sha256(text) END AS k FROM documents), k2 AS (SELECT *, doc_id % 7 AS st FROM k),
b AS (SELECT k, max(st) AS top FROM k2 WHERE k IS NOT NULL GROUP BY 1), w AS (SELECT k2.k, top, min(doc_id) AS target FROM k2 JOIN b ON k2.k = b.k AND st = top GROUP BY 1, 2)
SELECT doc_id, CASE WHEN st < top THEN target END AS alias_of FROM k2 LEFT JOIN w ON k2.k = w.k""")
def alias_collapse(spark, sf):
    return U.collapse_aliases(table(spark, sf, "documents").withColumn("st", F.col("doc_id") % 7), "doc_id", "text", "st")


@query(r"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)[^>]*>.*?</a>')) AS a FROM pages),
h AS (SELECT page_id, base, trim(replace(coalesce(nullif(regexp_extract(a, '(?is)href\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(a, '(?is)href\s*=\s*''([^'']*)''', 1), ''), nullif(regexp_extract(a, '(?is)href\s*=\s*([^\s>"'']+)', 1), '')), '&amp;', '&')) AS href FROM a),
r AS (SELECT *, regexp_extract(base, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(base, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path FROM h),
f AS (SELECT page_id, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href[1:2] = '//' THEN 'https:' || href WHEN href[1] = '/' THEN root || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR href[1] = '#' THEN NULL
  ELSE root || CASE WHEN regexp_matches(root || regexp_replace(path, '[^/]*$', ''), '/$') THEN regexp_replace(path, '[^/]*$', '') ELSE regexp_replace(path, '[^/]*$', '') || '/' END || href END AS url FROM r)
SELECT page_id, count(*) AS n, count(DISTINCT u) AS distinct_urls FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM f) WHERE u IS NOT NULL AND u != '' GROUP BY 1""")
def page_links(spark, sf):
    return W.page_links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("url").alias("distinct_urls"))


@query("""SELECT ('0x' || substr(sha256(url), 1, 8))::BIGINT % 16 AS shard, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def hash_shard(spark, sf):
    return table(spark, sf, "pages").groupBy(S.hash_shard("url", 16).cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'AB' || (p_partkey % 1000) || 'C' WHEN p_partkey % 3 = 1 THEN 'T' || (p_partkey % 100000) END AS code FROM part""")
def object_codes(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit(" ab - "), k % 1000, F.lit("c"))).when(k % 3 == 1, F.concat(F.lit("t_"), k % 100000)).otherwise(F.concat(F.lit("not a code "), k))
    return table(spark, sf, "part").select("p_partkey", S.object_code(text).alias("code"))


@query("""WITH s AS (SELECT p_brand AS brand, p_type AS kind, p_partkey, p_size FROM part),
g AS (SELECT brand, kind, count(DISTINCT p_size % 3) AS d, count(*) AS n, max(p_size) AS top FROM s GROUP BY ALL)
SELECT brand, kind, n, CASE WHEN d > 1 THEN NULL ELSE top END AS agreed, d > 1 AS conflict FROM g""")
def schedule_code_join(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("code"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "p_size")
    s = D.schedule_values(p.select("code", (F.col("p_size") % 3).alias("value"), F.col("p_size").alias("shown")), "code", "value", "shown")
    return D.schedule_join(p.select("code", "brand", "kind").distinct(), s, "code").select("brand", "kind", "n", "agreed", "conflict")


# ---------------------------------------------------------------- spatial joins on synthesised boxes

def _boxes(df, key, fam, wide=997, high=991):
    k = F.col(key)
    x, z = (k * 37 % wide).cast("double"), (k * 91 % high).cast("double")
    return df.select(k.alias("id"), x.alias("min_x"), z.alias("min_z"), (x + 4 + k % 5).alias("max_x"), (z + 4 + k % 7).alias("max_z"), fam.alias("family"))


_BOX = "{k} AS id, ({k} * 37 % 997)::DOUBLE AS min_x, ({k} * 91 % 991)::DOUBLE AS min_z, ({k} * 37 % 997)::DOUBLE + 4 + {k} % 5 AS max_x, ({k} * 91 % 991)::DOUBLE + 4 + {k} % 7 AS max_z, CASE WHEN {k} % 3 = 0 THEN 'line' ELSE 'area' END AS family"
_SCORE = """SELECT l.id AS l_id, r.id AS r_id, greatest(0, least(1, {w0} * least(1.0, greatest(0, least(l.max_x, r.max_x) - greatest(l.min_x, r.min_x)) * greatest(0, least(l.max_z, r.max_z) - greatest(l.min_z, r.min_z)) / greatest(0.01, least((l.max_x - l.min_x) * (l.max_z - l.min_z), (r.max_x - r.min_x) * (r.max_z - r.min_z))))
 + {w1} * greatest(0, 1 - sqrt(pow((l.min_x + l.max_x) / 2 - (r.min_x + r.max_x) / 2, 2) + pow((l.min_z + l.max_z) / 2 - (r.min_z + r.max_z) / 2, 2)) / greatest(8, sqrt(pow(l.max_x - l.min_x, 2) + pow(l.max_z - l.min_z, 2)), sqrt(pow(r.max_x - r.min_x, 2) + pow(r.max_z - r.min_z, 2))))
 + {w2} * least((l.max_x - l.min_x) * (l.max_z - l.min_z), (r.max_x - r.min_x) * (r.max_z - r.min_z)) / greatest((l.max_x - l.min_x) * (l.max_z - l.min_z), (r.max_x - r.min_x) * (r.max_z - r.min_z)) + {w3} * CASE WHEN l.family = r.family THEN 1.0 ELSE {o} END))::DOUBLE AS score
 FROM l, r WHERE l.min_x <= r.max_x + 20 AND l.max_x >= r.min_x - 20 AND l.min_z <= r.max_z + 20 AND l.max_z >= r.min_z - 20"""


def _match_sql(minimum, gap, w, other):
    score = _SCORE.format(**{f"w{i}": f"{x}::DOUBLE" for i, x in enumerate(w)}, o=other)
    return f"""WITH l AS (SELECT {_BOX.format(k='p_partkey')} FROM part), r AS (SELECT {_BOX.format(k='(s_suppkey * 3 + 1)')} FROM supplier), s AS ({score}),
k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn, lead(score) OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS second FROM s)
SELECT CASE WHEN score < {minimum} THEN 'below-score-gate' WHEN second IS NOT NULL AND score - second < {gap} THEN 'ambiguous' ELSE 'accepted' END AS status, count(*) AS n, sum(r_id) AS targets, round(sum(score), 6) AS total FROM k WHERE rn = 1 AND score >= 0.35 GROUP BY 1"""


def _matched(spark, sf, minimum, gap, **score):
    fam = lambda k: F.when(k % 3 == 0, "line").otherwise("area")
    left = _boxes(table(spark, sf, "part"), "p_partkey", fam(F.col("p_partkey"))).withColumnRenamed("id", "l_id")
    sup = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("k"))
    right = _boxes(sup, "k", fam(F.col("k"))).withColumnRenamed("id", "r_id")
    m = J.match_boxes(left, right, "l_id", "r_id", 16.0, minimum, gap, **score)
    return m.where("score >= 0.35").groupBy("status").agg(F.count("*").alias("n"), F.sum("r_id").alias("targets"), F.round(F.sum("score"), 6).alias("total"))


@query(_match_sql(0.66, 0.08, (0.43, 0.29, 0.18, 0.10), 0.55))
def spatial_top1_match(spark, sf):
    return _matched(spark, sf, 0.66, 0.08)


@query(_match_sql(0.70, 0.08, (0.46, 0.29, 0.17, 0.08), 0.5))
def changeset_match(spark, sf):
    return _matched(spark, sf, 0.70, 0.08, weights=(0.46, 0.29, 0.17, 0.08), other_family=0.5)


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey * 53 % 499)::DOUBLE AS x, (c_custkey * 29 % 491)::DOUBLE AS z FROM customer), s AS (SELECT s_suppkey AS sid, (s_suppkey * 17 % 499)::DOUBLE AS x, (s_suppkey * 71 % 491)::DOUBLE AS z FROM supplier),
d AS (SELECT id, sid, sqrt(pow(c.x - s.x, 2) + pow(c.z - s.z, 2)) AS distance FROM c, s WHERE abs(c.x - s.x) <= 12 AND abs(c.z - s.z) <= 12 AND sqrt(pow(c.x - s.x, 2) + pow(c.z - s.z, 2)) <= 12),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, sid) AS rn, lead(distance) OVER (PARTITION BY id ORDER BY distance, sid) AS second FROM d)
SELECT id, sid, round(distance, 9) AS distance, CASE WHEN second IS NOT NULL AND second - distance < 1.5 THEN 'ambiguous' ELSE 'accepted' END AS status FROM k WHERE rn = 1""")
def point_asof_space(spark, sf):
    at = lambda df, k, a, b, name: table(spark, sf, df).select(F.col(k).alias(name), (F.col(k) * a % 499).cast("double").alias("x"), (F.col(k) * b % 491).cast("double").alias("z"))
    m = J.nearest_point(at("customer", "c_custkey", 53, 29, "id"), at("supplier", "s_suppkey", 17, 71, "sid"), "id", "sid")
    return m.select("id", "sid", F.round("distance", 9).alias("distance"), "status")


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey % 20 AS line, (p_partkey * 7 % 200)::DOUBLE AS x, (p_partkey * 3 % 40)::DOUBLE AS z FROM part), g AS (SELECT (s_suppkey * 11 % 200)::DOUBLE AS ax, (s_suppkey % 40)::DOUBLE AS az, (s_suppkey * 11 % 200)::DOUBLE + 9 AS bx, (s_suppkey % 40)::DOUBLE + s_suppkey % 3 AS bz FROM supplier),
d AS (SELECT s.line, s.x, s.z, count(*) AS m, max(CASE WHEN sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(z - (az + t * (bz - az)), 2)) <= 2 THEN 1 ELSE 0 END) AS hit FROM (SELECT s.*, g.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / (pow(bx - ax, 2) + pow(bz - az, 2)))) AS t FROM s, g) s GROUP BY ALL),
f AS (SELECT s.line, avg(hit)::DOUBLE AS fraction FROM s JOIN d USING (line, x, z) GROUP BY 1)
SELECT line, round(fraction, 9) AS fraction, CASE WHEN fraction >= 0.8 THEN 'duplicate' WHEN fraction >= 0.2 THEN 'partial-overlap' ELSE 'accept' END AS decision FROM f""")
def line_overlap_dedupe(spark, sf):
    k, n = F.col("p_partkey"), F.col("s_suppkey")
    s = table(spark, sf, "part").select((k % 20).alias("line"), (k * 7 % 200).cast("double").alias("x"), (k * 3 % 40).cast("double").alias("z"))
    ax, az = (n * 11 % 200).cast("double"), (n % 40).cast("double")
    g = table(spark, sf, "supplier").select(ax.alias("ax"), az.alias("az"), (ax + 9).alias("bx"), (az + n % 3).alias("bz"))
    f = J.overlap_fraction(s, g, "line", 2.0)
    return f.select("line", F.round("fraction", 9).alias("fraction"), J.overlap_decision(F.col("fraction")).alias("decision"))


@query(f"""WITH b AS (SELECT {_BOX.format(k='p_partkey').replace('997', '199').replace('991', '197')} FROM part), p AS (SELECT l.id AS a, r.id AS b, greatest(0, least(l.max_x, r.max_x) - greatest(l.min_x, r.min_x)) * greatest(0, least(l.max_z, r.max_z) - greatest(l.min_z, r.min_z)) AS i, (l.max_x - l.min_x) * (l.max_z - l.min_z) AS x, (r.max_x - r.min_x) * (r.max_z - r.min_z) AS y FROM b l, b r WHERE l.id < r.id AND l.min_x <= r.max_x AND l.max_x >= r.min_x AND l.min_z <= r.max_z AND l.max_z >= r.min_z)
SELECT a, b, round(i / (x + y - i), 9) AS iou FROM p WHERE i / (x + y - i) >= 0.3""")
def box_overlap_iou(spark, sf):
    b = _boxes(table(spark, sf, "part"), "p_partkey", F.lit("area"), 199, 197).drop("family")
    p = J.iou_pairs(b, b, 0.3, once="id")
    iou = G.box_iou({k: F.col(f"l.{k}") for k in J.BOX}, {k: F.col(f"r.{k}") for k in J.BOX})
    return p.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(iou, 9).alias("iou"))


# ---------------------------------------------------------------- edits, time, collisions

@query("""SELECT l_orderkey, count(*) AS n, max(l_shipdate)::VARCHAR AS last_seen FROM lineitem JOIN (SELECT o_orderkey, max(o_orderdate) AS d FROM orders GROUP BY 1) ON l_orderkey = o_orderkey WHERE l_shipdate > d GROUP BY 1""")
def post_decision_join(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey"), "l_shipdate")
    p = U.after_decision(seen, table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey", "l_shipdate", "o_orderdate")
    return p.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3) UNION ALL SELECT o_orderkey + 100000000, 'R' FROM orders WHERE o_orderkey % 10 = 3""")
def replace_merge(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = o.where("id % 10 = 3").select((F.col("id") + 100000000).alias("id"), F.lit("R").alias("status"), F.col("id").alias("replaces"))
    return U.replace_rows(o, new, "id", "replaces")


@query("""WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT CASE WHEN id % 7 IN (2, 3) THEN id + 200000000 ELSE id END AS id, CASE WHEN id % 7 = 1 THEN 'X' WHEN id % 7 IN (2, 3) THEN 'Y' ELSE s END AS status, CASE WHEN id % 7 IN (2, 3) THEN NULL ELSE p END AS priority, CASE id % 7 WHEN 1 THEN 'retagged' WHEN 2 THEN 'replaced' WHEN 3 THEN 'replaced' ELSE 'kept' END AS action FROM b WHERE id % 7 != 0
UNION ALL SELECT id + 300000000, 'Z', NULL, 'added' FROM b WHERE id % 7 = 4""")
def retag_merge(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    base = o.select(k.alias("id"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("tags"))
    tag = lambda v: F.create_map(F.lit("status"), F.lit(v)).alias("tags")
    m = F.col("o_orderkey") % 7
    edits = (
        o.where(m == 0).select((k + 400000000).alias("edit_id"), F.lit("delete").alias("operation"), k.alias("target"), tag("W"))
        .union(o.where(m == 1).select(k + 100000000, F.lit("retag"), k, tag("X"))).union(o.where(m == 2).select(k + 200000000, F.lit("replace"), k, tag("Y")))
        .union(o.where(m == 3).select(k + 200000000, F.lit("auto"), k, tag("Y"))).union(o.where(m == 4).select(k + 300000000, F.lit("replace"), -k - 1, tag("Z")))
    )
    r = U.apply_edits(base, edits)
    return r.select("id", F.try_element_at("tags", F.lit("status")).alias("status"), F.try_element_at("tags", F.lit("priority")).alias("priority"), "action")


@query("""WITH t AS (SELECT l_partkey * 10 + l_linenumber AS target, l_orderkey * 10 + l_linenumber AS id, floor(l_quantity / 26)::BIGINT AS sig, l_extendedprice AS score FROM lineitem),
g AS (SELECT target, count(DISTINCT sig) AS d, count(*) AS n FROM t GROUP BY 1), k AS (SELECT t.*, d, n, row_number() OVER (PARTITION BY target ORDER BY score DESC, id) AS rn FROM t JOIN g USING (target))
SELECT action, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT id, CASE WHEN n = 1 THEN 'keep' WHEN d > 1 THEN 'review' WHEN rn = 1 THEN 'keep' ELSE 'ignored' END AS action FROM k) GROUP BY 1""")
def target_collision(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_quantity") / 26).alias("sig"), F.col("l_extendedprice").alias("score"))
    return U.resolve_collisions(t, "target", "sig", "score", "id").groupBy("action").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""WITH t AS (SELECT p_brand AS grp, unnest([{'k': 'type', 'v': p_type}, {'k': 'size', 'v': (p_size // 60)::VARCHAR}, {'k': 'brand', 'v': p_brand}]) AS kv FROM part), g AS (SELECT grp, kv.k AS k, count(DISTINCT kv.v) AS d, min(kv.v) AS v FROM t GROUP BY ALL)
SELECT grp, string_agg(k || '=' || v, ';' ORDER BY k) FILTER (d = 1) AS agreed, coalesce(string_agg(k, ';' ORDER BY k) FILTER (d > 1), '') AS conflicts FROM g GROUP BY 1""")
def tag_inheritance(spark, sf):
    tags = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.floor(F.col("p_size") / 60).cast("string"), F.lit("brand"), "p_brand")
    r = U.inherit_tags(table(spark, sf, "part").select(F.col("p_brand").alias("grp"), tags.alias("tags")), "grp")
    agreed = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return r.select("grp", agreed.alias("agreed"), F.array_join("conflicts", ";").alias("conflicts"))


_PROV = """WITH p AS (SELECT 'n' || n_nationkey AS provider_id, r_name AS kind, -60.0 + n_nationkey * 3 AS south, -20.0 + n_nationkey * 4 AS north, CASE WHEN n_nationkey % 4 = 0 THEN 150.0 ELSE -90.0 + n_nationkey * 5 END AS west, CASE WHEN n_nationkey % 4 = 0 THEN -30.0 ELSE 20.0 + n_nationkey * 5 END AS east,
 (n_nationkey % 7) / 6.0 AS authority, (n_nationkey % 5) / 4.0 AS freshness, (n_nationkey % 3) / 2.0 AS directness, (n_nationkey % 6) / 5.0 AS completeness, CASE WHEN n_nationkey % 8 = 0 THEN NULL ELSE n_nationkey % 8 * 2.0 END AS res, n_nationkey % 9 = 0 AS sparse, n_nationkey % 10 = 1 AS discovery, n_nationkey % 2 = 0 AS implemented FROM nation JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT *, greatest(0, least(30.0, north) - greatest(-10.0, south)) AS high, CASE WHEN west <= east THEN greatest(0, least(east, 40.0) - greatest(west, -50.0)) ELSE greatest(0, least(180.0, 40.0) - greatest(west, -50.0)) + greatest(0, least(east, 40.0) - greatest(-180.0, -50.0)) END AS wide FROM p),
r AS (SELECT *, floor(greatest(0, least(1, high * least(90.0, wide) / 3600.0))::DOUBLE * 10000 + 0.5) / 10000 AS ratio FROM o),
s AS (SELECT *, floor(greatest(0, least(1, ratio * 0.26::DOUBLE + authority * 0.21::DOUBLE + freshness * 0.12::DOUBLE + directness * 0.12::DOUBLE + completeness * 0.2::DOUBLE + (CASE WHEN res > 0 THEN least(1.0, 5.0 / greatest(5.0, res)) ELSE 0.45 END)::DOUBLE * 0.09::DOUBLE - CASE WHEN sparse THEN 0.12 ELSE 0 END::DOUBLE - CASE WHEN discovery THEN 0.05 ELSE 0 END::DOUBLE))::DOUBLE * 10000 + 0.5) / 10000 AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, coalesce(res, 'infinity'::DOUBLE), provider_id) AS rn FROM s WHERE ratio > 0 AND score >= 0.2)"""


def _providers(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    d = lambda c: c.cast("double")
    p = n.select(
        F.concat(F.lit("n"), k).alias("provider_id"), F.col("r_name").alias("kind"), d(-60 + k * 3).alias("south"), d(-20 + k * 4).alias("north"), F.when(k % 4 == 0, 150.0).otherwise(d(-90 + k * 5)).alias("west"), F.when(k % 4 == 0, -30.0).otherwise(d(20 + k * 5)).alias("east"),
        (k % 7 / 6.0).alias("authority"), (k % 5 / 4.0).alias("freshness"), (k % 3 / 2.0).alias("directness"), (k % 6 / 5.0).alias("completeness"), F.when(k % 8 != 0, d(k % 8 * 2)).alias("resolution_m"), (k % 9 == 0).alias("sparse"), (k % 10 == 1).alias("discovery"), (k % 2 == 0).alias("implemented"))
    return U.provider_scores(p, {"south": -10, "north": 30, "west": -50, "east": 40})


@query(_PROV + " SELECT provider_id, kind, ratio AS coverage_ratio, score FROM k WHERE rn <= 5")
def provider_plan(spark, sf):
    w = Window.partitionBy("kind").orderBy(F.col("score").desc(), F.coalesce("resolution_m", F.lit(float("inf"))), "provider_id")
    return _providers(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("provider_id", "kind", "coverage_ratio", "score")


@query(_PROV + """, g AS (SELECT kind, min_by(provider_id, rn) AS recommended, min_by(provider_id, rn) FILTER (implemented) AS selected, count(*) AS candidates FROM k WHERE rn <= 5 GROUP BY 1)
SELECT w.kind, recommended, selected, coalesce(candidates, 0) AS candidates, CASE WHEN selected IS NOT NULL THEN NULL WHEN recommended IS NOT NULL THEN 'adapter-not-implemented' ELSE 'no-provider-with-bbox-coverage' END AS gap FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('ATLANTIS')) w(kind) LEFT JOIN g USING (kind)""")
def source_gaps(spark, sf):
    return U.source_plan(_providers(spark, sf), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "ATLANTIS"])


# ---------------------------------------------------------------- aggregates and ordered analytics

@query("""SELECT l_partkey, quantile_cont(l_quantity, 0.65) AS p65, quantile_cont(l_quantity, 0.9) - quantile_cont(l_quantity, 0.1) AS spread, median(l_quantity) AS med, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 4""")
def height_percentiles(spark, sf):
    return O.spread_of(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", least=4)


@query("""WITH b AS (SELECT l_suppkey AS k, floor(l_quantity / 2 / 0.5 + 0.5)::BIGINT AS bin, median(l_quantity / 2) AS elevation, count(*) AS n, avg(CASE WHEN l_linenumber IN (0, 1) THEN 1.0 ELSE 0.0 END)::DOUBLE AS u FROM lineitem GROUP BY ALL),
q AS (SELECT k, bin, elevation, n, log2(n + 1) * 1.35::DOUBLE + u * 0.35::DOUBLE AS quality FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY quality DESC, bin) AS rn FROM q)
SELECT k, rn, elevation, n, round(quality, 9) AS quality FROM r WHERE rn <= 8""")
def height_bins_topk(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_quantity") / 2).alias("z"), F.col("l_linenumber").alias("c"))
    return O.height_clusters(p, ["k"], "z", "c").select("k", "rn", "elevation", "n", F.round("quality", 9).alias("quality"))


@query("""SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS coverage FROM orders GROUP BY 1""")
def weighted_coverage(spark, sf):
    return O.weighted_share(table(spark, sf, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_totalprice"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 300 AS x FROM lineitem), i AS (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM d) SELECT k, min(x) AS x0, max(x) AS x1, count(*) AS n FROM i GROUP BY k, g""")
def row_runs(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 300).alias("x"))
    return O.runs(d, ["k"], "x")


@query("""SELECT floor((c_custkey - 700) / 16.0)::BIGINT AS cx, floor((c_custkey * 31 % 1009 - 500) / 16.0)::BIGINT AS cz, count(*) AS n FROM customer GROUP BY ALL""")
def chunk_keys(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") - 700).alias("x"), (F.col("c_custkey") * 31 % 1009 - 500).alias("z"))
    return K.chunk_keys(c).groupBy("cx", "cz").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT s_suppkey AS id, s_suppkey * 13 % 200 - 100 AS x1, s_suppkey * 7 % 200 - 100 AS z1, s_suppkey * 13 % 200 - 100 + s_suppkey % 40 AS x2, s_suppkey * 7 % 200 - 100 + s_suppkey % 33 AS z2 FROM supplier),
s AS (SELECT id, cx, cz, greatest(x1, cx * 16) AS a, least(x2, cx * 16 + 15) AS b, greatest(z1, cz * 16) AS c, least(z2, cz * 16 + 15) AS d FROM (SELECT *, unnest(range(floor(z1 / 16.0)::BIGINT, floor(z2 / 16.0)::BIGINT + 1)) AS cz FROM (SELECT *, unnest(range(floor(x1 / 16.0)::BIGINT, floor(x2 / 16.0)::BIGINT + 1)) AS cx FROM b)))
SELECT id, count(*) AS boxes, sum((b - a + 1) * (d - c + 1))::BIGINT AS cells FROM s GROUP BY 1""")
def split_boxes(spark, sf):
    k = F.col("s_suppkey")
    x, z = k * 13 % 200 - 100, k * 7 % 200 - 100
    b = table(spark, sf, "supplier").select(k.alias("id"), x.alias("x1"), z.alias("z1"), (x + k % 40).alias("x2"), (z + k % 33).alias("z2"))
    return K.split_boxes(b).groupBy("id").agg(F.count("*").alias("boxes"), F.sum((F.col("x2") - F.col("x1") + 1) * (F.col("z2") - F.col("z1") + 1)).alias("cells"))


@query("""WITH s AS (SELECT user_id, event_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events JOIN (SELECT event_id AS e2, ts AS t2 FROM events) ON event_id = e2)
SELECT user_id, round(sum(step), 6) AS total, count(*) AS n FROM s GROUP BY 1""")
def chainage(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = O.chainage(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.abs(F.col("value") - F.lag("value").over(w)))
    return c.groupBy("user_id").agg(F.round(F.max("chainage"), 6).alias("total"), F.count("*").alias("n"))


_POS = "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3)::DOUBLE AS pos, CASE WHEN event_id % 3 = 0 THEN value END AS v, 0.8::DOUBLE AS c FROM events"


def _profile(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", (F.row_number().over(w) * 3).cast("double").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"), F.lit(0.8).alias("c"))


@query(f"""WITH p AS ({_POS}), n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS a, min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p),
j AS (SELECT n.*, x.v AS va, y.v AS vb FROM n LEFT JOIN p x ON x.user_id = n.user_id AND x.pos = n.a LEFT JOIN p y ON y.user_id = n.user_id AND y.pos = n.b)
SELECT user_id, pos, round(CASE WHEN v IS NOT NULL THEN v WHEN b - a <= 12 THEN va + (vb - va) * ((pos - a) / (b - a)) END, 9) AS filled, CASE WHEN v IS NOT NULL THEN 'measured' WHEN b - a <= 12 THEN 'interpolated' ELSE 'unknown' END AS evidence FROM j""")
def gap_interpolation(spark, sf):
    return O.fill_short_gaps(_profile(spark, sf), ["user_id"], "at", "v", "c").select("user_id", F.col("at").alias("pos"), F.round("filled", 9).alias("filled"), "evidence")


@query("""WITH t AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), d AS (SELECT t.*, floor((run + 1e-6 - 100) / 200) AS due FROM t), l AS (SELECT *, lag(due, 1, -1) OVER (PARTITION BY user_id ORDER BY run, event_id) AS before FROM d)
SELECT user_id, event_id FROM l WHERE due >= 0 AND due > before""")
def support_spacing(spark, sf):
    c = O.chainage(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value"))
    return O.spaced(c, ["user_id"], ["chainage", "event_id"], "chainage", 200.0).select("user_id", "event_id")


@query(f"""WITH p AS ({_POS.replace('CASE WHEN event_id % 3 = 0 THEN value END', 'value')}), g AS (SELECT user_id, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY pos)) / 3 AS g FROM p), q AS (SELECT user_id, quantile_cont(g, 0.9) AS p90, max(g) AS m FROM g GROUP BY 1)
SELECT user_id, round(p90, 9) AS p90, round(m, 9) AS max_grade, CASE WHEN p90 > 16 THEN 'steep' WHEN p90 > 8.3 THEN 'ramp' ELSE 'level' END AS terrain FROM q""")
def terrain_grade(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select("user_id", (F.row_number().over(w) * 3).cast("double").alias("at"), (F.col("value") / 100).alias("v"))
    g = O.terrain_grade(p, ["user_id"], "at", "v")
    return g.select("user_id", F.round("p90", 9).alias("p90"), F.round("max_grade", 9).alias("max_grade"), "terrain")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || (s_suppkey % 40) AS a, 'c' || (s_suppkey * 7 % 60) AS b FROM supplier), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS lab FROM n UNION SELECT n.y, r.lab FROM r JOIN n ON n.x = r.node)
SELECT node, min(lab) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    k = F.col("s_suppkey")
    e = table(spark, sf, "supplier").select(F.concat(F.lit("s"), k % 40).alias("src"), F.concat(F.lit("c"), k * 7 % 60).alias("dst"))
    return connected_components(e)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT 's' || s AS node, count(*) AS degree FROM e GROUP BY 1 UNION ALL SELECT 'p' || p, count(*) FROM e GROUP BY 1) SELECT degree, count(*) AS nodes, count(*) FILTER (degree = 1) AS dangling FROM d GROUP BY 1""")
def degrees(spark, sf):
    e = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    d = node_degrees(e.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))
    return d.groupBy("degree").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 1).alias("dangling"))


@query("""WITH p AS (SELECT n_nationkey AS id, -5.0 + n_nationkey * 0.01 AS lon, 51.0 + n_nationkey * 0.003 AS lat FROM nation) SELECT id, round((lon + 5.0)::DOUBLE * (pi() / 180 * 6378137 * cos(51.0 * pi() / 180)), 6) AS x, round((51.0 - lat)::DOUBLE * (pi() / 180 * 6378137), 6) AS z, floor((lon::DOUBLE + 180) / 360 * 4096)::BIGINT AS tx, floor((1 - ln(tan(radians(lat::DOUBLE)) + 1 / cos(radians(lat::DOUBLE))) / pi()) / 2 * 4096)::BIGINT AS ty FROM p""")
def bbox_project(spark, sf):
    k = F.col("n_nationkey")
    lon, lat = (-5.0 + k * 0.01), (51.0 + k * 0.003)
    return table(spark, sf, "nation").select(k.alias("id"), F.round(S.project_x(lon, -5.0, 51.0), 6).alias("x"), F.round(S.project_z(lat, 51.0), 6).alias("z"), S.tile_x(lon, 12).cast("bigint").alias("tx"), S.tile_y(lat, 12).cast("bigint").alias("ty"))


_PALETTE = {"stone": (125, 125, 125), "brick": (150, 97, 83), "sand": (219, 207, 163), "oak": (162, 130, 78), "grass": (94, 157, 52), "water": (63, 118, 228), "snow": (249, 254, 254), "coal": (16, 16, 16)}


@query("""WITH pal(block, r, g, b) AS (VALUES ('stone', 125, 125, 125), ('brick', 150, 97, 83), ('sand', 219, 207, 163), ('oak', 162, 130, 78), ('grass', 94, 157, 52), ('water', 63, 118, 228), ('snow', 249, 254, 254), ('coal', 16, 16, 16)),
c AS (SELECT p_partkey AS id, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part), u AS (SELECT id, NULL AS block, r, g, b FROM c UNION ALL SELECT NULL, block, r, g, b FROM pal),
lin AS (SELECT id, block, CASE WHEN r / 255.0 > 0.04045 THEN pow((r / 255.0 + 0.055) / 1.055, 2.4) ELSE r / 255.0 / 12.92 END AS r, CASE WHEN g / 255.0 > 0.04045 THEN pow((g / 255.0 + 0.055) / 1.055, 2.4) ELSE g / 255.0 / 12.92 END AS g, CASE WHEN b / 255.0 > 0.04045 THEN pow((b / 255.0 + 0.055) / 1.055, 2.4) ELSE b / 255.0 / 12.92 END AS b FROM u),
xyz AS (SELECT id, block, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047 AS x, r * 0.2126729 + g * 0.7151522 + b * 0.0721750 AS y, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883 AS z FROM lin),
f AS (SELECT id, block, CASE WHEN x > 0.008856 THEN pow(x, 1.0 / 3) ELSE 7.787 * x + 16.0 / 116 END AS x, CASE WHEN y > 0.008856 THEN pow(y, 1.0 / 3) ELSE 7.787 * y + 16.0 / 116 END AS y, CASE WHEN z > 0.008856 THEN pow(z, 1.0 / 3) ELSE 7.787 * z + 16.0 / 116 END AS z FROM xyz),
lab AS (SELECT id, block, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f),
d AS (SELECT p.id, q.block, sqrt(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) AS de FROM lab p, lab q WHERE p.id IS NOT NULL AND q.block IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY de, block) AS rn FROM d)
SELECT id, rn, block, round(de, 4) AS de FROM k WHERE rn <= 3""")
def nearest_palette(spark, sf):
    k = F.col("p_partkey")
    near = A.nearest_blocks(*[(k * m % 256).cast("double") for m in (7, 13, 29)], _PALETTE)
    p = table(spark, sf, "part").select(k.alias("id"), F.posexplode(near).alias("at", "n"))
    return p.select("id", (F.col("at") + 1).alias("rn"), "n.block", F.round("n.de", 4).alias("de"))


@query("""WITH o AS (SELECT l_partkey % 50 AS x, l_suppkey % 20 AS y, l_linenumber AS z, l_orderkey % 4 AS phase, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS block FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY phase DESC, seq DESC) AS rn FROM o) SELECT x, y, z, block, phase FROM k WHERE rn = 1""")
def voxel_last_writer(spark, sf):
    o = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 20).alias("y"), F.col("l_linenumber").alias("z"), (F.col("l_orderkey") % 4).alias("phase"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("block"))
    return R.last_writer(o)


@query("""WITH o AS (SELECT l_partkey % 50 AS x, l_suppkey % 20 AS y, l_linenumber AS z, max((l_orderkey % 4) * 1000000000 + l_orderkey) // 1000000000 AS phase FROM lineitem GROUP BY ALL), t AS (SELECT x, z, max(y) AS top FROM o WHERE phase <= 1 GROUP BY ALL)
SELECT CASE WHEN top IS NULL THEN 'no-terrain' WHEN y <= top THEN 'below-terrain' ELSE 'accepted' END AS status, count(*) AS n FROM o LEFT JOIN t USING (x, z) GROUP BY 1""")
def overlay_above_terrain(spark, sf):
    c = voxel_last_writer(spark, sf)
    return R.above_terrain(c, R.terrain_top(c)).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT (o_orderkey % 40) AS x, (o_orderkey // 40 % 40) AS z, max(o_totalprice) AS value FROM orders GROUP BY ALL) SELECT c.x, c.z, count(*) AS n, median(d.value) AS med FROM c JOIN c d ON abs(c.x - d.x) <= 1 AND abs(c.z - d.z) <= 1 AND NOT (c.x = d.x AND c.z = d.z) GROUP BY ALL""")
def neighbour_median(spark, sf):
    c = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("x"), (F.floor(F.col("o_orderkey") / 40) % 40).alias("z")).agg(F.max("o_totalprice").alias("value"))
    return R.neighbours(c, []).groupBy("x", "z").agg(F.count("*").alias("n"), F.median("near").alias("med"))


@query("""WITH l AS (SELECT p_partkey % 99 AS f, p_size % 5 AS page, CASE p_partkey % 4 WHEN 0 THEN 'FFL' WHEN 1 THEN 'Ridge' WHEN 2 THEN 'gl' ELSE 'eaves' END AS label, (p_partkey % 60)::DOUBLE AS v, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0 END AS c FROM part),
p AS (SELECT f, page, median(v) FILTER (label IN ('FFL', 'gl')) AS b, max(v) FILTER (label IN ('Ridge', 'eaves')) AS t, min(coalesce(c, 0.8))::DOUBLE AS c FROM l GROUP BY ALL), k AS (SELECT f, page, t - b AS h, c * 0.92::DOUBLE AS conf, row_number() OVER (PARTITION BY f ORDER BY c DESC, t - b DESC, page) AS rn FROM p WHERE t - b BETWEEN 1.5 AND 100)
SELECT f AS feature_id, h AS height, round(conf, 9) AS confidence, page FROM k WHERE rn = 1""")
def level_heights(spark, sf):
    k = F.col("p_partkey")
    label = F.element_at(F.array(*map(F.lit, ["FFL", "Ridge", "gl", "eaves"])), (k % 4 + 1).cast("int"))
    d = table(spark, sf, "part").select((k % 99).alias("feature_id"), (F.col("p_size") % 5).alias("page"), label.alias("label"), (k % 60).cast("double").alias("value_m"), F.when(k % 5 != 0, k % 10 / 10.0).alias("confidence"))
    return U.level_heights(d).select("feature_id", "height", F.round("confidence", 9).alias("confidence"), "page")


@query("""SELECT count(*) AS n, count(*) FILTER (l_shipdate >= TIMESTAMP '1995-01-01') AS recent FROM lineitem""")
def uk_dates(spark, sf):
    british = F.date_format("l_shipdate", "dd/MM/yyyy")
    return table(spark, sf, "lineitem").select(S.uk_or_iso_date(british).alias("d")).agg(F.count("d").alias("n"), F.count_if(F.col("d") >= F.lit("1995-01-01").cast("timestamp")).alias("recent"))


@query("""WITH w AS (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM benchmark) SELECT item_id, (1 + 8 * (n % 4) + 2 * (n % 3) + 2 * (n % 2) + 0.02 * n)::DOUBLE AS weight FROM w""")
def page_weights(spark, sf):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return table(spark, sf, "benchmark").select("item_id", K.page_weight(n % 4, n % 3, n % 2, n).cast("double").alias("weight"))


# ---------------------------------------------------------------- reconciliation

_LIFE = "CASE p_partkey % 7 WHEN 0 THEN 'current' WHEN 1 THEN 'proposed' WHEN 2 THEN 'refused' WHEN 3 THEN 'current' WHEN 4 THEN 'proposed' WHEN 5 THEN NULL ELSE 'superseded' END"


@query(f"""WITH e AS (SELECT p_partkey % 400 AS k, CASE WHEN p_partkey % 400 < 250 AND p_partkey % 7 IN (2, 6) THEN 'current' ELSE {_LIFE} END AS state, (50 + p_partkey % 50) / 100.0::DOUBLE AS c, p_partkey % 3 = 0 AS title FROM part),
g AS (SELECT k, max(c) FILTER (state IN ('refused', 'superseded')) AS x, arg_max(state, c * 1000 + CASE state WHEN 'superseded' THEN 0.5 ELSE 0 END) FILTER (state IN ('refused', 'superseded')) AS xs, max(c) FILTER (state = 'current') AS cur, max(c) FILTER (state = 'proposed') AS pro, max(c) FILTER (state = 'current' AND title) AS t FROM e GROUP BY 1)
SELECT k, CASE WHEN x IS NOT NULL THEN xs WHEN cur IS NOT NULL AND pro IS NOT NULL THEN CASE WHEN t >= 0.95 AND t >= cur THEN 'current' ELSE 'unknown' END WHEN cur IS NOT NULL THEN 'current' WHEN pro IS NOT NULL THEN 'proposed' ELSE 'unknown' END AS state,
 CASE WHEN x IS NOT NULL THEN x WHEN cur IS NOT NULL AND pro IS NOT NULL THEN CASE WHEN t >= 0.95 AND t >= cur THEN cur ELSE least(cur, pro) END ELSE coalesce(cur, pro, 0.45) END::DOUBLE AS confidence FROM g""")
def lifecycle_combine(spark, sf):
    k = F.col("p_partkey")
    state = F.when((k % 400 < 250) & (k % 7).isin(2, 6), "current").otherwise(F.expr(_LIFE))
    e = table(spark, sf, "part").select((k % 400).alias("k"), state.alias("state"), ((50 + k % 50) / 100.0).alias("confidence"), F.when(k % 3 == 0, "drawing-title-block").otherwise("application").alias("source"))
    return C.combine_lifecycle(e, "k")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 6 AS m FROM part)
SELECT k, CASE m WHEN 0 THEN NULL WHEN 1 THEN floor(greatest(0.5, least(40, s::DOUBLE)) * 10 + 0.5) / 10 WHEN 2 THEN greatest(0.5, least(40, s)) WHEN 3 THEN floor((1 + s % 4) * 3.1::DOUBLE * 10 + 0.5) / 10 WHEN 4 THEN floor((least(40, s) + least(40, s + 2)) / 2.0::DOUBLE * 10 + 0.5) / 10 ELSE NULL END::DOUBLE AS width_m,
 CASE m WHEN 0 THEN 'area-footprint' WHEN 1 THEN 'observed-width' WHEN 2 THEN 'tag-estimate' WHEN 3 THEN 'lanes-derived' WHEN 4 THEN 'variable-width-tagged' ELSE 'unknown-marker' END AS status FROM p""")
def path_widths(spark, sf):
    k, s, m = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    none = F.create_map(F.lit("note"), F.lit("x"))
    tags = (
        F.when(m == 1, F.create_map(F.lit("width"), F.concat(s, F.lit(" m")))).when(m == 2, F.create_map(F.lit("est_width"), s)).when(m == 3, F.create_map(F.lit("lanes"), (1 + F.col("p_size") % 4).cast("string")))
        .when(m == 4, F.create_map(F.lit("width:start"), s, F.lit("width:end"), (F.col("p_size") + 2).cast("string"))).otherwise(none)
    )
    w = C.path_width(tags, F.lit("road"), F.when(m == 0, "area").otherwise("line"))
    return table(spark, sf, "part").select(k.alias("k"), w.alias("w")).select("k", "w.width_m", "w.status")


@query(f"""WITH o AS (SELECT {_BOX.format(k='(s_suppkey * 3 + 1)')} FROM supplier), f AS (SELECT {_BOX.format(k='p_partkey')} FROM part),
p AS (SELECT f.id AS id, greatest(0, least(o.max_x, f.max_x) - greatest(o.min_x, f.min_x)) * greatest(0, least(o.max_z, f.max_z) - greatest(o.min_z, f.min_z)) AS i, (o.max_x - o.min_x) * (o.max_z - o.min_z) AS a, (f.max_x - f.min_x) * (f.max_z - f.min_z) AS b,
 sqrt(pow(greatest(0, greatest(o.min_x, f.min_x) - least(o.max_x, f.max_x)), 2) + pow(greatest(0, greatest(o.min_z, f.min_z) - least(o.max_z, f.max_z)), 2)) AS gap FROM o, f WHERE o.family = f.family AND o.min_x - 3 <= f.max_x AND o.max_x + 3 >= f.min_x AND o.min_z - 3 <= f.max_z AND o.max_z + 3 >= f.min_z),
c AS (SELECT id, max(CASE WHEN i > 0 THEN greatest(i / (a + b - i), 0.9 * i / least(a, b)) WHEN gap <= 3 THEN 0.35 ELSE 0 END) AS c FROM p GROUP BY 1)
SELECT CASE WHEN c >= 0.72 THEN 'superseded' WHEN c >= 0.35 THEN 'ambiguous' ELSE 'kept' END AS action, count(*) AS n, sum(f.id)::BIGINT AS ids FROM f LEFT JOIN c USING (id) GROUP BY 1""")
def official_supersede(spark, sf):
    fam = lambda k: F.when(k % 3 == 0, "line").otherwise("area")
    f = _boxes(table(spark, sf, "part"), "p_partkey", fam(F.col("p_partkey"))).withColumnRenamed("family", "kind").withColumn("name", F.lit(None).cast("string"))
    sup = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("k"))
    o = _boxes(sup, "k", fam(F.col("k"))).withColumnRenamed("family", "kind").withColumn("name", F.lit(None).cast("string"))
    return C.supersede(o, f).groupBy("action").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""WITH c AS (SELECT l_partkey AS k, CASE WHEN l_quantity * 1.0137::DOUBLE BETWEEN 1.5 AND 80 AND l_linenumber != 2 THEN l_quantity * 1.0137::DOUBLE END AS h FROM lineitem), g AS (SELECT k, count(*) AS tried, count(h) AS n, quantile_cont(h, 0.65) AS p65, quantile_cont(h, 0.9) - quantile_cont(h, 0.1) AS sp FROM c GROUP BY 1),
r AS (SELECT *, floor(p65 * 10 + 0.5) / 10 AS h, floor(sp * 10 + 0.5) / 10 AS s, n / tried::DOUBLE AS cov FROM g)
SELECT k, n, CASE WHEN n >= 4 AND cov >= 0.35 THEN h END AS height_m, CASE WHEN n >= 4 AND cov >= 0.35 THEN s END AS spread_m, floor(cov * 1000 + 0.5) / 1000 AS coverage, CASE WHEN n >= 4 AND cov >= 0.35 THEN least(0.99, floor((0.45::DOUBLE + 0.25::DOUBLE * cov + 0.2::DOUBLE * least(1.0, log2(n + 1) / 7) + 0.1::DOUBLE * greatest(0, 1 - s / greatest(6, h))) * 1000 + 0.5) / 1000) END AS confidence,
 CASE WHEN n >= 4 AND cov >= 0.35 THEN 'measured' ELSE 'insufficient-coverage' END AS status FROM r""")
def building_heights(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.lit(0.0).alias("terrain"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") * 1.0137).alias("surface"))
    return C.building_heights(c, "k")


_ROOF = "SELECT o_orderkey % 40 AS x, o_orderkey // 40 % 40 AS z, 0.0::DOUBLE AS terrain, CASE WHEN max(o_orderkey) % 7 = 0 THEN NULL ELSE floor(max(o_totalprice) / 50000) END AS surface FROM orders GROUP BY ALL"


@query(f"""WITH c AS ({_ROOF}), j AS (SELECT c.x, c.z, any_value(c.terrain) AS terrain, any_value(c.surface) AS surface, count(d.surface) AS n, median(d.surface) AS m, count(*) FILTER (abs(d.surface - c.surface) <= 1.25) AS s FROM c LEFT JOIN c d ON abs(c.x - d.x) <= 1 AND abs(c.z - d.z) <= 1 GROUP BY ALL),
e AS (SELECT *, CASE WHEN surface IS NULL AND n >= 3 THEN 'interpolated' WHEN surface IS NULL THEN 'fallback' WHEN n >= 4 AND abs(surface - m) > 2.25 AND s < CASE WHEN n >= 6 THEN 3 ELSE 2 END THEN 'outlier' ELSE 'measured' END AS evidence FROM j)
SELECT x, z, CASE WHEN evidence = 'measured' THEN surface WHEN n >= 3 THEN m ELSE terrain + 4 END AS roof, evidence FROM e""")
def roof_cells(spark, sf):
    c = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("x"), (F.floor(F.col("o_orderkey") / 40) % 40).alias("z")).agg(F.lit(0.0).alias("terrain"), F.when(F.max("o_orderkey") % 7 != 0, F.floor(F.max("o_totalprice") / 50000).cast("double")).alias("surface"))
    return C.roof_cells(c, [])


@query("""WITH s AS (SELECT 'u' || user_id AS ride, CASE WHEN user_id % 4 = 0 OR event_id % (user_id % 4 + 1) > 0 THEN value END AS e, CASE WHEN user_id % 8 = 0 THEN value END AS b FROM events), g AS (SELECT ride, count(*) AS n, count(e) AS v, count(b) AS bb, min(e) AS low, max(e) AS high FROM s GROUP BY 1)
SELECT ride, CASE WHEN v = n AND bb = n THEN 'full-3d-with-banking' WHEN v = n THEN 'full-3d-elevation' WHEN v > 0 THEN 'partial-3d' ELSE '2d-only' END AS status, floor(v / n::DOUBLE * 1000 + 0.5) / 1000 AS vertical_coverage, floor(bb / n::DOUBLE * 1000 + 0.5) / 1000 AS banking_coverage, low, high FROM g""")
def ride_summary(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    s = table(spark, sf, "events").select(F.concat(F.lit("u"), u).alias("feature_id"), F.lit(None).cast("string").alias("name"), F.when((u % 4 == 0) | (e % (u % 4 + 1) > 0), F.col("value")).alias("elevation"), F.when(u % 8 == 0, F.col("value")).alias("banking"), F.lit(0.5).alias("confidence"))
    return C.ride_summary(s).drop("confidence")


@query("""WITH a AS (SELECT p_brand || ':' || p_size AS k, p_partkey % 5 AS f, (60 + p_partkey % 51) / 110.0::DOUBLE AS s, 1 AS n FROM part), g AS (SELECT k, sum(n)::BIGINT AS anchors, count(DISTINCT f) AS features, median(s) AS m FROM a GROUP BY 1)
SELECT k, anchors, features, CASE WHEN anchors >= 4 AND features >= 2 AND m >= 0.78 THEN 'proved' ELSE 'unproved' END AS status, CASE WHEN anchors >= 4 AND features >= 2 AND m >= 0.78 THEN floor(least(0.96, 0.84::DOUBLE + least(0.1, 0.015::DOUBLE * features) + least(0.02, 0.001::DOUBLE * anchors)) * 1000 + 0.5) / 1000 END AS confidence FROM g""")
def application_proof(spark, sf):
    a = table(spark, sf, "part").select(F.concat("p_brand", F.lit(":"), "p_size").alias("k"), (F.col("p_partkey") % 5).alias("feature"), ((60 + F.col("p_partkey") % 51) / 110.0).alias("score"), F.lit(1).alias("n"))
    return C.application_proof(a, "k").drop("median_score")


@query("""WITH f AS (SELECT p_type || '/' || p_brand AS block, min(p_partkey) AS first FROM part GROUP BY 1) SELECT block, row_number() OVER (ORDER BY first, block) - 1 AS palette_id FROM f""")
def palette_ids(spark, sf):
    return C.dense_palette(table(spark, sf, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("block"), "p_partkey"), "block", "p_partkey")


@query("""SELECT p_brand || '/' || p_size AS style, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS value, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1""")
def style_conflicts(spark, sf):
    return C.conflict_keys(table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), "p_size").alias("style"), F.col("p_type").alias("value")), "style", "value")


@query("""WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 != 0), s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 != 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 17 = 0), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1)
SELECT fault, count(*) AS n FROM (SELECT CASE WHEN n.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN n.n > 1 THEN 'duplicate' END AS fault FROM e FULL JOIN n USING (k)) WHERE fault IS NOT NULL GROUP BY 1""")
def shard_coverage(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return K.coverage_faults(c.where("k % 11 != 0"), c.where("k % 13 != 0").union(c.where("k % 17 = 0")), "k").groupBy("fault").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT p_partkey * 7 % 60 AS x, p_partkey * 11 % 61 AS z FROM part WHERE p_size > 12), v AS (SELECT m.x + i AS x, m.z + j AS z, count(*) AS n FROM m, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE NOT (i = 0 AND j = 0) GROUP BY ALL)
SELECT coalesce(m.x, v.x) AS x, coalesce(m.z, v.z) AS z FROM m FULL JOIN v ON m.x = v.x AND m.z = v.z WHERE CASE WHEN m.x IS NOT NULL THEN coalesce(n, 0) > 1 ELSE n >= 6 END""")
def mask_refine(spark, sf):
    m = table(spark, sf, "part").where("p_size > 12").select((F.col("p_partkey") * 7 % 60).alias("x"), (F.col("p_partkey") * 11 % 61).alias("z")).distinct().withColumn("seed", F.lit(False))
    return R.refine_mask(m, []).select("x", "z")


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey * 31 % 4000 - 2000) AS x, (c_custkey * 17 % 3000 - 1500) AS z FROM customer), a AS (SELECT id, ((((x + 4294967296) % 4294967296)::HUGEINT * 374761393) % 4294967296)::BIGINT AS p, ((((z + 4294967296) % 4294967296)::HUGEINT * 668265263) % 4294967296)::BIGINT AS q FROM c),
b AS (SELECT id, xor(xor(p, q), ((5::HUGEINT * 1442695041) % 4294967296)::BIGINT) AS v FROM a), d AS (SELECT id, ((xor(v, v >> 13)::HUGEINT * 1274126177) % 4294967296)::BIGINT AS v FROM b) SELECT id, xor(v, v >> 16) AS noise FROM d""")
def coordinate_noise(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), S.hash_2d(k * 31 % 4000 - 2000, k * 17 % 3000 - 1500, 5).alias("noise"))


@query("""WITH p AS (SELECT user_id AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS pos, event_id, value FROM events), a AS (SELECT k, pos, value AS v FROM p WHERE event_id % 5 = 0),
n AS (SELECT p.k, p.pos, max(CASE WHEN event_id % 5 = 0 THEN pos END) OVER w1 AS lo, min(CASE WHEN event_id % 5 = 0 THEN pos END) OVER w2 AS hi FROM p WINDOW w1 AS (PARTITION BY k ORDER BY pos), w2 AS (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n.k, n.pos, round(CASE WHEN lo = hi THEN x.v WHEN hi > lo THEN x.v + (y.v - x.v) * (n.pos - lo) / (hi - lo) END, 9) AS level FROM n LEFT JOIN a x ON x.k = n.k AND x.pos = lo LEFT JOIN a y ON y.k = n.k AND y.pos = hi""")
def bracket_levels(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.row_number().over(w).cast("double").alias("pos"), "event_id", "value")
    b = O.bracket_levels(p.select("k", "pos"), p.where("event_id % 5 = 0").select("k", "pos", F.col("value").alias("level")), ["k"], "pos", "level")
    return b.select("k", "pos", F.round("bracketed", 9).alias("level"))


@query("""WITH r AS (SELECT p_partkey % 500 AS id, CASE WHEN p_name LIKE '% %' THEN 2 ELSE 1 END AS w FROM part), t(rule_no, pat, name, conf) AS (VALUES (1, 'econ', 'economy', 0.9), (2, 'promo', 'promo', 0.95), (3, 'a', 'generic', 0.5)), h AS (SELECT p_partkey, name, conf, rule_no FROM part, t WHERE regexp_matches(lower(p_type), pat)),
g AS (SELECT * FROM h WHERE NOT (name = 'generic' AND p_partkey IN (SELECT p_partkey FROM h WHERE name = 'economy')))
SELECT name, count(*) AS n, count(*) FILTER (rn = 1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY conf DESC, rule_no) AS rn FROM g) GROUP BY 1""")
def text_rules(spark, sf):
    rules = spark.createDataFrame([(1, "economy", "econ", 0.9, ["generic"]), (2, "promo", "promo", 0.95, []), (3, "generic", "a", 0.5, [])], "rule_no int, name string, pattern string, confidence double, suppresses array<string>")
    m = W.rule_matches(table(spark, sf, "part"), "p_partkey", "p_type", rules)
    return m.groupBy("name").agg(F.count("*").alias("n"), F.count_if("best").alias("best"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 92 WHEN 2 THEN 45 WHEN 3 THEN 20 ELSE 35 END + CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END AS priority FROM part)
SELECT p_partkey AS k, priority, (SELECT count(*) FROM p) > 25000 AS truncated FROM p ORDER BY priority DESC, k LIMIT 25000""")
def document_priority(spark, sf):
    """The document queue, 25,000 by contract, and whether that cut it."""
    k = F.col("p_partkey")
    c = F.element_at(F.array(*map(F.lit, ["site-plan", "elevation", "decision", "unknown", "supporting"])), (k % 5 + 1).cast("int"))
    queue, cut = K.document_queue(table(spark, sf, "part").select(k.alias("k"), W.class_priority(c, k % 3 == 0).alias("priority")), "priority", "k")
    return queue.join(F.broadcast(cut))


@query("""WITH t AS (SELECT p_partkey % 300 AS k, p_size % 4 AS layer, (p_size % 4 + 1) / 2.0::DOUBLE AS resolution, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS value FROM part), m AS (SELECT k, layer, resolution, value, row_number() OVER (PARTITION BY k ORDER BY resolution, layer, value) AS rn FROM t WHERE value IS NOT NULL) SELECT k, value, layer FROM m WHERE rn = 1""")
def raster_mosaic(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select((k % 300).alias("k"), (F.col("p_size") % 4).alias("layer"), ((F.col("p_size") % 4 + 1) / 2.0).alias("resolution"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("value"))
    return D.mosaic(t, ["k"])


@query("""WITH b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 != 0), a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 != 0) SELECT CASE WHEN a.k IS NULL THEN 'removed' ELSE 'added' END AS change, count(*) AS n FROM b FULL JOIN a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL GROUP BY 1""")
def tombstones(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return D.tombstones(o.where("k % 5 != 0"), o.where("k % 7 != 0"), "k").groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT p_partkey // 4 AS k, CASE (p_partkey * 7 + p_partkey // 16) % 11 WHEN 0 THEN 'refused' WHEN 1 THEN 'current' WHEN 2 THEN 'proposed' WHEN 3 THEN 'current' WHEN 4 THEN 'proposed' WHEN 5 THEN 'superseded' END AS state FROM part),
g AS (SELECT k, bool_or(coalesce(state IN ('refused', 'superseded'), false)) AS x, bool_or(coalesce(state = 'current', false)) AS c, bool_or(coalesce(state = 'proposed', false)) AS p FROM e GROUP BY 1)
SELECT k, CASE WHEN x THEN 'excluded' WHEN c AND p THEN 'ambiguous' WHEN c THEN 'current' WHEN p THEN 'proposed' ELSE 'unknown' END AS decision FROM g""")
def page_decisions(spark, sf):
    """Pages of four parts; the states follow from the keys, so that every decision occurs."""
    k = F.col("p_partkey")
    m = (k * 7 + F.floor(k / 16)) % 11
    e = table(spark, sf, "part").select(F.floor(k / 4).alias("k"), F.when(m == 0, "refused").when(m.isin(1, 3), "current").when(m.isin(2, 4), "proposed").when(m == 5, "superseded").alias("state"))
    return D.page_decision(e, "k")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS x, l_orderkey % 7 AS z FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_suppkey % 7 AS j, l_partkey AS x, l_orderkey % 7 AS z FROM lineitem WHERE l_orderkey % 2 = 1),
n AS (SELECT i, j, count(*) AS n FROM a JOIN b USING (x, z) GROUP BY ALL), na AS (SELECT i, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT j, count(*) AS nb FROM b GROUP BY 1)
SELECT i, j, round(n / least(na, nb)::DOUBLE, 9) AS overlap FROM n JOIN na USING (i) JOIN nb USING (j)""")
def cell_overlap(spark, sf):
    """The cells of even orders against those of odd orders: both sides together are the whole table."""
    l = table(spark, sf, "lineitem")
    of = lambda r, key, name: l.where(f"l_orderkey % 2 = {r}").select(key.alias(name), F.col("l_partkey").alias("x"), (F.col("l_orderkey") % 7).alias("z")).distinct()
    return D.cell_overlap(of(0, F.col("l_suppkey"), "i"), of(1, F.col("l_suppkey") % 7, "j"), "i", "j").select("i", "j", F.round("overlap", 9).alias("overlap"))


@query()
def ransac_fit(spark, sf):
    """Every brand is a page whose parts are control points under a known similarity; every ninth is an outlier."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 811).cast("double"), (k * 91 % 577).cast("double")
    far = F.when(k % 9 == 0, 40.0).otherwise(0.0)
    c = table(spark, sf, "part").select(F.concat("p_brand", F.lit(":"), F.floor(k / 200)).alias("page"), x.alias("sx"), y.alias("sy"), (x * 0.0441 - y * 0.0235 + 140 + far).alias("tx"), (x * 0.0235 + y * 0.0441 - 65).alias("ty"), F.lit(1.0).alias("weight"), F.lit(0.05).alias("expected_scale"))
    r = T.register_pages(c)
    return r.select("page", "pass", "inliers", F.round("rmse", 6).alias("rmse"), F.round("scale", 6).alias("scale"), F.round("rotation", 6).alias("rotation"), F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- generators and sequential operators (no SQL; tested against plain re-derivations)

@query()
def lpt_bins(spark, sf):
    counts = [(float(r.weight), r.n) for r in page_weights(spark, sf).groupBy("weight").agg(F.count("*").alias("n")).collect()]
    loads = K.lpt_loads(counts, 16)
    return spark.createDataFrame([(k, size, load) for k, (size, load) in enumerate(loads) if size], "bin int, pages int, weight double")


def _rings(spark, sf):
    k = F.col("s_suppkey")
    pts = [(0, 0), (17, 3), (23, 14), (11, 21), (4, 12)]
    ring = lambda f, dx: F.array(*[F.struct((k * 40 + x * f + dx + k % 3 * 0.3).cast("double").alias("x"), (k % 11 * 30 + z * f + dx).cast("double").alias("z")) for x, z in pts])
    return table(spark, sf, "supplier").select(k.alias("id"), F.array(ring(1.0, 0), ring(0.3, 7)).alias("rings"), ring(1.0, 0).alias("line"), (1 + k % 4).cast("double").alias("width"))


@query()
def polygon_cells(spark, sf):
    return G.polygon_cells(_rings(spark, sf), "id", "rings").groupBy("id").agg(F.count("*").alias("runs"), F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"), F.sum("z").alias("sum_z"))


@query()
def line_cells(spark, sf):
    return G.line_cells(_rings(spark, sf), "id", "line", "width").groupBy("id").agg(F.count("*").alias("cells"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))


@query()
def viterbi_profile(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.floor(F.col("event_id") / 500) * 3).cast("double").alias("at"), (F.col("value") / 20).alias("height"), (F.col("event_id") % 10 / 3.0).alias("quality"))
    return O.viterbi_profile(e, "user_id", "at", "height", "quality")


@query()
def blue_noise(spark, sf):
    k = F.col("p_partkey")
    return O.blue_noise(table(spark, sf, "part").select(F.col("p_brand").alias("k"), (k * 37 % 101).alias("x"), (k * 91 % 103).alias("z")), "k", "x", "z", 6.0)


@query()
def interior_depth(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_brand").alias("k"), (F.col("p_partkey") * 7 % 19).alias("x"), (F.col("p_partkey") * 11 % 17).alias("z"))
    return R.depth_ramp(R.interior_steps(m, ["k"]), ["k"], 4)


@query()
def bilinear_samples(spark, sf):
    grid = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("gx"), (F.floor(F.col("o_orderkey") / 40) % 40).cast("bigint").alias("gz")).agg(F.max("o_totalprice").alias("value"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 4001 / 100.0).alias("x"), (F.col("c_custkey") * 53 % 4003 / 100.0).alias("z"))
    return R.bilinear(p, grid)


from strataweave import queries_rules as _rules  # noqa: E402,F401
from strataweave import queries_places as _places  # noqa: E402,F401
from strataweave import queries_proof as _proof  # noqa: E402,F401
