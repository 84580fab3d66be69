from pyspark.sql import functions as F

from strataweave.functions import ladders as L
from strataweave.functions import scalars as S


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_rounding_and_ladders(spark):
    assert one(spark, S.half_up(F.lit(-0.5)), S.half_up(F.lit(2.5)), S.half_up(F.lit(1.0005), 3), S.clamp(F.lit(float("nan"))), S.clamp(F.lit(7))) == [0, 3, 1.001, 0, 1]
    assert one(spark, S.recency_score(F.lit(730)), S.recency_score(F.lit(731)), S.recency_score(F.lit(9999)), S.recency_score(F.lit(None).cast("int")), S.resolution_score(F.lit(0)), S.resolution_score(F.lit(1))) == [1.0, 0.90, 0.48, 0.64, 0.66, 0.92]


def test_dates_and_lengths(spark):
    got = one(spark, *[S.uk_or_iso_date(F.lit(t)).cast("string") for t in ("31/12/2020", "31/02/2020", "2021-05-06", "nonsense")], *[S.length_m(F.lit(t)) for t in ("9 m", "2.5m", "12 ft")])
    assert got == ["2020-12-31 00:00:00", None, "2021-05-06 00:00:00", None, 9.0, 2.5, None]


def test_revisions_are_partly_ordered(spark):
    def cmp(a, b):
        return one(spark, S.compare_revisions(S.revision(F.lit(a)), S.revision(F.lit(b))))[0]

    assert [cmp("Rev 2", "10"), cmp("B", "a"), cmp("P01", "P2"), cmp("P01", "C01"), cmp("A", "1"), cmp("??", "1"), cmp("REVISION C", "c")] == [-1, 1, -1, None, None, None, 0]


def hash_2d(x, z, seed):
    u = 2**32
    v = ((x * 374761393) ^ (z * 668265263) ^ (seed * 1442695041)) % u
    v = ((v ^ (v >> 13)) * 1274126177) % u
    return v ^ (v >> 16)


def test_coordinate_hash(spark):
    df = spark.createDataFrame([(x, z) for x in (-70000, -1, 0, 3, 99999) for z in (-5, 0, 12345)], "x bigint, z bigint")
    for r in df.withColumn("h", S.hash_2d(F.col("x"), F.col("z"), 7)).collect():
        assert r.h == hash_2d(r.x % 2**32, r.z % 2**32, 7)


def test_addresses(spark):
    ips = {"8.8.8.8": True, "10.1.2.3": False, "172.16.0.1": False, "172.32.0.1": True, "192.168.1.1": False, "169.254.0.1": False, "100.64.0.1": False, "256.1.1.1": False, "::1": False, "224.0.0.1": False}
    assert one(spark, *[S.is_public_ipv4(F.lit(i)) for i in ips]) == list(ips.values())
    urls = {"https://example.org/x": True, "http://localhost/": False, "http://u:p@example.org/": False, "ftp://example.org": False, "http://127.0.0.1/": False, "http://a.local/": False}
    assert one(spark, *[S.is_safe_url(F.lit(u)) for u in urls]) == list(urls.values())


def test_text_rules(spark):
    assert one(spark, S.slugify(F.lit(" Ab--C d! ")), S.text_relevance(F.lit("Galactica"), F.lit("new galactica ride")), S.text_relevance(F.lit("Forbidden Valley Arena"), F.lit("valley near forbidden wood")), S.text_relevance(F.lit("Oak"), F.lit("elm"))) == ["ab-c-d", 1.0, 0.0, 0.0]


def test_kinds(spark):
    cases = [({"tourism": "theme_park", "building": "yes"}, "park_boundary"), ({"building": "yes", "natural": "tree"}, "building"), ({"highway": "footway"}, "path"), ({"highway": "primary"}, "road"), ({"area:highway": "bridleway"}, "road"), ({"waterway": "river"}, "water"), ({"natural": "scree"}, "surface"), ({"door": "yes"}, "detail"), ({"x": "y"}, None), ({"barrier": "hedge"}, "vegetation"), ({"barrier": "wall"}, "barrier")]
    df = spark.createDataFrame(cases, "t map<string,string>, k string").withColumn("got", L.feature_kind(F.col("t")))
    for r in df.collect():
        assert r.got == r.k, r


def test_lifecycle(spark):
    got = one(spark, *[L.drawing_lifecycle(F.lit(t)) for t in ("As-Built", "approved", "for tender", "demolished", "", "hm")])
    assert [(g.state, g.confidence) if g else None for g in got] == [("current", 0.99), ("proposed", 0.74), ("proposed", 0.82), ("demolished", 0.97), None, None]


def test_colours(spark):
    lab = lambda r, g, b: S.srgb_to_lab(F.lit(float(r)), F.lit(float(g)), F.lit(float(b)))
    white, same = one(spark, lab(255, 255, 255), S.delta_e76(lab(10, 20, 30), lab(10, 20, 30)))
    assert abs(white.l - 100) < 0.01 and abs(white.a) < 0.02 and same == 0
    assert one(spark, S.hex_channel(F.lit("#ff8000"), 0), S.hex_channel(F.lit("nope"), 0)) == [255, None]
    assert one(spark, S.cmyk_to_rgb(*[F.lit(x) for x in (0.0, 1.0, 0.0, 0.0)])) == [[255, 0, 255]]
