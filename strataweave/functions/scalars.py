"""Scalar column functions: numeric rules, dates, codes, colours, projection, hashing.

All take and return Columns, so they stay inside whole-stage code generation. Unknown stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_378_137


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column | str, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = float(10**places)
    return F.floor(col(x) * k + 0.5) / k


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Null and NaN count as the lower end."""
    x = col(x).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ladder(x: Column | str, steps: list[tuple[float, float]], beyond: float, unknown: float) -> Column:
    """The value of the first step whose bound is not passed."""
    x, out = col(x), None
    for bound, value in steps:
        out = F.when(x <= bound, value) if out is None else out.when(x <= bound, value)
    return F.when(x.isNull(), F.lit(unknown)).otherwise(out.otherwise(F.lit(beyond)))


def recency_score(age_days: Column | str) -> Column:
    """By age in days: 2, 5, 10, 20 years."""
    return ladder(col(age_days).cast("double"), [(730, 1.0), (1825, 0.90), (3650, 0.76), (7300, 0.62)], 0.48, 0.64)


def freshness_score(age_days: Column | str) -> Column:
    return ladder(age_days, [(180, 1.0), (730, 0.75), (1825, 0.5)], 0.2, 0.25)


def resolution_score(metres: Column | str) -> Column:
    m = col(metres).cast("double")
    return ladder(F.when(m > 0, m), [(0.25, 1.0), (0.5, 0.96), (1, 0.92), (2, 0.82), (5, 0.68), (10, 0.52)], 0.30, 0.66)


def temporal_score(state: Column | str, confidence: Column | str) -> Column:
    base = F.lit(0.55)
    for name, value in {"current": 1.0, "unknown": 0.62, "proposed": 0.45, "superseded": 0.12, "refused": 0.04, "demolished": 0.04}.items():
        base = F.when(col(state) == name, F.lit(value)).otherwise(base)
    return clamp(base * (0.65 + 0.35 * clamp(confidence)))


def provider_resolution_score(metres: Column | str, kind: Column | str) -> Column:
    m, k = col(metres).cast("double"), col(kind)
    target = F.when(k == "lidar", 1.0).when(k == "imagery", 0.5).when(k == "terrain", 2.0).otherwise(5.0)
    return F.when(m > 0, clamp(target / F.greatest(target, m))).otherwise(F.lit(0.45))


def uk_or_iso_date(text: Column | str) -> Column:
    """dd/MM/yyyy by the calendar (no other reading if it has that shape), else ISO."""
    t = F.trim(col(text))
    british = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(british, F.try_to_timestamp(t, F.lit("d/M/yyyy"))).otherwise(F.try_to_timestamp(t))


def length_m(text: Column | str) -> Column:
    """Metres from '9', '9 m', '2.5m'; anything else is unknown."""
    return F.expr("cast(null as double)") if text is None else F.regexp_extract(F.trim(col(text).cast("string")), r"^(\d+(?:\.\d+)?)\s*(?:m|metres?|meters?)?$", 1).try_cast("double")


def project_x(lon: Column, lon0: float, lat0: float) -> Column:
    return (lon - lon0) * (math.pi / 180 * EARTH_RADIUS_M * math.cos(lat0 * math.pi / 180))


def project_z(lat: Column, lat0: float) -> Column:
    """South is positive."""
    return (lat0 - lat) * (math.pi / 180 * EARTH_RADIUS_M)


def unproject_lon(x: Column, lon0: float, lat0: float) -> Column:
    return lon0 + x / (math.pi / 180 * EARTH_RADIUS_M * math.cos(lat0 * math.pi / 180))


def unproject_lat(z: Column, lat0: float) -> Column:
    return lat0 - z / (math.pi / 180 * EARTH_RADIUS_M)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * 2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * 2**zoom)


def affine(x: Column, z: Column, a: float, b: float, c: float, d: float, tx: float, tz: float) -> tuple[Column, Column]:
    return x * a + z * b + tx, x * c + z * d + tz


def hash_shard(key: Column | str, n: int) -> Column:
    """First 32 bits of SHA-256, modulo n."""
    return (F.conv(F.substring(F.sha2(col(key).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def floor_div(x: Column | str, n: int) -> Column:
    return F.floor(col(x) / float(n)).cast("bigint")


def mul32(a: Column, b: int) -> Column:
    """Low 32 bits of a product, a below 2**32, without overflow of 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return ((low * b) + ((high * (b & 0xFFFF)) % 65536) * 65536) % 4294967296


def hash_2d(x: Column, z: Column, seed: int = 0) -> Column:
    """Unsigned 32-bit coordinate hash."""
    u = lambda c: F.pmod(c.cast("bigint"), F.lit(4294967296))
    v = mul32(u(x), 374761393).bitwiseXOR(mul32(u(z), 668265263)).bitwiseXOR(F.lit((seed * 1442695041) % 4294967296))
    v = mul32(v.bitwiseXOR(F.shiftrightunsigned(v, 13)), 1274126177)
    return v.bitwiseXOR(F.shiftrightunsigned(v, 16))


def revision(text: Column | str) -> Column:
    """struct(kind, prefix, number): a number, a letter, or prefix and number; null if it is none of them."""
    t = F.regexp_replace(F.upper(F.trim(col(text))), r"^REV(?:ISION)?\s*", "")
    kind = F.when(t.rlike(r"^\d+$"), "number").when(t.rlike(r"^[A-Z]$"), "letter").when(t.rlike(r"^[A-Z]+[-_ ]?\d+$"), "prefixed-number")
    number = F.when(kind == "letter", F.ascii(t) - 64).otherwise(F.regexp_extract(t, r"(\d+)$", 1).try_cast("bigint"))
    prefix = F.when(kind == "prefixed-number", F.regexp_extract(t, r"^([A-Z]+)", 1)).otherwise(F.lit(""))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), prefix.alias("prefix"), number.cast("bigint").alias("number")))


def compare_revisions(a: Column, b: Column) -> Column:
    """-1, 0, 1; null where they are not comparable."""
    same = (a["kind"] == b["kind"]) & (a["prefix"] == b["prefix"])
    return F.when(same, F.signum((a["number"] - b["number"]).cast("double")).cast("int"))


def object_code(text: Column | str) -> Column:
    """'ab - 12c' -> 'AB12C' for up to eight letters, up to five digits and one more letter; else null."""
    shape = r"^([A-Z]{1,8})[\s_./-]*(\d{1,5}[A-Z]?)$"
    t = F.upper(F.trim(col(text)))
    return F.when(t.rlike(shape), F.concat(F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)))


def slugify(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normal_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " "))


def srgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) under D65, channels 0 to 255."""
    linear = lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92)
    lr, lg, lb = linear(r), linear(g), linear(b)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    x = f((lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047)
    y = f(lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750)
    z = f((lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e76(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["l"] - q["l"], 2) + F.pow(p["a"] - q["a"], 2) + F.pow(p["b"] - q["b"], 2))


def hex_channel(colour: Column | str, k: int) -> Column:
    """Channel 0, 1 or 2 of '#rrggbb'."""
    c = F.regexp_extract(F.lower(F.trim(col(colour))), r"^#?([0-9a-f]{6})$", 1)
    return F.conv(F.when(c != "", F.substring(c, 2 * k + 1, 2)), 16, 10).cast("double")


def gray_to_rgb(v: Column) -> Column:
    return F.array(*[half_up(clamp(v) * 255)] * 3)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array(*[half_up(255 * (1 - clamp(x)) * (1 - clamp(k))) for x in (c, m, y)])


def is_public_ipv4(ip: Column | str) -> Column:
    """False for private, loopback, link-local, shared, multicast, reserved and malformed addresses."""
    t = col(ip)
    ok = t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    closed = t.rlike(r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^(?:22[4-9]|2[3-5]\d)\.")
    return F.coalesce(ok & ~closed, F.lit(False))


def is_safe_url(url: Column | str) -> Column:
    """http(s) without credentials, to a host that is neither local nor a private address."""
    u = F.lower(col(url))
    host = F.regexp_extract(u, r"^https?://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1)
    numeric = host.rlike(r"^[\d.]+$")
    return F.coalesce((host != "") & ~host.rlike(r"^localhost$|\.local$|\.internal$") & (~numeric | is_public_ipv4(host)), F.lit(False))


def valid_bbox(south: Column, west: Column, north: Column, east: Column) -> Column:
    return F.coalesce((south < north) & (west < east) & (south >= -90) & (north <= 90) & (west >= -180) & (east <= 180), F.lit(False))


def text_relevance(name: Column, text: Column) -> Column:
    """How well an application text names a thing: 1 for the whole name, .72 for one long token, a share of tokens from .67 up, else 0."""
    n, t = normal_text(name), normal_text(text)
    tokens = F.filter(F.array_distinct(F.split(n, " ")), lambda x: F.length(x) > 2)
    words = F.split(t, " ")
    hit = F.size(F.array_intersect(tokens, words))
    share = hit / F.when(F.size(tokens) > 0, F.size(tokens)).cast("double")
    one = (F.size(tokens) == 1) & (hit == 1) & (F.length(tokens[0]) >= 5)
    return F.when((n != "") & F.contains(t, n), 1.0).when(one, 0.72).when((F.size(tokens) > 1) & (share >= 0.67), 0.48 + 0.42 * share).otherwise(0.0)
