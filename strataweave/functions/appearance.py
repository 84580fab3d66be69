"""What things look like: ground classes of image patches, leaf palettes, laid patterns, nearest blocks, and who may use a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataweave.functions.scalars import clamp, delta_e76, half_up, hash_2d, srgb_to_lab

# Shares of the bands in luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Between 0 and 1, for channels of 0 to 255."""
    return (LUMINANCE[0] * r + LUMINANCE[1] * g + LUMINANCE[2] * b) / 255


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(0.0)


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once: a bound variable, where the expression itself would be repeated wherever it is read."""
    return F.transform(F.array(value), f)[0]


def _middle(values: Column) -> Column:
    at = lambda s, k: F.element_at(s, k.cast("int"))
    return _bind(F.array_sort(values), lambda s: (at(s, F.floor((F.size(s) - 1) / 2) + 1) + at(s, F.floor(F.size(s) / 2) + 1)) / 2)


def patch_colour(samples: Column) -> Column:
    """struct(r, g, b, texture) of RGB samples: medians of the bands, and the median colour distance from them; null without samples."""
    whole = lambda s: F.struct(*[s[k].cast("double").alias(k) for k in "rgb"])
    valid = F.transform(F.filter(samples, lambda s: s["r"].isNotNull() & s["g"].isNotNull() & s["b"].isNotNull()), whole)
    lab = lambda c: srgb_to_lab(c["r"], c["g"], c["b"])

    def band(v, k):
        return half_up(_middle(F.transform(v, lambda s: s[k])), 0).alias(k)

    def texture(v, own):
        return _middle(F.transform(v, lambda s: _bind(lab(s), lambda p: delta_e76(p, own))))

    def colour(v):
        return _bind(F.struct(band(v, "r"), band(v, "g"), band(v, "b")), lambda m: _bind(lab(m), lambda own: F.struct(m["r"].alias("r"), m["g"].alias("g"), m["b"].alias("b"), texture(v, own).alias("texture"))))

    return _bind(valid, lambda v: F.when(F.size(v) > 0, colour(v)))


def ground_patch(samples: Column, least: int = 8) -> Column:
    """struct(r, g, b, texture) of RGB samples as orthophoto rules read them: medians of the bands, not rounded, and the mean colour distance from them; null below ``least`` samples."""
    lab = lambda c: srgb_to_lab(c["r"], c["g"], c["b"])
    whole = F.transform(F.filter(samples, lambda s: s["r"].isNotNull() & s["g"].isNotNull() & s["b"].isNotNull()), lambda s: F.struct(*[s[k].cast("double").alias(k) for k in "rgb"]))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    def colour(v):
        band = lambda k: _middle(F.transform(v, lambda s: s[k])).alias(k)
        bands = F.struct(*[band(k) for k in "rgb"])
        return _bind(bands, lambda m: _bind(lab(m), lambda own: F.struct(m["r"].alias("r"), m["g"].alias("g"), m["b"].alias("b"), mean(F.transform(v, lambda s: delta_e76(lab(s), own))).alias("texture"))))

    return _bind(whole, lambda v: F.when(F.size(v) >= least, colour(v)))


def ground_material(p: Column, gsd: Column) -> Column:
    """struct(value, confidence) of a ``ground_patch`` at ``gsd`` metres a pixel (none: 1), the first rule that holds; null without a patch, no value at confidence 0 without a rule."""
    r, g, b, t = (p[k] for k in ("r", "g", "b", "texture"))
    light, sat, res = srgb_to_lab(r, g, b)["l"], saturation(r, g, b), F.coalesce(F.nullif(gsd, F.lit(0.0)), F.lit(1.0))
    # Material, condition, confidence, its bounds. In order.
    rules = [
        ("asphalt", (sat < 0.2) & (light < 52) & (t < 14), 0.84 + (0.5 - res) * 0.08 - t / 180, 0.68, 0.92),
        ("concrete", (sat < 0.18) & (light >= 52) & (light < 86) & (t < 12), 0.83 + (0.5 - res) * 0.06 - t / 180, 0.67, 0.9),
        ("gravel", (sat < 0.24) & (t > 18), 0.72 + (0.5 - res) * 0.08, 0.58, 0.8),
        ("earth", (r > g * 1.13) & (g > b * 1.12) & sat.between(0.18, 0.62) & light.between(28, 68), 0.74 + clamp(1 - F.abs(t - 10) / 18, 0, 1) * 0.12 + (0.5 - res) * 0.05, 0.68, 0.88),
        ("paving_stones", (r > g * 1.15) & (g > b * 1.05) & (res <= 0.35), F.lit(0.7), 0.7, 0.7),
    ]
    row = lambda name, c: F.struct(F.lit(name).cast("string").alias("value"), c.cast("double").alias("confidence"))
    found = reduce(lambda c, rule: c.when(rule[1], row(rule[0], half_up(clamp(rule[2], *rule[3:]), 3))), rules, F.when(p.isNull(), None))
    return found.otherwise(row(None, F.lit(0.0)))


def ground_pattern(p: Column, gsd: Column) -> Column:
    """struct(value, confidence): 'solid' for an even ``ground_patch`` at .6 m a pixel or finer, else no value; null without a patch."""
    even = (p["texture"] < 7) & (F.coalesce(F.nullif(gsd, F.lit(0.0)), F.lit(1.0)) <= 0.6)
    row = lambda name, c: F.struct(F.lit(name).cast("string").alias("value"), c.cast("double").alias("confidence"))
    return F.when(p.isNull(), None).when(even, row("solid", half_up(clamp(0.91 - p["texture"] / 80, 0.82, 0.93), 3))).otherwise(row(None, F.lit(0.0)))


# Factor of a ground class on planting, for shrubland and for trees; classes on which nothing is planted.
PLANTING = {"dense-tree-canopy": (1.05, 1.45), "vegetation": (1.15, 1.15), "grass": (0.65, 0.28), "dry-grass": (0.55, 0.18), "soil-mulch": (0.5, 0.2), "rock-gravel": (0.08, 0.08), "sand": (0.08, 0.08)}
UNPLANTED, OTHER_GROUND = ("water-candidate", "neutral-hardscape-candidate", "shadow"), 0.65


def planting_factor(ground: Column, model: Column) -> Column:
    """How likely a plant of ``model`` is put on a ground class: 1 where the class is unknown."""
    shrub = F.coalesce(model == "shrubland", F.lit(False))
    known = reduce(lambda c, kv: c.when(ground == kv[0], F.when(shrub, kv[1][0]).otherwise(kv[1][1])), PLANTING.items(), F.when(ground.isNull(), 1.0).when(ground.isin(*UNPLANTED), 0.0))
    return known.otherwise(OTHER_GROUND)


def aerial_class(r: Column, g: Column, b: Column, texture: Column | None = None) -> Column:
    """struct(class, confidence, eligible, density) of a patch by its median bands (0 to 255) and its texture, the first rule that holds.

    Only eligible classes may be built from imagery; shadow, water and hard ground are candidates for review.
    """
    t = texture if texture is not None else F.lit(0.0)
    lum, sat = luminance(r, g, b), saturation(r, g, b)
    green, blue, warm = (g - (r + b) / 2) / 255, (b - (r + g) / 2) / 255, (r - b) / 255
    yellow = (F.least(r, g) - b) / 255
    leafy = (green > 0.075) & (g > 48)
    dense = (t >= 8) | (lum < 0.34) | (sat > 0.42)
    # Class, condition, confidence, whether it may be built, vegetation density. In order.
    rules = [
        ("shadow", lum < 0.045, F.lit(0.88), False, None),
        ("water-candidate", (blue > 0.1) & (b > 55) & (lum < 0.58), 0.64 + blue * 1.6, False, None),
        ("dense-tree-canopy", leafy & dense, 0.72 + green * 1.45 + F.least(F.lit(0.12), t / 120), True, "dense"),
        ("grass", leafy & (lum > 0.42), 0.7 + green * 1.35, True, "low"),
        ("vegetation", leafy, 0.7 + green * 1.35, True, "medium"),
        ("soil-mulch", (r > g * 1.06) & (g > b * 1.04) & (warm > 0.08) & lum.between(0.12, 0.62), 0.69 + F.least(F.lit(0.14), warm * 0.7) + F.least(F.lit(0.08), t / 160), True, None),
        ("dry-grass", (yellow > 0.08) & (warm > 0.04) & (lum > 0.24) & (g >= r * 0.84), 0.67 + yellow * 1.2, True, None),
        ("rock-gravel", (sat < 0.2) & (t >= 8) & lum.between(0.16, 0.72), 0.66 + F.least(F.lit(0.16), t / 100), True, None),
        ("sand", (warm > 0.03) & (sat < 0.28) & (lum > 0.62), 0.66 + F.least(F.lit(0.16), lum * 0.16), True, None),
        ("neutral-hardscape-candidate", (sat < 0.2) & (lum > 0.08) & (lum < 0.84), 0.68 - sat * 0.5, False, None),
        ("unclassified", F.lit(True), F.lit(0.35), False, None),
    ]

    def row(name, confidence, eligible, density):
        return F.struct(F.lit(name).alias("class"), half_up(clamp(confidence, 0, 0.99), 3).alias("confidence"), F.lit(eligible).alias("eligible"), F.lit(density).cast("string").alias("density"))

    found = F.when(rules[0][1], row(rules[0][0], *rules[0][2:]))
    for name, holds, *rest in rules[1:]:
        found = found.when(holds, row(name, *rest))
    return found


def leaf_palette(r: Column, g: Column, b: Column, leaf: Column, cycle: Column | None = None) -> Column:
    """The two leaf blocks of a tree by its leaf type, else its canopy's colour, else its leaf cycle."""
    pair = lambda *names: F.array(*[F.lit(f"{n}_leaves") for n in names])
    needle = F.coalesce(F.lower(leaf).rlike("needle|conifer"), F.lit(False))
    evergreen = F.coalesce(F.lower(cycle).contains("evergreen"), F.lit(False)) if cycle is not None else F.lit(False)
    unseen = r.isNull() | g.isNull() | b.isNull()
    warm = (r - b) / 255
    # Thresholds and blocks.
    return (
        F.when(needle, pair("spruce", "dark_oak")).when(unseen & evergreen, pair("dark_oak", "oak")).when(unseen, pair("oak", "birch"))
        .when((luminance(r, g, b) < 0.24) | (g < 82), pair("dark_oak", "spruce")).when((g > 125) & (warm > 0.08), pair("birch", "azalea"))
        .when(g > 118, pair("oak", "azalea")).otherwise(pair("oak", "dark_oak"))
    )


# Shares of the three blocks of an irregular pattern, for earthy materials and others; the default pattern of a material.
EARTHY, WEIGHTS_EARTHY, WEIGHTS_OTHER = ("earth", "dirt", "grass"), (0.66, 0.24, 0.1), (0.7, 0.22, 0.08)
DEFAULT_PATTERNS = {
    "paving_stones": "slabs", "brick": "running_bond", "sett": "mosaic", "cobblestone": "mosaic", "gravel": "speckled", "fine_gravel": "speckled",
    "compacted": "speckled", "earth": "organic", "dirt": "organic", "grass": "organic", "wood": "stripes", "boardwalk": "stripes",
}
# Spellings of patterns that mean another one.
PATTERN_NAMES = {"basketweave": "grid", "stack_bond": "grid", "random": "mixed"}
PATTERNS = ["herringbone", "running_bond", "checker", "grid", "stripes", "mixed", "solid", "slabs", "mosaic", "speckled", "organic"]


def pattern_name(text: Column) -> Column:
    """The pattern that a tag names, null if it names none."""
    key = F.regexp_replace(F.lower(F.trim(text)), "[ -]+", "_")
    named = reduce(lambda c, kv: F.when(key == kv[0], kv[1]).otherwise(c), PATTERN_NAMES.items(), key)
    return F.when(named.isin(*PATTERNS), named)


def default_pattern(material: Column) -> Column:
    return reduce(lambda c, kv: F.when(material == kv[0], kv[1]).otherwise(c), DEFAULT_PATTERNS.items(), F.lit("solid"))


def pattern_slot(pattern: Column, x: Column, z: Column, scale: int = 1, rotation: int = 0, seed: int = 0, material: Column | None = None) -> Column:
    """Which of three blocks (0, 1, 2) a pattern puts on the cell (x, z) of whole numbers; ``rotation`` in quarter turns of 90."""
    turned = {90: (-z, x), 180: (-x, -z), 270: (z, -x)}.get(rotation % 360, (x, z))
    px, pz = (F.pmod(F.floor(c / scale), F.lit(24)) for c in turned)
    every = lambda c, n: F.pmod(c, F.lit(n)) == 0
    pick = lambda third, second: F.when(third, 2).when(second, 1).otherwise(0)
    never = F.lit(False)
    roll = hash_2d(F.floor(x / scale), F.floor(z / scale), seed) % 100
    fine = hash_2d(x, z, seed)
    earthy = F.coalesce(material.isin(*EARTHY), F.lit(False)) if material is not None else F.lit(False)
    first = F.when(earthy, WEIGHTS_EARTHY[0]).otherwise(WEIGHTS_OTHER[0])
    second = F.when(earthy, sum(WEIGHTS_EARTHY[:2])).otherwise(sum(WEIGHTS_OTHER[:2]))
    share = fine % 10_000 / 10_000
    # The moduli of each pattern.
    return (
        F.when(pattern == "solid", 0).when(pattern == "checker", F.pmod(px + pz, F.lit(2)))
        .when(pattern == "herringbone", pick(every(px + 2 * pz, 7), every(px + 2 * pz, 4) | every(2 * px + pz, 5)))
        .when(pattern == "running_bond", pick(every(px + pz, 11), every(px + F.pmod(pz, F.lit(2)) * 2, 5)))
        .when(pattern == "grid", pick(never, every(px, 4) | every(pz, 4))).when(pattern == "slabs", pick(never, every(px, 5) | every(pz, 7))).when(pattern == "stripes", pick(never, every(px, 3)))
        .when(pattern == "mosaic", pick(roll < 20, roll < 48)).when(pattern.isin("mixed", "speckled", "organic"), F.when(share < first, 0).when(share < second, 1).otherwise(2))
        .otherwise(pick(never, fine % 100 < 18))
    ).cast("int")


# Words of tags that close a path to visitors, or make it one for service.
CLOSED = ["private", "no", "permit", "delivery", "agricultural", "forestry"]
TRUE = ["yes", "true", "1", "designated"]


def path_role(tags: Column, kind: Column) -> Column:
    """queue, service or guest: queue evidence first, then what is restricted or serves, then roads that are not for walking."""
    t = lambda k: F.lower(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    true = lambda k: t(k).isin(*TRUE)
    highway = F.when(t("highway") != "", t("highway")).otherwise(t("area:highway"))
    exact = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)) == "queue", F.lit(False))
    queue = true("queue") | exact("footway") | (highway == "queue") | exact("attraction") | exact("amenity") | true("queue:line") | ((t("access") == "customers") & t("name").rlike("queue|entrance line"))
    closed = t("access").isin(*CLOSED) | t("foot").isin("private", "no") | t("motor_vehicle").isin("private", "no")
    serving = highway.isin("service", "track") | (t("service") != "") | true("backstage") | true("staff") | true("staff_only")
    road = F.coalesce(kind == "road", F.lit(False)) & ~highway.isin("pedestrian", "living_street")
    return F.when(queue, "queue").when(closed | serving | road, "service").otherwise("guest")


def nearest_blocks(r: Column, g: Column, b: Column, palette: dict[str, tuple[int, int, int]], n: int = 3, plausible: Column | None = None, penalty: float = 24.0) -> Column:
    """The ``n`` palette blocks nearest in colour, as array<struct<de, block>>; blocks not in ``plausible`` (names, by material) lie ``penalty`` farther."""
    far = lambda name: F.when(F.coalesce(F.array_contains(plausible, name), F.lit(True)), 0.0).otherwise(penalty) if plausible is not None else F.lit(0.0)
    near = lambda own: F.array(*[F.struct((delta_e76(own, srgb_to_lab(*[F.lit(float(c)) for c in rgb])) + far(name)).alias("de"), F.lit(name).alias("block")) for name, rgb in palette.items()])
    return F.slice(F.array_sort(_bind(srgb_to_lab(r, g, b), near)), 1, n)
