"""Ordered rule lists: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataweave.functions.scalars import col

# Document classes and their patterns, in order.
DOCUMENT_RULES = [
    ("ride-layout", r"\b(coaster|roller coaster|ride layout|track layout|ride plan|track plan|ride profile|track profile)\b"),
    ("roof-plan", r"\b(roof plan|roof layout)\b"),
    ("floor-plan", r"\b(floor plan|ground floor|first floor|second floor|floor layout)\b"),
    ("supporting", r"\b(landscape and visual impact assessment|visual impact assessment|lvia|environmental impact assessment|environmental statement|heritage statement|ecology report|arboricultural impact assessment)\b"),
    ("landscape", r"\b(landscape site plan|landscape plan|landscaping plan|landscape layout|planting plan|tree plan|soft landscape(?: plan| layout)?|hard landscape(?: plan| layout| materials schedule)?|arboricultural plan)\b"),
    ("site-plan", r"\b(proposed site plan|site plan|block plan|general arrangement|masterplan|master plan|layout plan)\b"),
    ("location-plan", r"\b(location plan|site location|red line plan)\b"),
    ("elevation", r"\b(elevation|elevations|facade|façade)\b"),
    ("section", r"\b(section|sections|cross section|longitudinal section)\b"),
    ("materials", r"\b(material|materials|finishes|finish schedule|material schedule|colour schedule|color schedule)\b"),
    ("demolition", r"\b(demolition|demolitions|removal plan|existing and proposed)\b"),
    ("drainage", r"\b(drainage|flood|surface water|sewer|utilities|utility plan)\b"),
    ("survey", r"\b(topographic|topographical|survey|measured survey|levels plan|level survey)\b"),
    ("design-access", r"\b(design and access|design access|design statement|planning statement)\b"),
    ("decision", r"\b(decision notice|delegated report|committee report|officer report|approval notice|consent notice)\b"),
]
# Lifecycle states by status text, in order: pattern, state, confidence.
STATUS_RULES = [
    (r"as[- ]?built|record", "current", 0.99),
    (r"existing|current|implemented|completed|built|operational", "current", 0.93),
    (r"demolish|demolished|removed", "demolished", 0.97),
    (r"refused|rejected", "refused", 0.98),
    (r"withdrawn|cancelled|canceled", "withdrawn", 0.97),
    (r"superseded|obsolete", "superseded", 0.98),
    (r"construction|tender", "proposed", 0.82),
    (r"approved|granted|consent", "proposed", 0.74),
    (r"planning|proposed|preliminary|submitted|pending|outline|reserved", "proposed", 0.91),
]
# Temporal states by free text, in order: pattern, state, confidence.
TEMPORAL_RULES = [
    (r"demolish|demolished|removed", "demolished", 0.96),
    (r"refused|rejected|withdrawn|cancelled", "refused", 0.94),
    (r"superseded|obsolete", "superseded", 0.94),
    (r"under construction|construction|implemented|completed|built|operational|existing|current|as built", "current", 0.92),
    (r"proposed|pending|submitted|outline|reserved matters", "proposed", 0.90),
    (r"approved|granted|consent", "proposed", 0.72),
]
# Which lifecycle state outranks which.
LIFECYCLE_RANK = {"demolished": 9, "refused": 8, "withdrawn": 8, "superseded": 8, "current": 7, "proposed": 5}


def first_match(text: Column, rules: list[tuple[str, object]], otherwise: object = None) -> Column:
    """The value of the first (pattern, value) whose pattern is found."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), F.lit(value)) if out is None else out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def document_class(label: Column | str, url: Column | str) -> Column:
    text = F.concat_ws(" ", F.coalesce(col(label), F.lit("")), F.coalesce(F.try_url_decode(col(url)), col(url), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(F.lower(text), r"[._+%/\\?&=#-]+", " "), r"\s+", " ")
    file_like = F.coalesce(F.lower(col(url)).rlike(r"\.(pdf|docx?|xlsx?|dwg|dxf|tiff?|png|jpe?g)([?#]|$)"), F.lit(False))
    return F.coalesce(first_match(text, [(p, c) for c, p in DOCUMENT_RULES]), F.when(file_like, "supporting").otherwise("unknown"))


def temporal_state(status: Column | str, layer: Column | None = None, surveyed: Column | None = None) -> Column:
    """struct(state, confidence) of a status text; without one, a surveyed or mapped feature is current."""
    t = F.lower(F.trim(F.coalesce(col(status), F.lit(""))))
    mapped = F.coalesce(layer == "osm", F.lit(False)) if layer is not None else F.lit(False)
    seen = F.coalesce(surveyed, F.lit(False)) if surveyed is not None else F.lit(False)
    state = F.coalesce(first_match(t, [(p, s) for p, s, _ in TEMPORAL_RULES]), F.when(seen | mapped, "current").otherwise("unknown"))
    conf = F.coalesce(first_match(t, [(p, c) for p, _, c in TEMPORAL_RULES]), F.when(seen, 0.96).when(mapped, 0.76).otherwise(0.45))
    return F.struct(state.alias("state"), conf.alias("confidence"))


def drawing_lifecycle(status: Column | str) -> Column:
    """struct(state, confidence, rank); null for an empty or unknown status."""
    t = F.lower(F.trim(col(status)))
    # the first rule is only a finer confidence of the second, which stands before the others
    state = first_match(t, [(p, s) for p, s, _ in STATUS_RULES])
    conf = first_match(t, [(p, c) for p, _, c in STATUS_RULES])
    rank = F.lit(0)
    for name, r in LIFECYCLE_RANK.items():
        rank = F.when(state == name, F.lit(r)).otherwise(rank)
    return F.when(state.isNotNull(), F.struct(state.alias("state"), conf.alias("confidence"), rank.alias("rank")))


# Roads for walking.
PEDESTRIAN = ["footway", "path", "pedestrian", "steps", "corridor", "cycleway", "bridleway"]


def feature_kind(tags: Column) -> Column:
    """Kind of a map feature by its tags, the first of an ordered list; null if none applies."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    has = lambda *ks: F.coalesce(*[t(k) for k in ks]).isNotNull()
    isin = lambda k, *vs: F.coalesce(t(k).isin(*vs), F.lit(False))
    walk = F.lower(F.coalesce(t("area:highway"), t("highway"))).isin(*PEDESTRIAN)
    return (
        F.when(isin("tourism", "theme_park"), "park_boundary")
        .when(isin("roller_coaster", "track"), "ride_track")
        .when(isin("roller_coaster", "support"), "ride_support")
        .when(isin("roller_coaster", "station") | has("building"), "building")
        .when(has("attraction"), "attraction")
        .when(isin("barrier", "hedge") | isin("natural", "tree", "tree_row", "wood", "scrub", "shrub", "bush") | isin("landuse", "forest", "orchard", "vineyard", "plant_nursery") | isin("landcover", "trees", "tree_cover", "shrubs", "scrub"), "vegetation")
        .when(isin("natural", "rock", "stone", "boulder", "cliff") | isin("geological", "outcrop", "boulder"), "terrain_detail")
        .when(has("area:highway") | has("highway"), F.when(walk & ~(isin("area:highway", "bridleway")), "path").otherwise("road"))
        .when(isin("natural", "water") | has("water", "waterway") | isin("leisure", "swimming_pool"), "water")
        .when(has("railway"), "rail")
        .when(has("barrier"), "barrier")
        .when(has("landuse", "landcover", "natural", "leisure"), "surface")
        .when(has("man_made"), "structure")
        .when(has("amenity", "shop"), "amenity")
        .when(has("entrance", "door", "historic", "information", "playground", "public_transport"), "detail")
        .when(has("tourism"), "amenity")
    )


KIND_GROUPS = [("path", "road"), ("building", "structure"), ("ride_track", "rail")]


def kinds_compatible(a: Column, b: Column, groups=KIND_GROUPS) -> Column:
    out = a == b
    for g in groups:
        out = out | (a.isin(*g) & b.isin(*g))
    return F.coalesce(out, F.lit(False))


def linear_category(kind: Column) -> Column:
    return F.when(kind.isin("path", "road"), "access").when(kind.isin("rail", "water"), kind)
