"""Vocabularies of drawings: materials, objects and their attributes in short texts.

All matching is done by built-in expressions: a rule table becomes an array of the rules that a text meets, so a text is read once and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import object_code

# Material, role, confidence, patterns over normalised text (also tried on the text without spaces). In order.
MATERIAL_RULES = [
    ("red_tarmac", "surface", 0.92, [r"\bred\s*(?:asphalt|tarmac|bitmac|macadam)\b", r"\bred(?:asphalt|tarmac|bitmac|macadam)\b"]),
    ("resin_bound_beige", "surface", 0.92, [r"\b(?:beige|buff|sand|sandy|gold(?:en)?)\s*resin(?:\s*-?\s*bound)?\b", r"\bresin(?:\s*-?\s*bound)?\s*(?:beige|buff|sand|sandy|gold(?:en)?)\b", r"\b(?:beige|buff|sand|sandy|gold(?:en)?)resin(?:bound)?\b", r"\bresin(?:bound)?(?:beige|buff|sand|sandy|gold(?:en)?)\b"]),
    ("resin_bound_grey", "surface", 0.92, [r"\bgr(?:e|a)y\s*resin(?:\s*-?\s*bound)?\b", r"\bresin(?:\s*-?\s*bound)?\s*gr(?:e|a)y\b", r"\bgr(?:e|a)yresin(?:bound)?\b", r"\bresin(?:bound)?gr(?:e|a)y\b"]),
    ("fresh_black_asphalt", "surface", 0.9, [r"\b(?:new|fresh|black|dark)\s*(?:black\s*)?(?:asphalt|tarmac|bitmac|macadam)\b", r"\b(?:new|fresh|black|dark)(?:black)?(?:asphalt|tarmac|bitmac|macadam)\b"]),
    ("light_asphalt", "surface", 0.9, [r"\b(?:light|pale)\s*(?:gr(?:e|a)y\s*)?(?:asphalt|tarmac|bitmac|macadam)\b", r"\blightgr(?:e|a)y(?:asphalt|tarmac|bitmac|macadam)\b", r"\b(?:light|pale)(?:asphalt|tarmac|bitmac|macadam)\b"]),
    ("weathered_asphalt", "surface", 0.86, [r"\b(?:weathered|existing|old|aged|worn)\s*(?:asphalt|tarmac|bitmac|macadam)\b", r"\b(?:weathered|existing|old|aged|worn)(?:asphalt|tarmac|bitmac|macadam)\b"]),
    ("old_concrete", "surface", 0.88, [r"\b(?:old|existing|weathered|aged|worn|stained)\s*concrete\b", r"\b(?:old|existing|weathered|aged|worn|stained)concrete\b"]),
    ("paving_stones", "surface", 0.88, [r"\b(?:block\s*paving|paving\s*(?:slabs?|stones?|flags?|blocks?)|stone\s*pavers?|concrete\s*pavers?|flag\s*stones?|flagstones?|pavers?)\b", r"\b(?:blockpaving|pavingslabs?|pavingstones?|pavingflags?|pavingblocks?|stonepavers?|concretepavers?|flagstones?|pavers?)\b"]),
    ("concrete", "surface", 0.8, [r"\b(?:concrete|cement(?:itious)?)\b"]),
    ("brick", "surface", 0.82, [r"\b(?:brick\s*paving|brick\s*pavers?|brickwork|bricks?)\b", r"\b(?:brickpaving|brickpavers?)\b"]),
    ("stone", "surface", 0.8, [r"\b(?:natural\s*stone|granite|limestone|sandstone|cobble(?:stone)?s?|stone)\b"]),
    ("timber", "surface", 0.8, [r"\b(?:timber|wood(?:en)?|decking)\b"]),
    ("gravel", "surface", 0.82, [r"\b(?:gravel|chippings|aggregate\s*path|loose\s*aggregate|hoggin)\b"]),
    ("sand", "surface", 0.8, [r"\b(?:sand|sandy\s*surface|play\s*sand)\b"]),
    ("grass", "surface", 0.82, [r"\b(?:grass|turf|lawn)\b"]),
    ("earth", "surface", 0.78, [r"\b(?:earth|soil|topsoil|bare\s*ground|bare\s*earth|mud|earthworks\s*finish)\b"]),
    ("weathered_asphalt", "surface", 0.72, [r"\b(?:asphalt|tarmac|bitmac|macadam|bituminous\s*surfacing)\b"]),
    ("steel", "structural", 0.78, [r"\bsteel\b"]),
    ("glass", "structural", 0.78, [r"\b(?:glass|glazing)\b"]),
    ("slate_roof", "roof", 0.82, [r"\b(?:slate\s*roof|slate\s*tiles?|roof\s*slates?)\b"]),
    ("clay_tile_roof", "roof", 0.82, [r"\b(?:clay\s*tiles?|roof\s*tiles?|clay\s*roof)\b"]),
    ("metal_roof", "roof", 0.82, [r"\b(?:metal|zinc|aluminium|aluminum)\s*(?:roof|roofing|cladding|sheet(?:ing)?)\b"]),
]
# Asphalts beside which the plain word says nothing more.
OWN_ASPHALT = ["red_tarmac", "fresh_black_asphalt", "light_asphalt"]
# Which kinds a material can be of.
ROOF_ONLY = ["slate_roof", "clay_tile_roof", "metal_roof"]
SURFACE_ONLY = ["weathered_asphalt", "fresh_black_asphalt", "light_asphalt", "red_tarmac", "resin_bound_beige", "resin_bound_grey", "gravel", "grass", "earth"]
STRUCTURAL = ["brick", "stone", "timber", "steel", "glass"]


def _once(text: Column, f) -> Column:
    """``f`` of a text that is made once: as a bound variable it isn't repeated in each of the rules that read it."""
    return F.transform(F.array(text), f)[0]


def material_text(text: Column) -> Column:
    """Lower case, one spelling of dashes and separators, camel case apart."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[‐‑‒–—−]", "-")
    t = F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, "[,:;|]+", " "), "[_/]+", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*-\s*", "-"), r"\s+", " ")))


def materials(text: Column) -> Column:
    """array<struct<order, rule_no, material, role, confidence>> of the materials in a label, the most certain first.

    A material counts once, by its first rule. The plain word for asphalt, concrete or stone gives way where a more exact one is found.
    """
    return _once(material_text(text), _materials)


def _materials(t: Column) -> Column:
    close = F.regexp_replace(t, r"\s+", "")
    meets = lambda patterns: F.lit(False) if not patterns else t.rlike(patterns[0]) | close.rlike(patterns[0]) | meets(patterns[1:])
    row = lambda k, m, role, c: F.struct(F.lit(-c).alias("order"), F.lit(k).alias("rule_no"), F.lit(m).alias("material"), F.lit(role).alias("role"), F.lit(c).alias("confidence"))
    found = F.filter(F.array(*[F.when(meets(p), row(k, m, role, c)) for k, (m, role, c, p) in enumerate(MATERIAL_RULES)]), lambda x: x.isNotNull())
    first = F.filter(found, lambda x: ~F.exists(found, lambda y: (y["material"] == x["material"]) & (y["rule_no"] < x["rule_no"])))
    has = lambda *names: F.exists(first, lambda y: y["material"].isin(*names))
    plain = lambda x: ((x["material"] == "weathered_asphalt") & (x["confidence"] <= 0.72) & has(*OWN_ASPHALT)) | ((x["material"] == "concrete") & has("old_concrete")) | ((x["material"] == "stone") & has("paving_stones") & t.rlike("pav|flag|paver"))
    return F.array_sort(F.filter(first, lambda x: ~plain(x)))


def material_fits(kind: Column, material: Column) -> Column:
    """Whether a thing of this kind can be made of the material."""
    m = F.lower(material)
    return F.coalesce(
        F.when(m.isin(*ROOF_ONLY), kind == "building").when(m.isin(*SURFACE_ONLY), kind.isin("path", "road", "terrain_detail"))
        .when(m.isin(*STRUCTURAL), kind.isin("building", "structure", "barrier")).otherwise(kind.isin("building", "structure", "path", "road", "barrier", "ride_track")), F.lit(False))


# Tree species that a label may name.
SPECIES = [
    "oak", "english oak", "sessile oak", "beech", "birch", "silver birch", "maple", "field maple", "sycamore", "ash", "lime", "linden", "hornbeam", "hawthorn", "rowan",
    "willow", "alder", "elm", "cherry", "wild cherry", "scots pine", "pine", "spruce", "fir", "cedar", "yew", "poplar", "plane",
]
_SPECIES = "|".join(SPECIES)
# Object type, subtype, pattern over lower-case text, confidence. In order.
OBJECT_RULES = [
    ("drainage", "pipe", r"\b(?:dia(?:meter)?\.?\s*)?\d{2,4}\s*mm\s+(?:dia(?:meter)?\.?\s*)?(?:pipe|sewer|drain|culvert)\b|\b(?:pipe|sewer|drain|culvert)\s+(?:dia(?:meter)?\.?\s*)?\d{2,4}\s*mm\b", 0.995),
    ("accessibility", "accessible_ramp", r"\b(?:accessible|disabled|dda|wheelchair)\s+(?:access\s+)?ramp\b|\bramp\s+(?:to\s+)?(?:accessible|disabled)\b", 0.99),
    ("accessibility", "accessible_parking", r"\b(?:accessible|disabled|blue\s+badge)\s+(?:parking\s+)?(?:bay|space)\b", 0.99),
    ("accessibility", "tactile_paving", r"\b(?:tactile|blister|corduroy)\s+(?:paving|surface)\b", 0.98),
    ("accessibility", "lift", r"\b(?:passenger|platform|wheelchair|accessible)\s+lift\b", 0.96),
    ("roof_element", "roof_ridge", r"\b(?:roof\s+)?ridge(?:\s+line)?\b", 0.98),
    ("roof_element", "roof_hip", r"\b(?:roof\s+)?hip(?:\s+line)?\b", 0.97),
    ("roof_element", "roof_valley", r"\b(?:roof\s+)?valley(?:\s+line)?\b", 0.97),
    ("roof_element", "eaves", r"\beaves?(?:\s+line|\s+level)?\b", 0.96),
    ("roof_element", "parapet", r"\bparapet(?:\s+wall|\s+level)?\b", 0.96),
    ("roof_element", "rooflight", r"\b(?:roof\s*light|skylight|lantern\s+light)\b", 0.98),
    ("roof_element", "gutter", r"\b(?:box\s+)?gutter|rainwater\s+gutter\b", 0.94),
    ("roof_element", "roof_plant", r"\broof(?:top)?\s+(?:plant|ahu|equipment|unit)\b", 0.96),
    ("facade_element", "door", r"\b(?:entrance|exit|service|roller\s+shutter|double|single|fire)\s+door\b|\bdoor\s+(?:opening|set|type)\b", 0.96),
    ("facade_element", "window", r"\b(?:window|glazed\s+opening|curtain\s+wall)\b", 0.94),
    ("facade_element", "cladding_zone", r"\b(?:wall|facade|façade)\s+cladding\b|\bcladding\s+(?:panel|zone|type)\b", 0.94),
    ("facade_element", "canopy", r"\bentrance\s+canopy\b|\bdoor\s+canopy\b", 0.94),
    ("structure", "retaining_wall", r"\bretaining\s+wall\b", 0.99),
    ("structure", "column", r"\b(?:structural\s+)?column\b|\bcolumn\s+(?:grid|line|type)\b", 0.96),
    ("structure", "beam", r"\b(?:steel|timber|concrete|structural)\s+beam\b|\bbeam\s+(?:line|type)\b", 0.96),
    ("structure", "truss", r"\b(?:roof\s+)?truss\b", 0.97),
    ("structure", "brace", r"\b(?:cross|diagonal|structural)\s+brac(?:e|ing)\b", 0.97),
    ("structure", "foundation", r"\b(?:pad|strip|raft)\s+foundation\b|\bfoundation\s+(?:pad|plan|type)\b", 0.97),
    ("structure", "footing", r"\b(?:pad\s+)?footing\b|\bbase\s+plate\b", 0.96),
    ("structure", "gantry", r"\bgantry\b", 0.96),
    ("structure", "platform", r"\b(?:maintenance|service|access|operator)\s+platform\b", 0.95),
    ("structure", "stair", r"\b(?:external|escape|access|maintenance)\s+stair(?:case)?\b", 0.95),
    ("structure", "bridge", r"\b(?:pedestrian|service|access)\s+bridge\b", 0.95),
    ("tree", "tree", r"\b(?:existing|retained|proposed|new|removed|fell|felled)?\s*tree\s*(?:no\.?\s*)?[a-z]{0,3}\s*\d{1,4}[a-z]?\b|\btree\s+(?:species|schedule|planting|pit)\b", 0.98),
    ("tree", "tree", rf"\b(?:{_SPECIES})\b.*\b(?:tree|retained|removed|proposed|stem|crown)\b|\b(?:tree|retained|removed|proposed|stem|crown)\b.*\b(?:{_SPECIES})\b", 0.95),
    ("landscape", "hedge", r"\b(?:existing|proposed|new|retained)?\s*hedge(?:row)?\b", 0.97),
    ("landscape", "planting_bed", r"\b(?:ornamental|shrub|mixed|native)?\s*planting\s+(?:bed|area|zone)\b|\bshrub\s+bed\b", 0.96),
    ("landscape", "grass_area", r"\b(?:amenity|species[- ]rich|meadow)?\s*(?:grass|turf)\s+(?:area|zone)\b", 0.94),
    ("landscape", "woodland", r"\b(?:woodland|scrub|meadow|wildflower)\s+(?:area|planting|zone)\b", 0.95),
    ("landscape", "rock_boulder", r"\b(?:landscape\s+)?(?:rock|boulder)s?\b", 0.92),
    ("landscape", "planter", r"\b(?:raised\s+)?planter\b", 0.94),
    ("barrier", "acoustic_barrier", r"\b(?:acoustic|noise)\s+(?:fence|barrier|screen|wall)\b", 0.99),
    ("barrier", "fence", r"\b(?:boundary|security|timber|mesh|palisade|post\s+and\s+rail)?\s*fenc(?:e|ing)\b", 0.97),
    ("barrier", "gate", r"\b(?:pedestrian|vehicle|service|access|security)?\s*gate(?:s)?\b", 0.96),
    ("barrier", "railing", r"\b(?:guard|pedestrian|metal)?\s*railings?\b|\bbalustrade\b", 0.95),
    ("barrier", "boundary_wall", r"\bboundary\s+wall\b|\bscreen\s+wall\b", 0.96),
    ("barrier", "bollard", r"\b(?:security|removable|fixed)?\s*bollard\b", 0.94),
    ("lighting", "lighting_column", r"\b(?:lighting|lamp|light)\s+(?:column|post)\b|\blighting\s+column\s*[a-z]{0,3}\d+\b", 0.99),
    ("lighting", "bollard_light", r"\b(?:illuminated|lighting?)\s+bollard\b|\bbollard\s+light\b", 0.97),
    ("lighting", "floodlight", r"\bflood\s*light|floodlight\b", 0.98),
    ("lighting", "luminaire", r"\bluminaire\b|\blight\s+fitting\b", 0.95),
    ("drainage", "manhole", r"\b(?:drainage\s+)?manhole\b|\bmh\s*[-:]?\s*\d+\b", 0.98),
    ("drainage", "gully", r"\b(?:road|channel|slot)?\s*gully\b", 0.97),
    ("drainage", "drain", r"\b(?:foul|surface\s+water|storm|linear|channel)\s+drain\b", 0.97),
    ("drainage", "pipe", r"\b(?:foul|storm|surface\s+water|drainage)\s+(?:pipe|sewer)\b|\b\d{2,4}\s*mm\s+(?:pipe|sewer)\b", 0.96),
    ("drainage", "culvert", r"\bculvert\b", 0.98),
    ("drainage", "outfall", r"\boutfall\b", 0.98),
    ("drainage", "swale", r"\b(?:drainage|suds|bioswale)?\s*swale\b", 0.98),
    ("drainage", "attenuation_basin", r"\b(?:attenuation|detention|retention)\s+(?:basin|pond|tank)\b", 0.98),
    ("drainage", "rain_garden", r"\brain\s+garden\b", 0.97),
    ("water", "pond", r"\b(?:existing|proposed|ornamental)?\s*pond\b", 0.96),
    ("water", "lake", r"\b(?:existing|proposed)?\s*lake\b", 0.97),
    ("water", "watercourse", r"\b(?:stream|watercourse|channel|ditch)\b", 0.93),
    ("signage", "wayfinding_sign", r"\b(?:wayfinding|directional|information|info)\s+(?:sign|board|totem)\b", 0.98),
    ("signage", "sign", r"\b(?:signage|sign\s+post|sign\s+type|sign\s+no)\b", 0.95),
    ("street_furniture", "bench", r"\b(?:park|timber|metal)?\s*bench\b", 0.97),
    ("street_furniture", "bin", r"\b(?:litter|waste|recycling)?\s*bin\b", 0.96),
    ("street_furniture", "picnic_table", r"\bpicnic\s+table\b", 0.98),
    ("street_furniture", "cycle_rack", r"\b(?:cycle|bicycle|bike)\s+(?:rack|stand)\b", 0.97),
    ("street_furniture", "drinking_fountain", r"\bdrinking\s+fountain\b", 0.98),
    ("street_furniture", "shelter", r"\b(?:waiting|visitor|smoking|cycle)\s+shelter\b", 0.94),
    ("path_detail", "kerb", r"\b(?:flush|raised|dropped|conservation|granite)?\s*kerb\b|\bcurb\b", 0.97),
    ("path_detail", "edging", r"\b(?:path|paving|steel|timber)\s+edging\b", 0.94),
    ("path_detail", "steps", r"\b(?:external|landscape|access)?\s*steps?\b", 0.93),
    ("path_detail", "ramp", r"\b(?:pedestrian|path|access)?\s*ramp\b", 0.93),
    ("path_detail", "drainage_channel", r"\b(?:slot|linear)\s+channel\b", 0.94),
    ("path_detail", "paving_module", r"\b(?:paving|paver|slab)\s+(?:module|size|pattern|course|bond)\b", 0.95),
    ("utility", "substation", r"\b(?:electrical|electricity)?\s*substation\b", 0.99),
    ("utility", "transformer", r"\btransformer\b", 0.98),
    ("utility", "generator", r"\b(?:standby|backup|diesel)?\s*generator\b", 0.97),
    ("utility", "ahu", r"\b(?:ahu|air\s+handling\s+unit)\b", 0.98),
    ("utility", "hvac", r"\b(?:hvac|air\s+conditioning|condenser\s+unit)\b", 0.96),
    ("utility", "vent", r"\b(?:extract|ventilation|exhaust)\s+(?:vent|stack|duct)\b", 0.96),
    ("utility", "tank", r"\b(?:water|fuel|storage|sprinkler)\s+tank\b", 0.95),
    ("utility", "plant_enclosure", r"\b(?:plant|services?)\s+(?:room|enclosure|compound)\b", 0.94),
    ("transport_detail", "parking_bay", r"\b(?:parking|car)\s+bay\b", 0.96),
    ("transport_detail", "loading_bay", r"\bloading\s+bay\b", 0.98),
    ("transport_detail", "service_yard", r"\bservice\s+yard\b", 0.97),
    ("transport_detail", "dropoff", r"\b(?:drop[- ]?off|pick[- ]?up)\s+(?:area|bay|zone)\b", 0.96),
    ("transport_detail", "road_marking", r"\b(?:road|carriageway|parking)\s+markings?\b", 0.94),
]
# Attribute, pattern whose first filled group is the number, least and largest value believed.
ATTRIBUTES = [
    ("height_m", r"\b(?:overall\s+height|column\s+height|height|ht)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,3})?)\s*m\b", 0.05, 250),
    ("width_m", r"\b(?:overall\s+width|width|wd)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,3})?)\s*m\b", 0.05, 250),
    ("length_m", r"\b(?:overall\s+length|length|len)\s*[:=]?\s*([0-9]{1,4}(?:\.[0-9]{1,3})?)\s*m\b", 0.05, 2000),
    ("spacing_m", r"\b(?:spacing|centres|centers|c/c)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,3})?)\s*m\b", 0.05, 100),
    ("pipe_mm", r"\b(?:dia(?:meter)?\.?\s*)?([0-9]{2,4})\s*mm\s+(?:dia(?:meter)?\.?\s*)?(?:pipe|sewer|drain|culvert)\b", 20, 5000),
    ("pipe_after_mm", r"\b(?:pipe|sewer|drain|culvert)\s+(?:dia(?:meter)?\.?\s*)?([0-9]{2,4})\s*mm\b", 20, 5000),
    ("diameter_mm", r"(?:diameter|dia\.?|ø)\s*[:=]?\s*([0-9]{2,4})\s*mm\b", 10, 5000),
    ("crown_m", r"\b(?:crown\s+spread|canopy\s+spread|spread)\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*m\b", 0.1, 100),
    ("pitch_deg", r"\b(?:roof\s+)?pitch\s*[:=]?\s*([0-9]{1,2}(?:\.[0-9])?)\s*(?:deg|degree|degrees|°)", 0, 89.9),
    ("gradient_ratio", r"\b1\s*[:/]\s*([0-9]{1,4}(?:\.[0-9]+)?)\b", 0.001, 9999),
    ("gradient_percent", r"\b(?:gradient|fall|slope)\s*[:=]?\s*([0-9]{1,2}(?:\.[0-9]+)?)\s*%", 0, 100),
    ("size_a_mm", r"\b([0-9]{2,5}(?:\.[0-9]+)?)\s*[x×]\s*[0-9]{2,5}(?:\.[0-9]+)?\s*mm\b", 0, 99999),
    ("size_b_mm", r"\b[0-9]{2,5}(?:\.[0-9]+)?\s*[x×]\s*([0-9]{2,5}(?:\.[0-9]+)?)\s*mm\b", 0, 99999),
    ("ral", r"\bral\s*[-:]?\s*([0-9]{4})\b", 0, 9999),
]
# Status of an object by words in its label. In order.
OBJECT_STATUS = [("removed", r"\b(?:to\s+be\s+removed|remove|removed|fell|felled|demolish|demolished)\b"), ("retained", r"\b(?:retained|retain|existing\s+to\s+remain)\b"), ("proposed", r"\b(?:proposed|new|replacement)\b"), ("existing", r"\bexisting\b")]


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def object_class(text: Column) -> Column:
    """struct(object_type, subtype, confidence, rule_no) of a label: of all rules met the most certain, then the longest match, then the first; null if none is met."""
    return _once(_plain(text), _object_class)


def _object_class(t: Column) -> Column:
    one = [F.when(t.rlike(p), F.struct(F.lit(-c).alias("order"), (-F.length(F.trim(F.regexp_extract(t, p, 0)))).alias("length"), F.lit(k).alias("rule_no"), F.lit(a).alias("object_type"), F.lit(b).alias("subtype"), F.lit(c).alias("confidence"))) for k, (a, b, p, c) in enumerate(OBJECT_RULES)]
    best = F.array_min(F.array(*one))
    return F.when(best.isNotNull(), F.struct(best["object_type"].alias("object_type"), best["subtype"].alias("subtype"), best["confidence"].alias("confidence"), best["rule_no"].alias("rule_no")))


def object_details(text: Column) -> Column:
    """struct of the code, the numbers, the species and the status in a label; numbers out of their range are unknown."""
    return _once(_plain(text), _object_details)


def _object_details(t: Column) -> Column:
    number = {n: F.regexp_extract(t, p, 1).try_cast("double") for n, p, *_ in ATTRIBUTES}
    found = {n: F.when(number[n].between(lo, hi), number[n]) for n, _, lo, hi in ATTRIBUTES}
    found["pipe_mm"] = F.coalesce(found["pipe_mm"], found.pop("pipe_after_mm"))
    status = F.coalesce(*[F.when(t.rlike(p), name) for name, p in OBJECT_STATUS])
    # the longest name, for the name of a kind holds that of its family
    species = F.element_at(F.array_sort(F.filter(F.array(*[F.when(t.rlike(rf"\b{s}\b"), F.struct(F.lit(-len(s)).alias("n"), F.lit(s).alias("s"))) for s in SPECIES]), lambda x: x.isNotNull())), 1)
    return F.struct(object_code(t).alias("code"), *[c.alias(n) for n, c in found.items()], F.when(t.rlike(rf"\b(?:{_SPECIES})\b"), species["s"]).alias("species"), status.alias("status"))


def text_windows(items: DataFrame, page: list[str], most: int = 4, line_tolerance: float = 3.5, gap: float = 28.0, with_items: bool = False) -> DataFrame:
    """Runs of up to ``most`` neighbouring texts on one line: (page, first, n, raw, x, y, factor) from items (page, item, text, x, y, width, size).

    Items are in one line if each next one, from the top, lies within the tolerance of the one before it; a run ends where the gap to the next item is wider than
    ``gap`` and 2.2 times the letters, or reaches back too far. A page of a drawing is one group. ``with_items`` adds the items of each run.
    """
    down = Window.partitionBy(*page).orderBy(F.col("y").desc(), "x", "item")
    jump = F.coalesce(F.lag("y").over(down) - F.col("y") > line_tolerance, F.lit(True))
    d = items.withColumn("_new", jump.cast("int")).withColumn("_line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*page, "_line").orderBy("x", "item")
    width = F.coalesce("width", F.greatest(F.lit(4.0), F.length("text") * F.coalesce("size", F.lit(8.0)) * 0.45))
    room = F.greatest(F.lit(gap), F.coalesce(F.lag("size").over(along), F.lit(0.0)) * 2.2, F.coalesce("size", F.lit(0.0)) * 2.2)
    before = F.lag(width).over(along)
    space = F.col("x") - (F.lag("x").over(along) + before)
    apart = F.coalesce((space > room) | (space < -F.greatest(room, before * 0.35)), F.lit(True))
    d = d.withColumns({"_apart": apart.cast("int"), "_at": F.row_number().over(along)}).withColumn("_run", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.partitionBy(*page, "_line", "_run").orderBy("_at").rowsBetween(0, most - 1)
    d = d.withColumn("_w", F.collect_list(F.struct("item", "text", "y")).over(ahead)).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_w"))))
    used = F.slice("_w", 1, F.col("n"))
    factor = F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.88), 1 - 0.035 * (F.col("n") - 1)))
    return d.select(*page, F.col("item").alias("first"), "n", F.array_join(F.transform(used, lambda u: u["text"]), " ").alias("raw"), "x", (F.aggregate(used, F.lit(0.0), lambda s, u: s + u["y"]) / F.col("n")).alias("y"), factor.alias("factor"), *([F.transform(used, lambda u: u["item"]).alias("items")] if with_items else []))
