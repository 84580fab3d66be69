"""Crawled text: links in pages, tables, archive indexes, title blocks and levels in drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.ladders import document_class
from strataweave.functions.scalars import is_safe_url
from strataweave.functions.vocabulary import object_details as object_attributes  # noqa: F401

ANCHOR = r"(?is)<a\b[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a>"
# How soon a document of a class is fetched; four more if it is downloaded rather than looked for.
PRIORITY = {"site-plan": 100, "location-plan": 94, "ride-layout": 96, "elevation": 92, "section": 91, "floor-plan": 88, "roof-plan": 88, "materials": 84, "landscape": 80, "demolition": 78, "survey": 75, "drainage": 68, "design-access": 55, "decision": 45, "supporting": 35, "unknown": 20}


def strip_html(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, label) of every anchor with an address; relative ones are resolved against the page, fragments cut off."""
    hrefs = F.transform(F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(F.coalesce(*[F.nullif(F.regexp_extract(a, ANCHOR, k), F.lit("")) for k in (1, 2, 3)]).alias("href"), F.regexp_extract(a, ANCHOR, 4).alias("text")))
    a = pages.select(F.col(id_col), F.col(url_col).alias("base"), F.explode(hrefs).alias("a"))
    href = F.trim(F.replace(F.col("a.href"), F.lit("&amp;"), F.lit("&")))
    root = F.regexp_extract("base", r"^(https?://[^/?#]+)", 1)
    folder = F.concat(root, F.regexp_replace(F.regexp_extract("base", r"^https?://[^/?#]+(/[^?#]*)?", 1), r"[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#"), None).otherwise(F.concat(folder, href))
    return a.select(id_col, F.regexp_replace(full, "#.*$", "").alias("url"), strip_html(F.col("a.text")).alias("label")).where("url is not null and url != ''")


def class_priority(classification: Column, download: Column | None = None) -> Column:
    """Priority of a document class, four more where ``download`` holds."""
    out = F.lit(PRIORITY["unknown"])
    for k, v in PRIORITY.items():
        out = F.when(classification == k, v).otherwise(out)
    return out if download is None else out + F.when(download, 4).otherwise(0)


def document_links(links: DataFrame) -> DataFrame:
    """Safe links, once per address, with class, priority, and whether they lead straight to a file."""
    c = document_class("label", "url")
    d = links.where(is_safe_url("url")).groupBy("url").agg(F.min("label").alias("label")).withColumn("classification", c)
    direct = F.lower(F.concat_ws(" ", "label", "url")).rlike(r"\b(download|document|attachment|file)\b") | F.lower("url").rlike(r"\.(pdf|docx?|xlsx?|dwg|dxf|tiff?|png|jpe?g)([?]|$)")
    return d.withColumn("direct", direct).withColumn("priority", class_priority(F.col("classification"), F.col("direct")))


def queue_items(links: DataFrame, application: str, action: str = "download", shards: int = 256) -> DataFrame:
    """Idempotent queue rows: the id is a digest of application, address and action, so a second insert is the same row."""
    from strataweave.functions.scalars import hash_shard

    key = F.concat_ws("\n", application, "url", F.lit(action))
    return links.withColumn("item_id", F.substring(F.sha2(key.cast("binary"), 256), 1, 24)).dropDuplicates(["item_id"]).withColumn("shard", hash_shard(application, shards))


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row, cells) of HTML tables."""
    trs = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    r = pages.select(id_col, F.posexplode(trs).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_html)
    return r.select(id_col, "row", cells.alias("cells")).where("size(cells) > 0")


def cdx_captures(payload: DataFrame, col: str) -> DataFrame:
    """Captures of a CDX answer in JSON (a header row, then rows): well-formed ones with a 14-digit time and a safe address."""
    rows = F.from_json(col, "array<array<string>>")
    d = payload.select(rows.alias("r")).where("size(r) > 1").select(F.col("r")[0].alias("h"), F.explode(F.slice("r", 2, F.size("r"))).alias("c")).where("size(h) = size(c)")
    d = d.select(F.map_from_arrays("h", "c").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    out = d.select(*map(get, ("timestamp", "original", "statuscode", "mimetype", "digest"))).where(F.col("timestamp").rlike(r"^\d{14}$") & is_safe_url("original"))
    return out.withColumn("replay_url", F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("id_/"), "original")).withColumn("captured_at", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")))


def crawl_index(lines: DataFrame, col: str = "value") -> DataFrame:
    """Records of a crawl index in NDJSON: status 200, a file below crawl-data/, whole offsets; newest first by ``timestamp``."""
    j = lines.select(F.from_json(col, "url string, timestamp string, status string, filename string, offset string, length string, mime string").alias("j")).select("j.*")
    ok = (F.col("status") == "200") & F.col("filename").startswith("crawl-data/") & F.col("offset").rlike(r"^\d+$") & F.col("length").rlike(r"^\d+$") & is_safe_url("url")
    return j.where(ok).withColumns({"offset": F.col("offset").cast("bigint"), "length": F.col("length").cast("bigint")})


# Fixed values of the two functions below: what a title block and a level label look like.
def title_block(text: Column) -> Column:
    """struct(scale, scale_ambiguous, drawing_number, revision, status): a scale only where it is the only one."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    scales = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\bscale\s*(?:at\s*)?1\s*[:/]\s*(\d{1,6})\b"), F.lit(1)), lambda s: s.cast("int")))
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.struct(
        F.when(F.size(scales) == 1, scales[0]).alias("scale"), (F.size(scales) > 1).alias("scale_ambiguous"),
        first(r"(?i)\b(?:drawing|dwg)\s*(?:no\.?|number|ref\.?)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{2,})").alias("drawing_number"),
        first(r"(?i)\b(?:rev(?:ision)?\.?)\s*[:#-]?\s*([A-Z0-9]{1,8})\b").alias("revision"),
        F.lower(first(r"(?i)\bstatus\s*[:#-]?\s*(planning|construction|tender|as[- ]built|preliminary|approved|proposed)\b")).alias("status"),
    )


def levels(items: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., label, value_m, confidence): labelled levels (.90) and values before AOD (.82), each once."""
    labelled = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FFL|SSL|AOD|RL|R\.?L\.?|GROUND LEVEL|GL|RIDGE|EAVES?|TOW|BOW|TOP OF WALL|BOTTOM OF WALL)\s*[:=]?\s*[+-]?\d{1,4}(?:\.\d{1,4})?"), F.lit(0))
    trailing = F.regexp_extract_all(text, F.lit(r"(?i)(?<![\d.])([+-]?\d{1,4}(?:\.\d{1,4})?)\s*m?\s*AOD\b"), F.lit(1))
    a = F.transform(labelled, lambda m: F.struct(F.upper(F.regexp_extract(m, r"(?i)^([A-Z ]*[A-Z])", 1)).alias("label"), F.regexp_extract(m, r"([+-]?\d{1,4}(?:\.\d{1,4})?)$", 1).cast("double").alias("value_m"), F.lit(0.90).alias("confidence")))
    b = F.transform(trailing, lambda m: F.struct(F.lit("AOD").alias("label"), m.cast("double").alias("value_m"), F.lit(0.82).alias("confidence")))
    both = items.select(*keep, F.explode(F.concat(a, b)).alias("l")).select(*keep, "l.*")
    return both.groupBy(*keep, "label", "value_m").agg(F.max("confidence").alias("confidence"))


def rule_matches(items: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, rule, confidence, best): rules (rule_no, name, pattern, confidence, suppresses) found in each text.

    A rule that another one found there suppresses is dropped; ``best`` marks the first by confidence, then rule number. The rules are a
    small fixed vocabulary, and their size is checked before they are broadcast.
    """
    if rules.count() > 2000:
        raise ValueError("a rule table is a vocabulary, not data")
    hit = items.select(key, F.lower(text).alias("_t")).join(F.broadcast(rules), F.expr("_t rlike pattern")).drop("_t", "pattern")
    gone = hit.select(key, F.explode("suppresses").alias("name")).distinct()
    left = hit.join(gone, [key, "name"], "left_anti").drop("suppresses")
    best = left.groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule_no")).alias("b"))
    return left.join(best, key).select(key, "name", "confidence", "rule_no", (F.col("rule_no") == F.col("b.rule_no")).alias("best"))


def raster_fallback(classification: Column, characters: Column, vectors: Column, meaningful: Column, images: Column) -> Column:
    """Why a page has to be read as an image; null if it needn't be."""
    drawing = classification.isin("site_plan", "floor_plan", "roof_plan", "elevation", "section", "ride_layout", "landscape_plan")
    return (
        F.when((images > 0) & (meaningful < 4) & (characters < 120), "image-dominant-page-with-insufficient-vector-evidence")
        .when((vectors == 0) & (characters < 30), "no-usable-vector-or-text-evidence").when(drawing & (meaningful == 0), "drawing-class-without-meaningful-vector-geometry")
    )


def write_container(df: DataFrame, path: str, key: str) -> None:
    """Gzip NDJSON parts and a header with the counts per key, for ``read_container`` to hold them against."""
    df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/rows")
    df.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/header")


def read_container(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The rows of a container, or an error where a count differs from its header."""
    rows = spark.read.schema(schema).json(f"{path}/rows")
    kind = rows.schema[key].dataType.simpleString()
    head = spark.read.schema(f"{key} {kind}, n bigint").json(f"{path}/header")
    bad = head.join(rows.groupBy(key).agg(F.count("*").alias("m")), key, "full").where("n is null or m is null or n != m")
    if not bad.isEmpty():
        raise ValueError(f"container {path} is incomplete: {bad.first()}")
    return rows
