"""Fusing sources: precedence, replacement, edits, aliases, collisions, provider planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import clamp, half_up, provider_resolution_score


def union_by_precedence(*sources: DataFrame, key: str) -> DataFrame:
    """All rows of the first source, and of each later one those whose key no earlier one has."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def replace_rows(base: DataFrame, incoming: DataFrame, key: str, replaces: str) -> DataFrame:
    """``base`` without the targets of ``incoming``, with ``incoming`` itself."""
    return base.join(incoming.select(F.col(replaces).alias(key)).where(f"{key} is not null").distinct(), key, "left_anti").unionByName(incoming.drop(replaces), allowMissingColumns=True)


def apply_edits(base: DataFrame, edits: DataFrame, key: str = "id", tags: str = "tags") -> DataFrame:
    """A merge: ``edits`` (edit_id, operation, target, tags, ...) over ``base`` (id, tags).

    delete drops the target; retag merges tags, the edit winning; replace, and auto with a target, put the edit in the target's place; add, and
    replace or auto without a target, add it. Each row says what happened (``action``) and keeps the tags that it superseded
    (``history``). A deletion or retagging without a target does nothing. Of several edits of one target the one with the largest
    edit_id stands, the others are superseded.
    """
    e = edits.select("edit_id", "operation", F.col("target"), F.col(tags).alias("edit_tags"))
    last = e.where("target is not null").groupBy("target").agg(F.max_by(F.struct("edit_id", "operation", "edit_tags"), "edit_id").alias("e"))
    hit = base.join(last, base[key] == last["target"], "left")
    op = F.col("e.operation")
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(F.col(tags), lambda k, v: ~F.array_contains(F.map_keys(F.col("e.edit_tags")), k)), F.col("e.edit_tags")))))
    kept = hit.where(op.isNull() | (op != "delete")).select(
        F.when(op.isin("replace", "auto"), F.col("e.edit_id")).otherwise(F.col(key)).alias(key),
        F.when(op.isin("replace", "auto"), F.col("e.edit_tags")).when(op == "retag", merged).otherwise(F.col(tags)).alias(tags),
        F.when(op.isNull() | (op == "add"), "kept").when(op == "retag", "retagged").otherwise("replaced").alias("action"),
        F.when(op.isin("replace", "auto", "retag"), F.array(F.col(tags))).otherwise(F.array().cast("array<map<string,string>>")).alias("history"),
    )
    lost = e.join(base.select(F.col(key).alias("target")), "target", "left_anti")
    new = e.where("operation = 'add'").unionByName(lost.where("operation in ('replace', 'auto')")).select(F.col("edit_id").alias(key), F.col("edit_tags").alias(tags), F.lit("added").alias("action"), F.array().cast("array<map<string,string>>").alias("history"))
    none = e.where("operation in ('replace', 'auto') and target is null").select(F.col("edit_id").alias(key), F.col("edit_tags").alias(tags), F.lit("added").alias("action"), F.array().cast("array<map<string,string>>").alias("history"))
    return kept.unionByName(new.unionByName(none).dropDuplicates([key]))


def inherit_tags(replaced: DataFrame, group: str, tags: str = "tags") -> DataFrame:
    """Tags on which all replaced rows of a group that have the key agree, and the keys on which they don't."""
    kv = replaced.select(group, F.explode(tags).alias("k", "v")).groupBy(group, "k").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
    entry = F.when(F.col("n") == 1, F.struct("k", "v"))
    return kv.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tags"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("k")))).alias("conflicts"))


def resolve_collisions(changes: DataFrame, target: str, signature: str, score: str, tie: str) -> DataFrame:
    """Changes of one target: alike, the best stays and the others are ignored; different, all go to review."""
    n = changes.groupBy(target).agg(F.count_distinct(signature).alias("_sigs"), F.count("*").alias("_n"), F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias("_best"))
    out = changes.join(n, target)
    action = F.when(F.col("_n") == 1, "keep").when(F.col("_sigs") > 1, "review").when(F.col(tie) == F.col("_best.t"), "keep").otherwise("ignored")
    return out.withColumn("action", action).drop("_sigs", "_n", "_best")


def collapse_aliases(rows: DataFrame, id_col: str, text_col: str, strength: str, least: int = 40) -> DataFrame:
    """(id, alias_of): rows with equal long text collapse into the strongest, only where it is strictly stronger; ties in the target go to the smaller id."""
    key = F.when(F.length(text_col) >= least, F.sha2(F.col(text_col).cast("binary"), 256))
    keyed = rows.select(F.col(id_col).alias("id"), F.col(strength).alias("s"), key.alias("k"))
    best = keyed.where("k is not null").groupBy("k").agg(F.min(F.struct((-F.col("s")).alias("neg"), F.col("id").alias("id"))).alias("b"))
    j = keyed.join(best, "k", "left")
    return j.select(F.col("id").alias(id_col), F.when(F.col("s") < -F.col("b.neg"), F.col("b.id")).alias("alias_of"))


def reference_aliases(rows: DataFrame, id_col: str, reference: str, text: str, strength: str) -> DataFrame:
    """(id, alias_of, reason): a record that is another one under a suffix of its reference, or that names the other's reference in its text.

    The target must have a strictly greater strength, else the record stays its own. References of fewer than six characters are no evidence; a
    reference in a text is met word by word, so a text leads only to references whose words it has. The suffix comes first; then the strongest, then the smaller id.
    """
    key = F.upper(F.trim(F.regexp_replace(F.col(reference), r"\s+", " ")))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    r = rows.select(F.col(id_col).alias("id"), key.alias("ref"), plain(F.col(text)).alias("t"), plain(key).alias("words"), F.col(strength).alias("s"))
    first = r.where("ref is not null and ref != ''").groupBy("ref").agg(F.min(F.struct("id", "s")).alias("m")).select("ref", F.col("m.id").alias("to"), F.col("m.s").alias("to_s"))
    # Suffixes of a reference that mean a consultation on the same application.
    base = F.regexp_replace("ref", r"\s+(?:MSA|CONSULTATION|CONSULT|CON)$", "")
    suffix = r.withColumn("base", F.trim(base)).where("base != ref and base != ''").join(first.withColumnRenamed("ref", "base"), "base").select("id", "s", "to", "to_s", F.lit(0).alias("rank"))
    n = F.size(F.split("words", " "))
    named = r.where("length(words) >= 6").select("words", F.col("id").alias("to"), F.col("s").alias("to_s"), n.alias("n"))
    lengths = sorted(x[0] for x in named.select("n").distinct().collect())  # references have a handful of words
    tokens = F.split("t", " ")
    spans = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(0)), F.lit(1)) if k == 1 else F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - k + 1)).otherwise(F.array().cast("array<int>")), lambda i, k=k: F.array_join(F.slice(tokens, i, k), " ")) for k in lengths])) if lengths else F.array().cast("array<string>")
    said = r.select("id", "s", F.explode(F.array_distinct(spans)).alias("words")).join(named, "words").where("id != to").select("id", "s", "to", "to_s", F.lit(1).alias("rank"))
    best = suffix.union(said).where("id != to").groupBy("id").agg(F.min(F.struct("rank", (-F.col("to_s")).alias("o"), "to", "to_s", "s")).alias("b"))
    good = F.col("b.to_s") > F.col("b.s")
    out = r.select("id").join(best, "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(good, F.col("b.to")).alias("alias_of"), F.when(good & (F.col("b.rank") == 0), "reference-suffix-alias").when(good, "explicit-related-application-reference").alias("reason"))


def catalogue(docs: DataFrame, content: str, source: str, id_col: str) -> DataFrame:
    """One row per content hash: first id, distinct sources, how many copies it stands for."""
    h = F.sha2(F.col(content).cast("binary"), 256)
    return docs.groupBy(h.alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.array_sort(F.collect_set(source)).alias("sources"), (F.count("*") - 1).alias("duplicates"))


def provider_scores(providers: DataFrame, target: dict[str, float], min_score: float = 0.2, preferred: tuple[str, ...] = ()) -> DataFrame:
    """Providers (provider_id, kind, south, west, north, east, authority, freshness, directness, completeness, resolution_m, sparse, discovery, implemented), one row per kind, scored for a target box.

    Boxes that cross the date line (west > east) are two intervals of longitude.
    """
    def spans(w, e):
        return F.when(w <= e, F.array(F.struct(w.alias("a"), e.alias("b")))).otherwise(F.array(F.struct(w.alias("a"), F.lit(180.0).alias("b")), F.struct(F.lit(-180.0).alias("a"), e.alias("b"))))

    t = {k: F.lit(float(v)) for k, v in target.items()}
    mine, theirs = spans(t["west"], t["east"]), spans(F.col("west"), F.col("east"))
    shared = F.aggregate(mine, F.lit(0.0), lambda s, p: s + F.aggregate(theirs, F.lit(0.0), lambda u, q: u + F.greatest(F.lit(0.0), F.least(p["b"], q["b"]) - F.greatest(p["a"], q["a"]))))
    width = F.aggregate(mine, F.lit(0.0), lambda s, p: s + p["b"] - p["a"])
    high = F.greatest(F.lit(0.0), F.least(t["north"], F.col("north")) - F.greatest(t["south"], F.col("south")))
    ratio = half_up(clamp(high * F.least(width, shared) / F.greatest(F.lit(1e-12), (t["north"] - t["south"]) * width)), 4)
    score = half_up(
        clamp(
            ratio * 0.26 + clamp("authority") * 0.21 + clamp("freshness") * 0.12 + clamp("directness") * 0.12 + clamp("completeness") * 0.2
            + provider_resolution_score("resolution_m", "kind") * 0.09 + F.when(F.col("provider_id").isin(*preferred), 0.08).otherwise(0.0)
            - F.when(F.col("sparse"), 0.12).otherwise(0.0) - F.when(F.col("discovery"), 0.05).otherwise(0.0)
        ),
        4,
    )
    return providers.withColumns({"coverage_ratio": ratio, "score": score}).where((F.col("coverage_ratio") > 0) & (F.col("score") >= min_score))


def source_plan(scored: DataFrame, kinds: list[str], max_per_kind: int = 5) -> DataFrame:
    """Per requested kind: recommended (the best), selected (the best that is implemented among the first ``max_per_kind``), gap reason."""
    w = Window.partitionBy("kind").orderBy(F.col("score").desc(), F.coalesce("resolution_m", F.lit(float("inf"))), "provider_id")
    top = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_per_kind)
    picked = top.groupBy("kind").agg(F.min_by("provider_id", "rn").alias("recommended"), F.min_by(F.when(F.col("implemented"), F.col("provider_id")), F.when(F.col("implemented"), F.col("rn"))).alias("selected"), F.count("*").alias("candidates"))
    wanted = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    out = wanted.join(picked, "kind", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("bigint")))
    return out.withColumn("gap", F.when(F.col("selected").isNotNull(), None).when(F.col("recommended").isNotNull(), "adapter-not-implemented").otherwise("no-provider-with-bbox-coverage"))


def after_decision(observations: DataFrame, decisions: DataFrame, key: str, seen: str, decided: str) -> DataFrame:
    """Observations strictly later than the latest decision on their key; without a decision none is proof."""
    last = decisions.groupBy(key).agg(F.max(decided).alias("decided_at"))
    return observations.join(last, key).where(F.col(seen) > F.col("decided_at"))


def proof_confidence(anchors: Column, features: Column) -> Column:
    return F.least(F.lit(0.96), 0.84 + F.least(F.lit(0.1), 0.015 * features) + F.least(F.lit(0.02), 0.001 * anchors))


def level_heights(observations: DataFrame) -> DataFrame:
    """(feature_id, height, confidence, page): of each page the highest top above the median base, in 1.5 to 100 m; of the pages the most confident, then the higher, then the first."""
    label = F.upper(F.trim("label"))
    base = label.rlike(r"^(FFL|SSL|AOD|GROUND LEVEL|GL|BOW|BOTTOM OF WALL)$")
    top = label.rlike(r"^(RIDGE|EAVES?|TOW|TOP OF WALL)$")
    conf = F.coalesce("confidence", F.lit(0.8))
    pages = observations.groupBy("feature_id", "page").agg(F.median(F.when(base, F.col("value_m"))).alias("b"), F.max(F.when(top, F.col("value_m"))).alias("t"), F.min(F.when(base | top, conf)).alias("c"))
    good = pages.withColumn("height", F.col("t") - F.col("b")).where("height between 1.5 and 100").withColumn("confidence", F.col("c") * 0.92)
    best = good.groupBy("feature_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("height")).alias("h"), F.col("page").alias("p"))).alias("m"))
    return best.select("feature_id", (-F.col("m.h")).alias("height"), (-F.col("m.c")).alias("confidence"), F.col("m.p").alias("page"))


def latest_revisions(drawings: DataFrame, lineage: str, rev: Column, id_col: str) -> DataFrame:
    """Per lineage the latest drawing, or null and status 'ambiguous' where revisions can't be compared or the latest is not unique. Never guessed from dates."""
    d = drawings.select(lineage, id_col, rev.alias("r"))
    one = F.count_distinct(F.when(F.col("r").isNotNull(), F.concat_ws("|", F.col("r.kind"), F.col("r.prefix"))))
    g = d.groupBy(lineage).agg(one.alias("families"), F.count_if(F.col("r").isNull()).alias("unknown"), F.max("r.number").alias("top"), F.count("*").alias("n"))
    at_top = d.join(g, lineage).where(F.col("r.number") == F.col("top")).groupBy(lineage).agg(F.min(id_col).alias("latest"), F.count("*").alias("tops"))
    j = g.join(at_top, lineage, "left")
    clear = (F.col("families") == 1) & (F.col("unknown") == 0) & (F.col("tops") == 1)
    alone = (F.col("n") == 1) & (F.col("families") == 1)
    return j.select(lineage, F.when(clear | alone, F.col("latest")).alias("latest"), F.when(clear | alone, "latest").otherwise("ambiguous").alias("status"), "n")
