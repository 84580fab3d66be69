"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.core.session import scratch, table
from strataweave.llm import bpe, curve_ann, decontam, mil_toxicity, ordinal_quality, shards, simhash, token_rollup, toolcalls, warc
from strataweave.llm.hashed_text import held_out


KEEP_TAIL = 0.5
N_SHARDS = 16
BPE_VERSION, WORD_VERSION = "byte_bpe_multi_50k", "white_space_words"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: provisional counts arrive, exact counts revise them (committed twice), null and empty texts are deleted."""
    docs = table(spark, sf_dir, "documents")
    ledger = token_rollup.TokenLedger(spark, scratch(spark, "token-ledger"))
    guess = (F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("bigint").alias("n_tokens")
    versions = F.explode(F.array(F.lit(BPE_VERSION), F.lit(WORD_VERSION))).alias("tokenizer")
    ledger.commit("arrive", docs.select("doc_id", "source", "lang", guess, versions))
    exact = token_rollup.count_tokens(docs, {BPE_VERSION: token_rollup.bpe_counter(), WORD_VERSION: lambda t: len(t.split())})
    ledger.commit("revise", exact)
    ledger.commit("revise", exact)
    ledger.commit("delete", deletes=docs.where("text is null or text = ''").select("doc_id"))
    return ledger.totals()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = ordinal_quality.score(docs.select("doc_id", "text"), model, keep_text=False)
    tail = F.col("_quality.tail")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_quality.expected_grade").alias("expected_grade"), tail.alias("tail_probability"), (tail >= KEEP_TAIL).alias("keep"))


SCHEMAS = {"lookup": {"chars": ("integer", True), "head": ("string", True), "prefer": ("string", False)}, "measure": {"chars": ("number", True), "exact": ("boolean", True)}}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as tool use: an assistant's turn calls a tool, the user's next turn is its result; other turns are messages.

    The table has no calls of its own, so names and arguments follow from the turn's length, some of them wrong on purpose of the rule.
    Dependencies follow from the turn: of every four calls the first needs the second, the third the first two, the fourth the third and the
    call after it; a call whose text length divides by 11 needs itself, a cycle.
    """
    conv = table(spark, sf_dir, "conversations")
    n, turn = F.length("text"), F.col("turn")
    ident = lambda t: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), t)
    name = F.when(n % 5 < 3, "lookup").when(n % 5 == 3, "measure").otherwise("guess")
    head = F.concat(F.lit("h"), (n % 11).cast("string"))
    args = (
        F.when(n % 5 == 0, F.concat(F.lit('{"head": "'), head, F.lit('", "chars": '), n.cast("string"), F.lit("}")))
        .when(n % 5 == 1, F.concat(F.lit('{"prefer":"x","head":"'), head, F.lit('"}')))
        .when(n % 5 == 2, F.concat(F.lit('{"head": 1, "chars": '), n.cast("string"), F.lit("}")))
        .when(n % 5 == 3, F.concat(F.lit('{"exact":true,"chars":'), n.cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit("chars "), n.cast("string")))
    )
    q = F.floor((turn - 1) / 2) % 4
    own = F.when(n % 11 == 0, ident(turn))
    needs = F.when(q == 0, F.array(ident(turn + 2), own)).when(q == 2, F.array(ident(turn - 2), ident(turn - 4), own)).when(q == 3, F.array(ident(turn - 2), ident(turn + 2), own)).otherwise(F.array(own))
    calls = conv.where("role = 'assistant'").select("conv_id", "turn", ident(turn).alias("call_id"), name.alias("name"), args.alias("arguments"), needs.alias("depends_on"))
    results = conv.where("role = 'user' and turn > 0").select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    linked = toolcalls.link(calls, results, SCHEMAS)
    plain = conv.where("role is null or role not in ('assistant', 'user') or (role = 'user' and (turn <= 0 or turn is null))")
    lines = linked.union(plain.select("conv_id", "turn", F.lit(0).alias("level"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), toolcalls.message_json(F.col("role"), F.col("text")).alias("json")))
    return lines.select("conv_id", "turn", "level", "kind", "call_id", "status", F.sha2("json", 256).alias("json_sha256"))


OP5_SQL = """
WITH RECURSIVE c AS (SELECT *, length(text) AS n FROM conversations),
q AS (SELECT conv_id, turn, role, text, n, 'call_' || conv_id || '_' || turn AS call_id, 'call_' || conv_id || '_' || (turn - 1) AS answers, to_json(text)::VARCHAR AS js FROM c),
calls AS (
  SELECT conv_id, turn, call_id,
    CASE WHEN n % 5 < 3 THEN 'lookup' WHEN n % 5 = 3 THEN 'measure' ELSE 'guess' END AS name,
    CASE n % 5 WHEN 0 THEN '{"chars":' || n || ',"head":"h' || (n % 11) || '"}' WHEN 1 THEN '{"head":"h' || (n % 11) || '","prefer":"x"}'
      WHEN 2 THEN '{"chars":' || n || ',"head":1}' WHEN 3 THEN '{"chars":' || n || ',"exact":true}' ELSE '"chars ' || n || '"' END AS args,
    CASE n % 5 WHEN 1 THEN 'missing:chars' WHEN 2 THEN 'type:head' WHEN 4 THEN 'unknown_tool' END AS bad
  FROM q WHERE role = 'assistant'),
results AS (SELECT conv_id, turn, answers AS call_id, js FROM q WHERE role = 'user' AND turn > 0),
a AS (SELECT conv_id, turn, n, (turn - 1) // 2 % 4 AS k FROM q WHERE role = 'assistant'),
needs AS (
  SELECT conv_id, turn, turn + 2 AS dep FROM a WHERE k IN (0, 3) UNION ALL SELECT conv_id, turn, turn - 2 FROM a WHERE k IN (2, 3)
  UNION ALL SELECT conv_id, turn, turn - 4 FROM a WHERE k = 2),
edges AS (SELECT x.conv_id, x.turn, dep, CASE WHEN dep < x.turn THEN 0 ELSE 1 END AS step FROM needs x JOIN a y ON y.conv_id = x.conv_id AND y.turn = dep),
chains AS (SELECT conv_id, turn, dep, step FROM edges UNION ALL SELECT c.conv_id, c.turn, e.dep, c.step + e.step FROM chains c JOIN edges e ON e.conv_id = c.conv_id AND e.turn = c.dep),
below AS (SELECT conv_id, turn, max(step) AS level, bool_or(dep IN (SELECT b.turn FROM a b WHERE b.conv_id = chains.conv_id AND b.n % 11 = 0)) AS over FROM chains GROUP BY ALL),
order_of AS (SELECT a.conv_id, a.turn, a.n % 11 = 0 OR coalesce(over, false) AS cyclic, coalesce(level, 0)::INT AS level FROM a LEFT JOIN below USING (conv_id, turn))
SELECT conv_id, c.turn AS turn, CASE WHEN NOT cyclic THEN level END AS level, 'tool_call' AS kind, c.call_id AS call_id,
  CASE WHEN cyclic THEN 'cycle' WHEN bad IS NOT NULL THEN bad WHEN r.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  sha256('{"arguments":' || args || ',"id":"' || c.call_id || '","name":"' || name || '","result":' ||
    CASE WHEN r.turn IS NULL THEN 'null' ELSE '{"content":' || r.js || ',"turn":' || r.turn || '}' END || ',"role":"tool_call"}') AS json_sha256
FROM calls c LEFT JOIN results r USING (conv_id, call_id) JOIN order_of o ON o.conv_id = conv_id AND o.turn = c.turn
UNION ALL
SELECT conv_id, turn, 0, 'tool_result', call_id, 'orphan', sha256('{"content":' || js || ',"id":"' || call_id || '","role":"tool_result"}')
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
UNION ALL
SELECT conv_id, turn, 0, 'message', NULL, 'ok', sha256('{"content":' || js || ',"role":"' || role || '"}')
FROM q WHERE role NOT IN ('assistant', 'user') OR (role = 'user' AND turn <= 0)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = mil_toxicity.score(docs.select("doc_id", "text"), model, keep_text=False)
    s = F.col("_toxic.score")
    worst = F.aggregate("_toxic.sentences", F.struct(F.lit(-1.0).alias("p"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to")), lambda a, x: F.when(x["p"] > a["p"], F.struct(x["p"].alias("p"), x["from"].alias("from"), x["to"].alias("to"))).otherwise(a))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.size("_toxic.sentences").alias("n_offending"), worst["from"].alias("worst_from"), worst["to"].alias("worst_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path)
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m USING (h)
"""


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curve_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cut = shards.hilbert_shards(narrow, shards.document_cells(), N_SHARDS, ["text_crc32", "size", "doc_id"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest([array_to_string(words[i : i + least(10, len(words)) - 1], ' ') FOR i IN range(1, len(words) - least(10, len(words)) + 2)]) AS win
  FROM b WHERE len(words) > 0),
dw AS (
  SELECT doc_id, n, pos, array_to_string(words[pos : pos + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS pos FROM w, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT d.doc_id, d.n, d.pos, item_id FROM dw d JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, n, pos FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def queries() -> dict:
    import corpus_pipeline

    named = (op1_simhash, op2_token_rollup, op3_bpe, op4_quality, op5_tool_calls, op6_toxicity, op7_warc, op8_neighbours, op9_hilbert_shards, op10_decontamination)
    return {**{f.__name__: f for f in named}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """What DuckDB can say too. Fingerprints, BPE, learned scores, CRC-32 and nearest neighbours have brute-force tests instead."""
    return {"op5_tool_calls": OP5_SQL, "op7_warc": OP7_SQL, "op10_decontamination": OP10_SQL}
