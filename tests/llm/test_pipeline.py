import hashlib
import struct

import corpus_pipeline
from strataweave.llm import bpe, mil_toxicity, ordinal_quality
from tests.llm.test_decontam import brute as brute_windows
from tests.llm.test_simhash import brute_components, brute_fp


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    quality_model = ordinal_quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = set(before), {r.doc_id for r in after.collect()}
        if name == "quality":
            memo = quality_model.scorer()
            want = {i for i, r in before.items() if quality_model.tails(quality_model.worth(r.text, memo))[0] >= 0.5}
        elif name == "toxicity":
            model = mil_toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            memo = model.scorer()
            want = {i for i, r in before.items() if mil_toxicity.noisy_or(model.sentence_scores(r.text, memo)[1]) < 0.5}
        elif name == "near_duplicates":
            comp = brute_components({i: brute_fp(r.text) for i, r in before.items()})
            want = {i for i in before if comp[i] == i}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = {i for i, *_, bad in brute_windows([(i, r.text) for i, r in before.items()], bench) if not bad}
        else:
            want, enc = set(before), bpe._encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)
            for r in after.collect():
                ids = enc.encode_ordinary(before[r.doc_id].text)
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()
        assert seen[name][1] == want
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and 0 < len(seen[name][1]) <= len(before)
        docs = after
    assert len(seen["decontamination"][0]) > len(seen["decontamination"][1])


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns: a defined result at every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.where("length(text) > 200").orderBy("doc_id").first()
    long = " ".join([good.text] * 200)
    rows = [tuple(good), tuple(good), (None, good.text, None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "", "en", "s", 0), (9004, long, "en", "s", len(long)), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'mine' as tail", "1 as score", "2 as n_tokens", "3 as ids", "'c' as component_id", "4 as items")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        got = out.collect()
        assert all(r.tail == "mine" and r.items == 4 for r in got)
        if name == "quality":
            kept = [r.text for r in got]
            assert kept.count(good.text) in (0, 3) and kept.count("") + kept.count(None) in (0, 4)
        elif name == "toxicity":
            assert len(got) in (8, 5, 7, 4) and sum(r.text in (None, "") for r in got) == 4
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in got) in ([good.doc_id, 9001], [good.doc_id, 9001, 9004])
        else:
            assert sum(r.text in (None, "") for r in got) == 4
    out = {}
    for r in corpus_pipeline.tokens(spark, odd, sf).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {good.doc_id: 2, None: 2, 9001: 1, 9002: 1, 9003: 1, 9004: 1}
    assert out[9001][0].n_tokens == out[9002][0].n_tokens == 0
    assert out[good.doc_id][0].ids_sha256 in {r.ids_sha256 for r in out[None]}
    assert out[9004][0].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
