import random
import zlib

import numpy as np

from strataweave.llm import mil_toxicity, ordinal_quality
from strataweave.llm.hashed_text import held_out, labelled_sample, shape

CLEAN = "the river bend held a quiet light over green fields while birds crossed morning air".split()


def text(rnd, n, *odd):
    out = []
    for i in range(n):
        w = [rnd.choice(CLEAN) for _ in range(rnd.randrange(4, 12))]
        out.append(" ".join(w).capitalize() + ".")
    for o in odd:
        k = rnd.randrange(len(out))
        out[k] = out[k][:-1] + f" {o} indeed."
    return " ".join(out)


def test_noisy_or():
    assert mil_toxicity.noisy_or(np.array([])) == 0
    assert abs(mil_toxicity.noisy_or(np.array([0.5, 0.5])) - 0.75) < 1e-12
    assert mil_toxicity.noisy_or(np.array([1.0, 0.2])) <= 1


def test_sentences_cover_long_runs():
    t = "one two. " + " ".join(f"w{i}" for i in range(130)) + "! 漢字\n\n..."
    got = list(mil_toxicity.sentences(t))
    assert [len(w) for *_, w in got] == [2, 48, 48, 34, 1]
    assert all(t[a:b].lower().split()[0].strip(".!") == w[0] for a, b, w in got)


def test_learns_sentences_from_document_labels(spark):
    rnd = random.Random(5)
    rows = [(i, text(rnd, 8, *(["vilewort"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = mil_toxicity.fit(docs, labels)
    got = {r.doc_id: r._toxic for r in mil_toxicity.score(docs, model).collect()}
    for i, t, y in rows:
        assert (got[i].score >= 0.5) == bool(y)
        if y:
            assert [t[s["from"] : s["to"]].find("vilewort") >= 0 for s in got[i].sentences] == [True]


def test_toxicity_odd_cases(spark):
    model = mil_toxicity.fit_texts(["bad", "good"], np.array([1, 0]))
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x " * 50_000, 1)], "doc_id bigint, text string, toxic int")
    out = mil_toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "_toxic"] and out.count() == 4
    assert all(0 <= r._toxic.score <= 1 for r in out.collect())
    assert mil_toxicity.score(docs.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert mil_toxicity.score(docs, mil_toxicity.fit(docs, empty)).where("_toxic.score >= 0.5").count() == 0


def test_held_out_toxicity_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = mil_toxicity.score(docs.join(labels, "doc_id"), mil_toxicity.fit(docs, labels))
    rows = out.where(held_out("doc_id")).selectExpr("toxic", "_toxic.score >= 0.5 as p").collect()
    assert all(r.p is not None for r in rows)
    hit = [r.p for r in rows if r.toxic]
    miss = [r.p for r in rows if not r.toxic]
    assert np.mean(hit) > 0.85 and np.mean(miss) < 0.02


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in [*range(60), None]], "doc_id bigint").withColumn("h", held_out("doc_id"))
    for r in df.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_sample_is_bounded_and_disjoint(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (4, None), (4, 1)], "doc_id bigint, toxic int")
    texts, y, sizes = labelled_sample(docs, labels, "toxic", 50, 100)
    assert len(texts) == 100 and list(np.bincount(y)) == [50, 50]
    assert not any(zlib.crc32(t[1:].encode()) % 5 == 0 for t in texts)
    assert sum(sizes.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(500))


def test_shape():
    assert shape("Hello!!") == "Aa!!" and shape("ABC12x") == "A0a" and shape("") == ""


def test_ordinal_grades(spark):
    rnd = random.Random(6)
    junk = ["%%%", "###", "BUY!!"]

    def doc(g):
        words = [rnd.choice(CLEAN) for _ in range(60)]
        for _ in range((3 - g) * 8):
            words[rnd.randrange(60)] = rnd.choice(junk)
        return " ".join(words)

    rows = [(i, doc(i % 4), i % 4) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    model = ordinal_quality.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r._quality for r in ordinal_quality.score(docs, model, tail_from=2).collect()}
    grades = np.array([got[i].expected_grade for i, *_ in rows])
    means = [grades[[y == g for *_, y in rows]].mean() for g in range(4)]
    assert means == sorted(means) and np.mean(np.abs(grades - [y for *_, y in rows])) < 0.5
    assert np.mean([(got[i].tail >= 0.5) == (y >= 2) for i, _, y in rows]) > 0.9
    assert np.allclose(np.diff(model.grades) @ model.tails(0.3) + model.grades[0], sum(g * p for g, p in zip(model.grades, -np.diff(np.r_[1, model.tails(0.3), 0]))))


def test_quality_odd_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x " * 50_000, 1)], "doc_id bigint, text string, tail int")
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    out = ordinal_quality.score(docs, ordinal_quality.fit(docs, empty))
    assert out.count() == 4 and {r._quality.tail for r in out.collect()} == {1.0}
    model = ordinal_quality.fit_texts(["a b", "C!! D!!"] * 8, np.array([1, 0] * 8))
    assert ordinal_quality.score(docs, model).columns == ["doc_id", "text", "tail", "_quality"]
    assert ordinal_quality.score(docs.limit(0), model).count() == 0


def test_held_out_quality_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = ordinal_quality.score(docs.join(labels, "doc_id"), ordinal_quality.fit(docs, labels))
    rows = out.where(held_out("doc_id")).selectExpr("quality", "_quality.tail >= 0.5 as p").collect()
    assert np.mean([r.p == bool(r.quality) for r in rows]) > 0.97


def test_sample_takes_one_text_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i, f"{c} {i}") for i in range(60) for c in "dbac"], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    texts, y, sizes = labelled_sample(docs, labels, "toxic", 10, 100)
    assert list(np.bincount(y)) == [10, 10] and all(t.startswith("a ") for t in texts)
    assert all(int(t[2:]) % 2 == k for t, k in zip(texts, y))


def test_every_grade_is_sampled_and_repeats_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"t{i} w{i % 100}") for i in range(1000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 100) for i in range(1000)], "doc_id bigint, quality int")
    texts, y, sizes = labelled_sample(docs, labels, "quality", 5, 100)
    assert set(y.tolist()) == set(range(100)) == set(sizes) and max(np.bincount(y)) <= 5
    six = docs
    for _ in range(5):
        six = six.union(docs)
    again = labelled_sample(six, labels, "quality", 5, 100)
    assert again[0] == texts and (again[1] == y).all() and again[2] == sizes
    hot = docs.union(spark.range(5000).selectExpr("7L as doc_id", "concat('t7 w', id) as text"))
    texts, y, _ = labelled_sample(hot, labels, "quality", 5, 100)
    assert len(texts) == len(y) <= 500 and len(set(texts)) == len(texts)


def test_repeated_rows_keep_the_toxic_class(spark):
    rnd = random.Random(9)
    rows = [(i, text(rnd, 6, *(["vilewort"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 6, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    out = mil_toxicity.score(docs, mil_toxicity.fit(docs, labels, per_class=40))
    got = {r.doc_id: r.p for r in out.selectExpr("doc_id", "_toxic.score >= 0.5 as p").collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) >= 396


def plain_worth(text, model):
    """The worth of a text, from its definition: no tables, no memo."""
    import re

    import xxhash

    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    words = re.findall(r"\S+", text)
    if not words:
        return float(model.whole[1] + model.whole[3])
    total = 0.0
    for w in words:
        for f in ("w" + w.lower(), "s" + shape(w), "e" + w[-2:]):
            total += weight.get(xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass"), 7) % 2**20, 0.0)
    whole = [np.log1p(len(words)) / 8, len(set(words)) / len(words), min(sum(len(w) for w in words) / len(words), 40) / 8, 0.0]
    return total / len(words) + float(np.dot(whole, model.whole))


def plain_toxicity(text, model):
    import re

    import xxhash

    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    none = 1.0
    for piece in re.split(r"[.!?\n]+", text):
        words = re.findall(r"\w+", piece.lower())
        for k in range(0, len(words), 48):
            total = model.bias
            for w in set(words[k : k + 48]):
                for f in ["w" + w, *(["4" + w[:4]] if len(w) > 4 else []), *(["5" + w[:5]] if len(w) > 5 else [])]:
                    total += weight.get(xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass"), 7) % 2**20, 0.0)
            none *= 1 - 1 / (1 + np.exp(-np.clip(total, -60, 60)))
    return 1 - none


def test_op4_query_against_brute_force(spark, sf):
    from strataweave.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal_quality.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        tails = 1 / (1 + np.exp(-(plain_worth(t, model) - model.thresholds)))
        grade = model.grades[0] + sum((b - a) * p for a, b, p in zip(model.grades, model.grades[1:], tails))
        assert abs(got[i].tail_probability - tails[0]) < 1e-9 and abs(got[i].expected_grade - grade) < 1e-9
        assert got[i].keep == (tails[0] >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op6_query_against_brute_force(spark, sf):
    from strataweave.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = mil_toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        p = plain_toxicity(t, model)
        assert abs(got[i].score - p) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if got[i].n_offending:
            assert 0 <= got[i].worst_from < got[i].worst_to <= len(t)
