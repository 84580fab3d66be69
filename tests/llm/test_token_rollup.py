import pytest

from strataweave.llm import queries
from strataweave.llm.token_rollup import TokenLedger, bpe_counter, count_tokens

UP = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"


def totals(ledger):
    return sorted((tuple(r) for r in ledger.totals().collect()), key=str)


def brute(state):
    out = {}
    for (_, tok), (src, lang, n) in state.items():
        a = out.setdefault((src, lang, tok), [0, 0])
        a[0] += 1
        a[1] += n
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_deltas_follow_a_replayed_state(spark, tmp_path):
    led, state = TokenLedger(spark, str(tmp_path / "l")), {}
    assert totals(led) == []

    def commit(name, ups=(), dels=()):
        done = led.commit(name, spark.createDataFrame(list(ups), UP), spark.createDataFrame([(d,) for d in dels], "doc_id bigint"))
        for d in dels:
            for k in [k for k in state if k[0] == d]:
                del state[k]
        for d, s, l, t, n in sorted(ups, key=lambda r: (r[4], str(r[1]))):
            state[d, t] = (s, l, n)
        assert done and totals(led) == brute(state)

    commit("b1", [(i, f"s{i % 3}", "en" if i % 2 else None, v, i * 10) for i in range(30) for v in ("v1", "v2")])
    before = totals(led)
    assert led.commit("b1", spark.createDataFrame([(1, "s", "en", "v1", 10**6)], UP)) is False and totals(led) == before
    commit("b2", [(3, "s0", "en", "v1", 7), (4, "moved", "de", "v1", 1), (4, "moved", "de", "v1", 9), (99, None, None, "v1", 0)], [5, 6, 1234, 4])
    commit("b3", [(5, "s2", "en", "v1", 8)], [])
    commit("b4")
    commit("b5", [], list(range(100)))
    assert totals(led) == []


def test_broken_commit_is_written_anew(spark, tmp_path):
    led = TokenLedger(spark, str(tmp_path / "l"))
    spark.createDataFrame([(1, "s", "en", "v", 1, 999)], "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint").write.parquet(led._at("entries", "b1"))
    assert totals(led) == []
    led.commit("b1", spark.createDataFrame([(1, "s", "en", "v", 5), (None, "s", "en", "v", 2), (None, "s", "en", "v", 2)], UP))
    assert totals(led) == [("s", "en", "v", 3, 9)]
    with pytest.raises(ValueError):
        led.commit("../x")


def test_counts_and_query(spark, sf):
    docs = spark.createDataFrame([(1, None, "a", "en", 1), (2, "", "a", None, 1), (3, "two  words", None, "en", 1)], "doc_id bigint, text string, source string, lang string, n_tokens int")
    got = sorted((r.doc_id, r.tokenizer, r.n_tokens) for r in count_tokens(docs, {"w": lambda t: len(t.split())}).collect())
    assert got == [(1, "w", 0), (2, "w", 0), (3, "w", 2)]
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    count, want = bpe_counter(), {}
    for r in rows:
        for name, n in ((queries.BPE_VERSION, count(r.text)), (queries.WORD_VERSION, len(r.text.split()))):
            a = want.setdefault((r.source, r.lang, name), [0, 0])
            a[0], a[1] = a[0] + 1, a[1] + n
    have = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in queries.op2_token_rollup(spark, sf).collect()}
    assert have == want


def test_a_commit_counts_each_text_once_and_reads_its_buckets(spark, tmp_path):
    calls = tmp_path / "calls"

    def counter(t):
        with open(calls, "a") as f:
            f.write("x")
        return len(t)

    docs = spark.createDataFrame([(i, "a" * i, "s", "en") for i in range(50)] + [(None, "long " * 20_000, "s", "en")], "doc_id bigint, text string, source string, lang string")
    led = TokenLedger(spark, str(tmp_path / "l"))
    led.commit("b1", count_tokens(docs, {"v": counter}))
    assert calls.stat().st_size == 51 and totals(led) == [("s", "en", "v", 51, 100_000 + sum(range(50)))]
    assert len(list((tmp_path / "l" / "entries" / "batch=b1").glob("bucket=*"))) > 20
    led.commit("b2", spark.createDataFrame([(7, "s", "en", "v", 1)], UP))
    assert len(list((tmp_path / "l" / "entries" / "batch=b2").glob("bucket=*"))) == 1
    assert totals(led) == [("s", "en", "v", 51, 100_000 + sum(range(50)) - 6)]
