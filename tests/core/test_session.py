from strataweave.core.session import bounded_batches, checkpoint_dir, cut_lineage

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batch_bound_keeps_a_smaller_one(spark):
    spark.conf.unset(KEY)
    bounded_batches(spark)
    assert int(spark.conf.get(KEY).rstrip("b")) == 4 << 20
    spark.conf.set(KEY, "1m")
    bounded_batches(spark)
    assert spark.conf.get(KEY) in ("1m", "1048576b", "1048576")
    spark.conf.set(KEY, "256m")
    bounded_batches(spark)
    assert int(spark.conf.get(KEY).rstrip("b")) == 4 << 20


def test_checkpoints_survive(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
