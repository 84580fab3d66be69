"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A ledger folder has two tables, each with a folder per batch: ``entries`` (signed rows per document: +1 and its tokens, or their
reversal) and ``rollup`` (the batch's sums, the deltas). The totals are the sum of the committed rollups. Entries lie in ``BUCKETS``
folders by a hash of the document's id, and a commit reads those of the batch's ids only: a small batch reads a small share of the entries, a batch of
a large part of the corpus reads them all. A batch is committed once its rollup is complete (Spark's _SUCCESS mark). Committing the same
batch again changes nothing; a commit that broke off is written anew over its remains. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches, cut_lineage

ENTRY = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
DIMS = ("source", "lang", "tokenizer")
BUCKETS = 256


def _bucket() -> Column:
    """The entries folder of a document; those without an id lie in one that is never read."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"), F.lit(-1))


def bpe_counter(path: str | None = None) -> Callable[[str], int]:
    """Byte-level BPE tokens of a text; built where it is used."""
    import public_tokenizers

    from strataweave.llm import bpe

    path = path or bpe.vocabulary_path()

    def count(text: str) -> int:
        return len(bpe._encoder(path, public_tokenizers.PATTERN).encode_ordinary(text))

    return count


def count_tokens(docs: DataFrame, counters: dict[str, Callable[[str], int]], text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): a row per document and tokenizer version; null texts count as empty."""

    def run(batches):
        for b in batches:
            texts = ["" if t is None else t for t in b.column(3).to_pylist()]
            for name, f in counters.items():
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(texts)), pa.array([f(t) for t in texts], pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/{table}/batch={batch}"

    def committed(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.getName()[6:] for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [self._at(table, b) for b in self.committed()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch; False if it was committed before.

        ``upserts`` (doc_id, source, lang, tokenizer, n_tokens) insert documents or revise what is known of them for that tokenizer version: count,
        source and language alike. ``deletes`` (doc_id) remove a document from all versions; an id in both is revised. Of several rows for
        one id and version the largest (n_tokens, source, lang) stands. Rows with a null id are added as they are and can't be revised;
        deleting what isn't there does nothing.
        """
        if batch in self.committed():
            return False
        empty = self.spark.createDataFrame([], "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")
        new = (upserts if upserts is not None else empty).select(F.col("doc_id").cast("bigint"), "source", "lang", "tokenizer", F.col("n_tokens").cast("bigint"))
        # counting tokens may be dear, and what follows reads the rows several times
        new = cut_lineage(new)
        nameless = new.where("doc_id is null").select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "n_tokens")
        best = new.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("n_tokens", "source", "lang")).alias("b"))
        best = best.select("doc_id", "b.source", "b.lang", "tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "b.n_tokens")
        named = best.select("doc_id")
        if deletes is not None:
            named = named.union(deletes.select(F.col("doc_id").cast("bigint")).where("doc_id is not null"))
        buckets = [r[0] for r in named.select(_bucket()).distinct().collect()]
        known = self._read("entries", ENTRY + ", bucket int").where(F.col("bucket").isin(buckets)).select(*best.columns)
        touched = known.join(best.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct()
            others = known.join(gone, "doc_id", "left_semi").join(best.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_anti")
            touched = touched.unionByName(others)
        live = touched.groupBy("doc_id", *DIMS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        back = live.where("n_docs != 0 or n_tokens != 0").select("doc_id", *DIMS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        # rows of one folder meet in a few tasks, so a batch writes few files
        entries = best.unionByName(back).unionByName(nameless).withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(4)))
        entries.write.mode("overwrite").partitionBy("bucket").parquet(self._at("entries", batch))
        own = self.spark.read.schema(ENTRY).parquet(self._at("entries", batch))
        sums = own.groupBy(*DIMS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs != 0 or n_tokens != 0").write.mode("overwrite").parquet(self._at("rollup", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens), groups without documents left out."""
        sums = self._read("rollup", DELTA).groupBy(*DIMS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")
