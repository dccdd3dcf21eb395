"""A text index on disk: postings by term bucket, document lengths, removals.

Built once for a generation; a batch of queries reads only the buckets of its terms (partition
pruning at run time). A bucket's files are made by parts of the documents, so a term that a third of all
documents share is spread over files, and no posting is exchanged. New documents come as segments of rising number. A removal
names the documents and the first segment it does not touch, so a document that is removed and added
again (an update) is found with its new text only. Null and empty texts count as documents without terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.config import Recall
from engramlake.operators.retrieval import bm25_of, bm25_top, counted, query_terms

BUCKETS = 8
SIZES = -1  # the bucket of rows without a term


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", segment: int = 0, buckets: int = BUCKETS) -> None:
    """Writes one segment; in a file a term's postings lie together, sorted by document. Texts are tokenised once."""
    p = counted(docs, key, text).withColumn("bucket", F.when(F.col("term").isNull(), F.lit(SIZES)).otherwise(_bucket(buckets)))
    p.sortWithinPartitions("bucket", "term", "doc_id").select("term", "doc_id", "dl", "tf", F.lit(segment).alias("segment"), "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    size = docs.sparkSession.read.parquet(f"{path}/postings").where((F.col("bucket") == SIZES) & (F.col("segment") == segment))
    size.select("doc_id", "dl", "segment", F.explode(F.array_repeat(F.lit(1), F.col("tf").cast("int")))).drop("col").write.mode("append").parquet(f"{path}/docs")


def next_segment(spark: SparkSession, path: str) -> int:
    return (spark.read.parquet(f"{path}/docs").agg(F.max("segment")).first()[0] or 0) + 1


def remove(ids: DataFrame, path: str) -> None:
    """Removes documents (``doc_id``) of all segments written so far."""
    n = next_segment(ids.sparkSession, path)
    ids.select("doc_id", F.lit(n).alias("before")).distinct().write.mode("append").parquet(f"{path}/removed")


def update(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """Replaces documents by a new segment."""
    n = next_segment(docs.sparkSession, path)
    remove(docs.select(F.col(key).alias("doc_id")), path)
    build(docs, path, key, text, n, buckets)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/removed")
    if gone.getFileSystem(spark._jsc.hadoopConfiguration()).exists(gone):
        last = spark.read.parquet(f"{path}/removed").groupBy("doc_id").agg(F.max("before").alias("before"))
        df = df.join(last, "doc_id", "left").where("before is null or segment >= before").drop("before")
    return df


def search(queries: DataFrame, path: str, buckets: int = BUCKETS, cfg: Recall = Recall(), most: Column | None = None) -> DataFrame:
    """``query_id, doc_id, score`` like ``retrieval.bm25``, from the index; with ``most`` (a column of ``queries``) only the best of each query."""
    spark = queries.sparkSession
    q = query_terms(queries)
    want = q.select(_bucket(buckets).alias("bucket")).distinct()
    p = _read(spark, path, "postings").join(F.broadcast(want), "bucket", "left_semi")  # at most ``buckets`` rows
    n = _read(spark, path, "docs").agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    p = p.select("term", "doc_id", "dl", "tf")
    return bm25_of(q, p, n, cfg) if most is None else bm25_top(queries, p, n, most, cfg)
