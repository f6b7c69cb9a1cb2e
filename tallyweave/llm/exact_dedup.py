"""Exact duplicates by a stateful stream of digests.

The stream's state is keyed by SHA-256 digest, lives in RocksDB on the executors' disks with its log in the shared
folder, and never expires. For each digest it retains the least document id, that document's content locator (file and
id) and how often the digest was seen. Where a digest was seen twice, the full bytes decide: all texts under it are
compared, and texts that differ there (a collision) are grouped by their bytes instead.

Defined results: a null id or text is never a duplicate; empty texts are copies of each other; of equal texts the
least id is kept, and a repeated row of that very id is reported as a duplicate of itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.llm.common import id_text, place, positional, table
from tallyweave.operators.materialize import broadcast_if_small, session_conf, shared_path, written

Digest = Callable[[Column], Column]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW_BYTES = 96


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed(docs: DataFrame, digest: Digest = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, locator) of a batch or streaming frame; the text goes no further than its digest."""
    return id_text(docs, id_col, text_col).select("doc_id", digest(F.col("text")).alias("digest"), F.concat_ws("#", F.input_file_name(), F.col("doc_id").cast("string")).alias("locator"))


def run_stream(feed: DataFrame, state_dir: str, log_dir: str) -> None:
    """Take what is available of the streaming ``feed`` into the state under ``state_dir``.

    Each micro-batch appends to ``log_dir`` the digests it touched that have now been seen at least twice, with the
    retained first document. A later call with the same folders goes on where this one ended. A batch that is retried
    overwrites its own part of the log.
    """
    state = feed.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count("*").alias("seen"))

    def log(batch: DataFrame, epoch: int) -> None:
        batch.filter("seen > 1").write.mode("overwrite").parquet(f"{log_dir}/epoch={epoch}")

    conf = {"spark__sql__streaming__stateStore__providerClass": ROCKSDB, "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true", "spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    with session_conf(feed.sparkSession, **conf):
        query = state.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()


def seen_twice(spark: SparkSession, log_dir: str) -> DataFrame:
    """(digest, first_id, locator): the last word of the log on each digest."""
    log = spark.read.schema("digest binary, first struct<doc_id: bigint, locator: string>, seen bigint, epoch int").parquet(log_dir)
    last = log.groupBy("digest").agg(F.max_by("first", "epoch").alias("first"))
    return last.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.locator").alias("locator"))


def hits(docs: DataFrame, twice: DataFrame, digest: Digest = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of, digest) of the copies among ``docs``, by full bytes.

    Texts under one digest agree just when their least equals their greatest, so a partial aggregate compares them all
    and no text travels more than once from each task.
    """
    texts = id_text(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    known = written(twice.select("digest", "first_id"), "twice")
    members = texts.join(broadcast_if_small(known, known.count(), ROW_BYTES), "digest")
    compared = members.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    verdict = written(compared, "compared")
    clashing = verdict.filter(~F.col("same")).select("digest")
    n_clashing = clashing.count()
    rows = members.select("digest", "first_id", "doc_id")
    if n_clashing:
        clash = F.broadcast(clashing) if n_clashing * ROW_BYTES < (1 << 20) else clashing
        by_bytes = members.join(clash, "digest").withColumn("first_id", F.min("doc_id").over(Window.partitionBy("digest", "text")))
        rows = rows.join(clash, "digest", "left_anti").unionByName(by_bytes.select("digest", "first_id", "doc_id"))
    counted = rows.groupBy("digest", "first_id", "doc_id").agg(F.count("*").alias("n"))
    return counted.filter("doc_id <> first_id or n > 1").select("doc_id", F.col("first_id").alias("duplicate_of"), F.lower(F.hex("digest")).alias("digest"))


def exact_duplicates(docs: DataFrame, digest: Digest = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stream run over a frame: its digests are written as the feed, then streamed."""
    spark = docs.sparkSession
    feed = shared_path(spark, "digests")
    frame = keyed(docs, digest, id_col, text_col)
    frame.write.parquet(feed)
    log = shared_path(spark, "seen")
    run_stream(spark.readStream.schema(frame.schema).parquet(feed), shared_path(spark, "state"), log)
    return hits(docs, _log_or_none(spark, log), digest, id_col, text_col)


def streamed_duplicates(spark: SparkSession, path: str, schema: StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stream run straight over the Parquet files at ``path``, one file or a folder of them."""
    log = shared_path(spark, "seen")
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is also a source
    run_stream(keyed(spark.readStream.schema(schema).parquet(glob), sha256, id_col, text_col), shared_path(spark, "state"), log)
    return hits(spark.read.schema(schema).parquet(path), _log_or_none(spark, log), sha256, id_col, text_col)


def _log_or_none(spark: SparkSession, log: str) -> DataFrame:
    """The log; of an empty stream, which has run no batch, an empty frame."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return seen_twice(spark, log)
    return spark.createDataFrame([], "digest binary, first_id long, locator string")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without later copies. Id and digest name a row, so a reused id costs no other text."""
    found = written(exact_duplicates(docs, sha256, id_col, text_col), "exact")
    key = found.select(F.col("doc_id").alias("_tw_id"), F.unhex("digest").alias("_tw_digest"), (F.col("doc_id") == F.col("duplicate_of")).alias("_tw_self"))
    n, repeated = found.agg(F.count("*"), F.count_if(F.col("doc_id") == F.col("duplicate_of"))).first()

    rows = positional(docs)
    id_, text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"

    def on(part: DataFrame, how: str) -> DataFrame:
        return rows.join(broadcast_if_small(part, n, ROW_BYTES), (rows[id_].cast("long") == part["_tw_id"]) & (sha256(rows[text].cast("string")) == part["_tw_digest"]), how)

    kept = on(key.select("_tw_id", "_tw_digest"), "left_anti")
    if repeated:
        again = on(key.filter("_tw_self").select("_tw_id", "_tw_digest"), "left_semi").dropDuplicates([id_, text])
        kept = kept.unionByName(again)
    return kept.toDF(*docs.columns)


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_duplicates(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents").schema)


OP4_SQL = """
WITH g AS (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text),
     r AS (SELECT d.doc_id, g.first_id AS duplicate_of, sha256(d.text) AS digest, count(*) AS n
           FROM documents d JOIN g ON d.text = g.text GROUP BY ALL)
SELECT doc_id, duplicate_of, digest FROM r WHERE doc_id <> duplicate_of OR n > 1
"""
