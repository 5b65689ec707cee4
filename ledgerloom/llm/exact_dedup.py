"""Exact duplicates by a stateful stream over digests.

Arrivals (digest, doc_id, locator) stream into keyed state that lies on disk (RocksDB, below the shared folder) and
never expires: for each digest the smallest doc_id, where its content lies, and how many rows had it. Rows of one batch
are summed up before they reach the state, so a digest that owns a third of the rows is a few rows there. What the
state reports as a hit is then checked on full texts: the texts of groups are laid beside the text that stays (the one
with the state's doc_id and locator), by an equi-join whose large partitions adaptive execution splits. Arrivals come in
batches of `BATCH_BYTES`, so later ones meet the state that earlier ones have left. Should texts of one digest differ, that digest's rows are
grouped anew by digest and text.

Texts are equal when they are so after each run of blanks became one space; a null text counts as empty.

Defined cases: rows that repeat doc_id and text are counted one by one and all of them have `kept` of their doc_id in
the report, while `deduplicate` returns one of them; of equal texts the smallest doc_id stays, so there are no ties;
texts are compared whole, whatever their length; a row without doc_id stays only if no row of its group has one;
input columns that clash with working names are no matter; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import BLANKS, packed, unpack, whole_text
from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import materialise, new_table_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}

BATCH_BYTES = 256 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole_text(text), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """Per digest: keep_id, locator of its content, group_size. On a stream this is state without expiry."""
    at = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "locator")
    grouped = arrivals.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select("digest", F.col("first.doc_id").alias("keep_id"), "first.locator", "group_size")


def run_state(
    spark: SparkSession, arrivals_path: str, checkpoint: str, target: str, max_bytes_per_batch: int | None = None
) -> None:
    """Feed all arrivals that the checkpoint hasn't seen to the state; changed groups go to `target`, by batch.

    A later call with the same checkpoint goes on where this one ended. A batch that is run again after a failure
    replaces its own folder, so nothing is counted twice.
    """
    reader = spark.readStream.schema(ARRIVAL)
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_batch))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with _settings(spark, STATE_CONF):
        query = (
            keyed_state(reader.parquet(arrivals_path))
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()


ARRIVAL = "doc_id bigint, digest string, locator string"
STATE = "digest string, keep_id bigint, locator string, group_size bigint"


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The last report of each digest."""
    batches = spark.read.schema(f"{STATE}, batch bigint").option("basePath", target).parquet(f"{target}/batch=*")
    last = F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("last")
    return batches.groupBy("digest").agg(last).select("digest", "last.*")


def groups(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_bytes_per_batch: int | None = BATCH_BYTES
) -> DataFrame:
    """doc_id, digest, keep_id, group_size for each row of documents; the groups are confirmed on full texts."""
    spark = docs.sparkSession
    base = packed(docs).select(
        F.col("doc_id").cast("long"), normalised(F.col("text")).alias("content"), F.input_file_name().alias("locator")
    )
    base = base.withColumn("digest", digest(F.col("content")))
    arrivals_path, state_path = new_table_path(spark, "arrivals"), new_table_path(spark, "dedup-state")
    base.select("doc_id", "digest", "locator").write.parquet(arrivals_path)
    run_state(spark, arrivals_path, f"{state_path}/checkpoint", f"{state_path}/groups", max_bytes_per_batch)
    arrivals = spark.read.schema(ARRIVAL).parquet(arrivals_path)
    found = materialise(latest_state(spark, f"{state_path}/groups"), "groups")
    state = found.select("digest", "keep_id", "group_size")

    hits = found.filter("group_size > 1").select("digest", "keep_id", F.col("locator").alias("first_locator"), "group_size")
    members = materialise(base.join(hits, "digest"), "members")
    stays = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("first_locator")))
    first = stays.groupBy("digest").agg(F.min("content").alias("first_content"))
    beside = lookup_join(members.select("digest", "content"), first, ["digest"], "inner")
    differing = materialise(beside.filter("content != first_content").select("digest"), "differing")
    split = materialise(differing.distinct(), "split-digests")

    same = arrivals.select("doc_id", "digest").join(state, "digest").join(split, "digest", "left_anti")
    apart = members.select("doc_id", "digest", "content").join(split, "digest", "left_semi")
    anew = apart.groupBy("digest", "content").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    regrouped = lookup_join(apart, anew, ["digest", "content"], "inner").select("doc_id", "digest", "keep_id", "group_size")
    return same.select("doc_id", "digest", "keep_id", "group_size").unionByName(regrouped)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    columns = docs.columns
    verdicts = materialise(groups(docs), "verdicts")
    stay = verdicts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stay.groupBy("digest", F.col("keep_id").alias("stay_id")).agg(F.count(F.lit(1)).alias("rows"))
    stay = materialise(stay, "stay")
    base = packed(docs).withColumn("digest", sha256(normalised(F.col("text"))))
    base = base.withColumn("doc_id", F.col("doc_id").cast("long"))

    def of(wanted: DataFrame) -> DataFrame:
        found = base.join(wanted, "digest")
        return found.filter(F.col("doc_id").eqNullSafe(F.col("stay_id"))).select("row", "digest", "stay_id")

    once = of(stay.filter("rows = 1").drop("rows")).select("row")
    repeated = of(stay.filter("rows > 1").drop("rows")).groupBy("digest", "stay_id").agg(F.first("row").alias("row")).select("row")
    return unpack(once.unionByName(repeated), columns)
