"""The driver's relational tables seen as queues, messages, a log and requests.

Nations are queues, orders of a nation's customers are its messages, events are a change log and keyed requests,
conversations are lineages.  Values are functions of the keys, so every engine derives the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as queues: half LIFO, half with priorities."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("queue"),
        F.when(key % 2 == 0, "fifo").otherwise("lifo").alias("ordering"),
        (key % 4 >= 2).alias("priority_enabled"),
        F.lit(5).cast("bigint").alias("max_deliveries"),
        (key % 3 * 1_000_000).cast("bigint").alias("default_delay_us"),
        F.lit(30_000_000).cast("bigint").alias("default_visibility_us"),
        F.lit("1992-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def messages(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Orders as messages, those whose stored state had been reached at as_of."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    key, days = F.col("o_orderkey"), lambda n: F.make_dt_interval(n.cast("int"))
    dead = (F.col("o_orderstatus") == "F") & (key % 10 == 0)
    state = F.when(F.col("o_orderstatus") == "P", "leased").when(F.col("o_orderstatus") == "O", "ready").when(key % 10 == 0, "dead").otherwise("acked")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("k"),
            (key + 1).alias("sequence"),
            F.col("n_name").alias("queue"),
            F.when(F.col("n_nationkey") % 4 >= 2, 3 - F.substring("o_orderpriority", 1, 1).cast("int")).otherwise(0).alias("priority"),
            F.col("o_orderdate").alias("enqueued_at"),
            (F.col("o_orderdate") + days(key % 30)).alias("available_at"),
            state.alias("state"),
            F.when(dead, F.lit(5)).when(F.col("o_orderstatus") == "O", key % 5).otherwise(1 + key % 5).cast("int").alias("delivery_count"),
        )
    )
    at = F.col("available_at")
    rows = base.where(F.when(F.col("state") == "ready", F.col("enqueued_at")).otherwise(at) <= F.lit(as_of).cast("timestamp_ntz"))
    only = lambda state, value: F.when(F.col("state") == state, value)
    return rows.select(
        F.md5(F.col("sequence").cast("string").cast("binary")).alias("message_id"),
        "queue",
        F.concat(F.lit('{"order":'), F.col("k").cast("string"), F.lit("}")).alias("payload"),
        "priority",
        "sequence",
        "enqueued_at",
        "available_at",
        "state",
        F.col("delivery_count").cast("bigint").alias("delivery_count"),
        F.col("delivery_count").cast("bigint").alias("lease_epoch"),
        only("leased", at).alias("leased_at"),
        only("leased", at + days(1 + F.col("k") % 90)).alias("lease_until"),
        only("acked", at).alias("acked_at"),
        only("dead", at).alias("dead_at"),
        F.lit(None).cast("string").alias("last_failure_reason"),
        F.lit(None).cast("string").alias("replay_of"),
        (F.col("sequence") * 2 + F.col("delivery_count")).cast("bigint").alias("last_lsn"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of every lease: id, epoch and a digest."""
    held = messages(spark, sf_dir).where("state = 'leased'")
    digest = F.md5(F.concat_ws(".", "message_id", F.col("lease_epoch").cast("string")).cast("binary"))
    return held.select("queue", "message_id", F.concat_ws(".", "message_id", F.col("lease_epoch").cast("string"), digest).alias("receipt"))


def ack_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tombstone of every acknowledged message: its last receipt, kept for a day."""
    done = messages(spark, sf_dir).where("state = 'acked'")
    digest = F.md5(F.concat_ws(".", "message_id", F.col("lease_epoch").cast("string")).cast("binary"))
    return done.select("queue", F.concat_ws(".", "message_id", F.col("lease_epoch").cast("string"), digest).alias("receipt"), "message_id", (F.col("acked_at") + F.make_dt_interval(F.lit(1))).alias("expires_at"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of the entity user_id: an error event deletes it."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("lsn"),
        F.col("user_id").alias("entity"),
        (F.col("event_type") == "error").alias("deleted"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as keyed requests: the day in the key keeps a key within its retention."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_seq"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("ts").cast("date").cast("string")).alias("key"),
        F.sha2(F.col("props").cast("binary"), 256).alias("fingerprint"),
        F.col("ts").alias("ts"),
    )


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation: each replays the one before."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("node"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"),
    )
