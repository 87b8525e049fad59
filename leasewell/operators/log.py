"""Queries over the ordered change log: replay, difference, continuity, idempotency and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasewell.sources.shared import kept

#: Log positions in a chunk: the most rows a task sorts together.
LOG_CHUNK = 65_536


def latest(log: DataFrame, key: str = "entity", order: str = "lsn") -> DataFrame:
    """The last change of every entity, tombstones included, by pre-aggregated maxima (without a sort where the
    columns are numbers)."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in rest))


def fold(log: DataFrame, key: str = "entity", order: str = "lsn", deleted: str = "deleted") -> DataFrame:
    """The state that the log leaves: the last change of each entity that is not a deletion."""
    return latest(log, key, order).where(~F.col(deleted)).drop(deleted)


def snapshot_plus_tail(snapshot: DataFrame, log: DataFrame, through: int, key: str = "entity", order: str = "lsn", deleted: str = "deleted") -> DataFrame:
    """The state of a snapshot with the changes after it: the same as the fold of the whole log.

    The filter on the log position reaches the scan, so only the tail is read.
    """
    tail = log.where(F.col(order) > through)
    return fold(snapshot.withColumn(deleted, F.lit(False)).unionByName(tail.select(*snapshot.columns, deleted)), key, order, deleted)


def state_diff(before: DataFrame, after: DataFrame, key: str = "entity", value: str = "value") -> DataFrame:
    """Upserts and deletions that turn one state into the other."""
    a = before.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("was"))
    b = after.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change", "old", "new")


def gaps(log: DataFrame, order: str = "lsn", chunk: int = LOG_CHUNK) -> DataFrame:
    """Missing positions of a log: (after_lsn, next_lsn, missing).

    Neighbours are found within chunks of the position; the ends of the chunks, one row each, are compared apart, so
    the whole log is never sorted in one task.
    """
    rows = log.select(F.col(order).alias("lsn")).withColumn("chunk", F.floor(F.col("lsn") / chunk))
    inner = rows.withColumn("next", F.lead("lsn").over(Window.partitionBy("chunk").orderBy("lsn")))
    ends = rows.groupBy("chunk").agg(F.min("lsn").alias("first"), F.max("lsn").alias("lsn")).withColumn("next", F.lead("first").over(Window.orderBy("chunk")))
    both = inner.select("lsn", "next").unionByName(ends.select("lsn", "next"))
    return both.where("next - lsn > 1").select(F.col("lsn").alias("after_lsn"), F.col("next").alias("next_lsn"), (F.col("next") - F.col("lsn") - 1).alias("missing"))


def positions(rows: DataFrame, order: str, out: str, chunk: int = LOG_CHUNK) -> DataFrame:
    """Rows with their dense rank number by a unique, dense-ish integer order, in chunks.

    The chunks themselves, one row for each ``chunk`` positions, are ranked in one task: up to some 10**11 positions.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy("_chunk").count().select("_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_chunk").orderBy(order))
    return chunked.withColumn("_within", within).join(offsets, "_chunk").withColumn(out, F.col("_within") + F.col("_offset")).drop("_chunk", "_within", "_offset")


def idempotency_outcomes(requests: DataFrame, key: str = "key", order: str = "op_seq") -> DataFrame:
    """new, replayed or conflict for each keyed request, where no key outlives its retention.

    The first use of a key is a pre-aggregated minimum that is joined back; the join can be split where a key is hot.
    """
    first = requests.groupBy(key).agg(F.min(F.struct(order, "fingerprint")).alias("first"))
    outcome = F.when(F.col(order) == F.col(f"first.{order}"), "new").when(F.col("fingerprint") == F.col("first.fingerprint"), "replayed").otherwise("conflict")
    return requests.join(first, key).select(order, key, outcome.alias("outcome"))


def roots(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root, depth) of a forest of (node, parent) edges by pointer jumping: a depth of n takes log2(n) joins,
    each written to the shared folder.

    A parent without a row is taken as a root of its own.
    """
    state = kept(edges.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "lineage")
    total = state.agg(F.sum("depth")).first()[0]
    for _ in range(most_rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        state = kept(state.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "lineage")
        moved = state.agg(F.sum("depth")).first()[0]
        if moved == total:
            break
        total = moved
    return state.select("node", F.col("up").alias("root"), "depth")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a request as canonical JSON of the named columns in this order (nulls left out)."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def receipt_outcomes(claims: DataFrame, messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """ok, stale_receipt or not_found for claims (claim_id, queue, message_id, receipt, at).

    A claim holds if its message is leased at the time (at least leased_at, before lease_until) under this receipt.
    """
    known = messages.select("queue", "message_id", "state", "leased_at", "lease_until")
    held = receipts.select("queue", "message_id", F.col("receipt").alias("held"))
    ok = (F.col("state") == "leased") & (F.col("at") >= F.col("leased_at")) & (F.col("at") < F.col("lease_until")) & (F.col("receipt") == F.col("held"))
    outcome = F.when(F.col("state").isNull(), "not_found").when(ok, "ok").otherwise("stale_receipt")
    return claims.join(known, ["queue", "message_id"], "left").join(held, ["queue", "message_id"], "left").select("claim_id", outcome.alias("outcome"))


def delta_violations(changes: DataFrame, queues: DataFrame, next_sequence: DataFrame) -> DataFrame:
    """(rule, n) of a change set: a key both deleted and written at one position, a change of an unknown queue, and a
    next sequence that goes back.

    next_sequence: (lsn, next_sequence); one row a position.
    """
    both = changes.groupBy("lsn", "entity", "key").agg(F.count_if("deleted").alias("d"), F.count_if(~F.col("deleted")).alias("u")).where("d > 0 and u > 0").agg(F.count("*").alias("n")).withColumn("rule", F.lit("deleted_and_written"))
    unknown = changes.join(queues.select("queue"), "queue", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("unknown_queue"))
    rows = next_sequence.withColumn("chunk", F.floor(F.col("lsn") / LOG_CHUNK))
    within = rows.withColumn("next", F.lead("next_sequence").over(Window.partitionBy("chunk").orderBy("lsn"))).where("next < next_sequence").select("lsn")
    ends = rows.groupBy("chunk").agg(F.min_by("next_sequence", "lsn").alias("first"), F.max_by("next_sequence", "lsn").alias("last")).withColumn("next", F.lead("first").over(Window.orderBy("chunk"))).where("next < last").select(F.col("chunk").alias("lsn"))
    back = within.unionByName(ends).agg(F.count("*").alias("n")).withColumn("rule", F.lit("sequence_went_back"))
    return both.unionByName(unknown).unionByName(back).select("rule", "n")
