"""Invariants of a persisted state as counts of violations: a sound state has none.

Row rules are conditional counts in one pass over a table; rules between tables are joins on the message key; unique
values are pre-aggregated counts.  Every rule gives a row (rule, violations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasewell.functions.validation import queue_name_valid, receipt_valid, result_shape_valid
from leasewell.limits import DEFAULT, Limits


def _counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows of (rule, violations) from conditional counts; a null condition is no violation."""
    one = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "violations"))


def queue_rules() -> dict[str, Column]:
    """Rules of the queues table."""
    return {
        "queue_name": ~queue_name_valid("queue"),
        "queue_ordering": ~F.coalesce(F.col("ordering").isin("fifo", "lifo"), F.lit(False)),
        "queue_settings": ~F.coalesce((F.col("max_deliveries") > 0) & (F.col("default_delay_us") >= 0) & (F.col("default_visibility_us") > 0) & F.col("created_at").isNotNull(), F.lit(False)),
    }


def message_rules(next_sequence: Column, through_lsn: Column) -> dict[str, Column]:
    """Rules of messages joined with their queue's settings and receipt."""
    state, count, most = F.col("state"), F.col("delivery_count"), F.col("max_deliveries")
    leased, waiting = state == "leased", state.isin("ready", "delayed")
    epoch = ~F.col("lease_epoch").eqNullSafe(count)
    no_lease = F.col("leased_at").isNull() & F.col("lease_until").isNull() & F.col("receipt").isNull()
    return {
        "known_queue": most.isNull(),
        "message_state": ~F.coalesce(state.isin("delayed", "ready", "leased", "acked", "dead"), F.lit(False)),
        "message_identity": F.col("message_id").isNull() | (F.col("message_id") == ""),
        "message_times": F.col("enqueued_at").isNull() | F.col("available_at").isNull(),
        "message_payload": F.try_parse_json("payload").isNull(),
        "message_sequence": F.col("sequence").isNull() | (F.col("sequence") < 1) | (F.col("sequence") >= next_sequence),
        "message_lsn": F.col("last_lsn").isNull() | (F.col("last_lsn") < 1) | (F.col("last_lsn") > through_lsn),
        "epoch_is_count": epoch,
        "waiting_has_deliveries_left": waiting & (count >= most),
        "waiting_is_not_dead": waiting & F.col("dead_at").isNotNull(),
        "lease_complete": leased & (F.col("receipt").isNull() | F.col("leased_at").isNull() | F.col("lease_until").isNull()),
        "lease_count": leased & ((count < 1) | (count > most)),
        "lease_times": leased & ((F.col("leased_at") < F.col("enqueued_at")) | (F.col("leased_at") >= F.col("lease_until"))),
        "lease_receipt": leased & ~receipt_valid("receipt", "message_id", "lease_epoch"),
        "lease_is_not_dead": leased & F.col("dead_at").isNotNull(),
        "acked_time": (state == "acked") & (F.col("acked_at").isNull() | (F.col("acked_at") < F.col("enqueued_at"))),
        "acked_count": (state == "acked") & ((count < 1) | (count > most)),
        "dead_count": (state == "dead") & (count != most),
        "dead_time": (state == "dead") & (F.col("dead_at").isNull() | (F.col("dead_at") < F.col("enqueued_at"))),
        "lease_data_without_lease": ~leased & ~no_lease,
        "acked_time_without_ack": (state != "acked") & F.col("acked_at").isNotNull(),
    }


def _shared(rows: DataFrame, column: str, rule: str) -> DataFrame:
    found = rows.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return found.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def audit(messages: DataFrame, queues: DataFrame, receipts: DataFrame, next_sequence: Column, through_lsn: Column) -> DataFrame:
    """(rule, violations) of a state."""
    config = queues.select("queue", "max_deliveries")
    held = receipts.select("queue", "message_id", "receipt")
    rows = messages.join(config, "queue", "left").join(held, ["queue", "message_id"], "left")
    orphan = receipts.join(messages.where("state = 'leased'").select("queue", "message_id"), ["queue", "message_id"], "left_anti")
    out = _counted(rows, message_rules(next_sequence, through_lsn)).unionByName(_counted(queues, queue_rules()))
    out = out.unionByName(_shared(messages, "sequence", "sequence_unique")).unionByName(_shared(receipts, "receipt", "receipt_unique"))
    return out.unionByName(orphan.agg(F.count("*").alias("violations")).select(F.lit("receipt_of_lease").alias("rule"), "violations"))


def audit_queues(queues: DataFrame) -> DataFrame:
    """(rule, violations) of the settings of queues."""
    return _counted(queues, queue_rules())


def audit_acknowledged(messages: DataFrame, receipts: DataFrame, ack_receipts: DataFrame) -> DataFrame:
    """(rule, violations) of acknowledgement tombstones (queue, receipt, message_id, expires_at).

    A tombstone belongs to an acknowledged message, has the receipt of its last lease and ends after it was
    acknowledged; every acknowledged message has exactly one; no receipt is shared, also not with a lease.
    """
    acked = messages.where("state = 'acked'").select("queue", "message_id", "lease_epoch", "acked_at")
    rows = ack_receipts.join(acked, ["queue", "message_id"], "left")
    known, some = F.col("lease_epoch").isNotNull(), F.coalesce(F.length("receipt"), F.lit(0)) > 0
    rules = {
        "acked_receipt_identity": ~known | ~some,
        "acked_receipt_lease": known & ~F.coalesce(receipt_valid("receipt", "message_id", "lease_epoch"), F.lit(False)),
        "acked_receipt_expiry": known & ~F.coalesce(F.col("expires_at") > F.col("acked_at"), F.lit(False)),
    }
    held = ack_receipts.groupBy("queue", "message_id").agg(F.count("*").alias("n"))
    counted = acked.join(held, ["queue", "message_id"], "left").agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("violations"))
    every = receipts.select("receipt").unionByName(ack_receipts.select("receipt"))
    return _counted(rows, rules).unionByName(counted.select(F.lit("acked_receipt_count").alias("rule"), "violations")).unionByName(_shared(every, "receipt", "receipt_unique_with_tombstones"))


def audit_times(messages: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """(rule, violations) of stored states against an instant, and of counts by queue that do not add up."""
    rules = {
        "delayed_is_available": (F.col("state") == "delayed") & (F.col("available_at") <= now),
        "ready_is_not_available": (F.col("state") == "ready") & (F.col("available_at") > now),
    }
    off = counts.agg(F.count_if(F.col("total") != sum((F.col(c) for c in ("ready", "delayed", "in_flight", "dead")), F.col("acked"))).alias("violations"))
    return _counted(messages, rules).unionByName(off.select(F.lit("count_conservation").alias("rule"), "violations"))


def idempotency_rules(through_lsn: Column) -> dict[str, Column]:
    """Rules of idempotency records."""
    operations = ("create_queue", "enqueue", "receive", "ack", "nack", "extend", "redrive")
    return {
        "record_operation": ~F.coalesce(F.col("operation").isin(*operations), F.lit(False)),
        "record_key": F.coalesce(F.length("queue"), F.lit(0)) * F.coalesce(F.length("key"), F.lit(0)) == 0,
        "record_fingerprint": ~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "record_times": ~F.coalesce(F.col("expires_at") > F.col("created_at"), F.lit(False)),
        "record_lsn": ~F.coalesce((F.col("last_lsn") >= 1) & (F.col("last_lsn") <= through_lsn), F.lit(False)),
        "record_result": F.try_parse_json("result").isNull(),
        "record_result_shape": ~result_shape_valid("operation", "result"),
    }


def audit_idempotency(records: DataFrame, queues: DataFrame, through_lsn: Column) -> DataFrame:
    """(rule, violations) of idempotency records."""
    unknown = records.join(queues.select("queue"), "queue", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("record_queue").alias("rule"), "violations")
    return _counted(records, idempotency_rules(through_lsn)).unionByName(unknown)


def over_capacity(messages: DataFrame, queues: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """(rule, violations) of the limits: queues, messages, messages of a queue, leases."""
    per_queue = messages.groupBy("queue").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "leased").alias("leased"))
    both = per_queue.select("n", "leased", F.lit(0).alias("is_queue")).unionByName(queues.select(F.lit(1).alias("is_queue")), allowMissingColumns=True)
    rows = both.agg(F.sum("n").alias("n"), F.sum("leased").alias("leased"), F.count_if(F.col("n") > limits.messages_per_queue).alias("full"), F.count_if(F.col("leased") > limits.in_flight_per_queue).alias("busy"), F.sum("is_queue").alias("queues"))
    rules = {"limit_queues": F.col("queues") > limits.queues, "limit_messages": F.col("n") > limits.messages, "limit_in_flight": F.col("leased") > limits.in_flight}
    direct = {"limit_messages_per_queue": F.col("full"), "limit_in_flight_per_queue": F.col("busy")}
    named = [F.struct(F.lit(k).alias("rule"), F.coalesce(v.cast("int"), F.lit(0)).cast("bigint").alias("violations")) for k, v in (rules | direct).items()]
    return rows.select(F.explode(F.array(*named)).alias("r")).select("r.rule", "r.violations")
