"""Queries over the fixture queues, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasewell.functions import validation as V
from leasewell.operators import audit, log, state
from leasewell.sources import fixtures as fx
from leasewell.sources.shared import scratch

PAGE = 50
TOP_K = 3
SNAPSHOT_LSN = 500


def _now():
    return state.instant(fx.AS_OF)


def logical_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.with_logical_state(fx.messages(spark, sf), fx.queues(spark, sf), _now()).select("queue", "sequence", "state", "logical_state")


def select_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return state.select_candidate(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def reservation_order(spark: SparkSession, sf: str) -> DataFrame:
    return state.reservation_order(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def topk_per_queue(spark: SparkSession, sf: str) -> DataFrame:
    return state.top_k(fx.messages(spark, sf), fx.queues(spark, sf), _now(), TOP_K)


def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.queue_counts(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def service_stats(spark: SparkSession, sf: str) -> DataFrame:
    return state.service_stats(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def list_queues(spark: SparkSession, sf: str) -> DataFrame:
    return state.list_queues(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def get_queue(spark: SparkSession, sf: str) -> DataFrame:
    return state.get_queue(fx.messages(spark, sf), fx.queues(spark, sf), _now(), "NATION_7")


def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    return state.in_flight(fx.messages(spark, sf), _now())


def next_event(spark: SparkSession, sf: str) -> DataFrame:
    return state.next_event(fx.messages(spark, sf), _now())


def list_messages_p1(spark: SparkSession, sf: str) -> DataFrame:
    return state.list_messages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), "NATION_7", limit=PAGE)


def list_messages_p2(spark: SparkSession, sf: str) -> DataFrame:
    """The page after sequence 1,000 of a snapshot taken at log position 20,000 with high-water mark 9,000."""
    return state.list_messages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), "NATION_7", after=1_000, high_water=9_000, snapshot_lsn=20_000, limit=PAGE)


def list_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return state.list_messages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), "NATION_7", state="dead", limit=PAGE)


def delayed_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return state.delayed_schedule(fx.messages(spark, sf), fx.queues(spark, sf), _now())


_MATERIAL = ["message_id", "queue", "sequence", "state", "available_at", "leased_at", "lease_until", "dead_at", "last_failure_reason"]


def materialize(spark: SparkSession, sf: str) -> DataFrame:
    return state.materialize(fx.messages(spark, sf), fx.queues(spark, sf), _now()).select(_MATERIAL)


def compact(spark: SparkSession, sf: str) -> DataFrame:
    return state.compact(fx.messages(spark, sf), fx.queues(spark, sf), _now()).groupBy("queue", "state").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"))


def prune_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of each queue when acknowledged messages are kept for a day."""
    return state.prune_acked(fx.messages(spark, sf), _now()).groupBy("queue").agg(F.count("*").alias("kept"), F.count_if(F.col("state") == "acked").alias("kept_acked"))


def prune_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgement tombstones that still hold when those of the last hundred days are looked at."""
    now = _now() - F.make_dt_interval(F.lit(100))
    return state.prune_expired(fx.ack_receipts(spark, sf), now).select("queue", "message_id", "receipt", "expires_at")


def prune_idempotency(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed requests whose record still holds a day before the last request."""
    rows = fx.requests(spark, sf)
    now = rows.agg(F.max("ts")).scalar() - F.make_dt_interval(F.lit(1))
    records = rows.select("op_seq", "key", (F.col("ts") + F.make_dt_interval(F.lit(1))).alias("expires_at"))
    return state.prune_expired(records, now)


def capacity_headroom(spark: SparkSession, sf: str) -> DataFrame:
    return state.capacity_headroom(fx.messages(spark, sf), fx.queues(spark, sf), _now())


def idempotency_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return log.idempotency_outcomes(fx.requests(spark, sf))


def log_fold(spark: SparkSession, sf: str) -> DataFrame:
    return log.fold(fx.change_log(spark, sf))


def snapshot_plus_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.change_log(spark, sf)
    return log.snapshot_plus_tail(log.fold(rows.where(F.col("lsn") <= SNAPSHOT_LSN)), rows, SNAPSHOT_LSN)


def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.change_log(spark, sf)
    return log.state_diff(log.fold(rows.where(F.col("lsn") <= SNAPSHOT_LSN)), log.fold(rows))


def lsn_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Positions that the log lacks once its tombstones are taken out."""
    return log.gaps(fx.change_log(spark, sf).where(~F.col("deleted")))


def log_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Dense positions of the changes that are no tombstones, as a single writer would number them."""
    return log.positions(fx.change_log(spark, sf).where(~F.col("deleted")).select("lsn", "entity"), "lsn", "position")


def redrive_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return log.roots(fx.lineage_edges(spark, sf))


def receipt_validity(spark: SparkSession, sf: str) -> DataFrame:
    """A claim for every message, some with a wrong receipt, a wrong message or at a late time."""
    rows, k = fx.messages(spark, sf), F.col("sequence")
    digest = F.md5(F.concat_ws(".", "message_id", F.col("lease_epoch").cast("string")).cast("binary"))
    claims = rows.select(
        k.alias("claim_id"),
        "queue",
        F.when(k % 11 == 0, F.lit("unknown")).otherwise(F.col("message_id")).alias("message_id"),
        F.concat_ws(".", "message_id", (F.col("lease_epoch") + F.when(k % 7 == 0, 1).otherwise(0)).cast("string"), digest).alias("receipt"),
        (F.col("available_at") + F.make_dt_interval((k % 60).cast("int"))).alias("at"),
    )
    return log.receipt_outcomes(claims, rows, fx.receipts(spark, sf))


def lease_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of those claims by kind."""
    return receipt_validity(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


def invariant_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.messages(spark, sf)
    return audit.audit(rows, fx.queues(spark, sf), fx.receipts(spark, sf), F.lit(10_000_000), F.lit(100_000_000))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("sequence")
    return fx.messages(spark, sf).withColumns(
        {
            "delivery_count": F.when(k % 13 == 0, F.col("delivery_count") + 1).otherwise(F.col("delivery_count")),
            "payload": F.when(k % 17 == 0, F.lit("{broken")).otherwise(F.col("payload")),
            "dead_at": F.when(k % 19 == 0, F.col("enqueued_at")).otherwise(F.col("dead_at")),
            "lease_until": F.when(k % 23 == 0, F.col("available_at")).otherwise(F.col("lease_until")),
            "last_lsn": F.when(k % 29 == 0, F.lit(0)).otherwise(F.col("last_lsn")),
            "queue": F.when(k % 31 == 0, F.lit("nowhere")).otherwise(F.col("queue")),
        }
    )


def invariant_audit_broken(spark: SparkSession, sf: str) -> DataFrame:
    """The same audit over a state that has been damaged in six ways."""
    return audit.audit(_broken(spark, sf), fx.queues(spark, sf), fx.receipts(spark, sf), F.lit(10_000_000), F.lit(100_000_000))


def recovered_state_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Limits of the state as materialized at recovery."""
    rows = state.materialize(fx.messages(spark, sf), fx.queues(spark, sf), _now())
    return audit.over_capacity(rows, fx.queues(spark, sf))


def delta_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a change set over queues, next sequence by event."""
    events = fx.table(spark, sf, "events")
    changes = events.select(F.floor(F.col("event_id") / 3).alias("lsn"), F.lit("message").alias("entity"), (F.col("user_id") % 5).cast("string").alias("key"), (F.col("event_type") == "error").alias("deleted"), F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("queue"))
    following = events.select(F.col("event_id").alias("lsn"), (F.col("event_id") - F.when(F.col("event_id") % 101 == 100, 2).otherwise(0)).alias("next_sequence"))
    return log.delta_violations(changes, fx.queues(spark, sf), following)


def idempotency_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Events as idempotency records, some of them damaged."""
    k = F.col("event_id")
    names = ["create_queue", "enqueue", "receive", "ack", "nack", "extend", "redrive", "compact"]
    records = fx.table(spark, sf, "events").select(
        F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")).alias("operation"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 26).cast("string")).alias("queue"),
        F.when(k % 37 == 0, "").otherwise(k.cast("string")).alias("key"),
        F.when(k % 41 == 0, "00ff").otherwise(F.sha2(F.col("props").cast("binary"), 256)).alias("fingerprint"),
        F.col("props").alias("result"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(F.when(k % 43 == 0, 0).otherwise(1))).alias("expires_at"),
        k.alias("last_lsn"),
    )
    return audit.audit_idempotency(records, fx.queues(spark, sf), F.lit(100_000_000))


def enqueue_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Availability of orders enqueued with a delay of some days and a requested time on every third."""
    k, now = F.col("o_orderkey"), F.col("o_orderdate")
    requested = F.when(k % 3 == 0, now + F.make_dt_interval((k % 45).cast("int")))
    at = V.available_at(now, (k % 33 - 1) * 86_400_000_000, requested)
    error = F.when(at.isNull(), "invalid_request")
    return fx.table(spark, sf, "orders").select(k.alias("message"), at.alias("available_at"), F.when(at.isNotNull(), F.when(at > now, "delayed").otherwise("ready")).alias("state"), error.alias("error"))


def _admission(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.when(k % 5 == 0, " bad").otherwise(""), F.lit("-"), (k % 40).cast("string"))
    return fx.table(spark, sf, "customer").select(k.alias("op_seq"), name.alias("queue"), F.when(k % 4 > 0, F.concat(F.lit("k"), (k % 3).cast("string"))).alias("key"), F.when(k % 7 == 0, "lifo").otherwise("fifo").alias("fingerprint")).withColumn("valid", V.queue_name_valid("queue"))


def queue_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Customers asking for queues by market segment, many with keys that others use too."""
    return state.admission(_admission(spark, sf))


def queue_admission_full(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests where there is room for 60 queues."""
    return state.admission(_admission(spark, sf), 60)


def message_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of every queue, with the cursor of the next."""
    return state.pages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), PAGE, 3)


def message_pages_next(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of every queue, from the cursors of the first."""
    cursors = message_pages(spark, sf).where("next_cursor is not null").groupBy("queue").agg(F.max("next_cursor").alias("cursor"))
    return state.pages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), PAGE, 3, cursors=cursors)


def dead_letter_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of the dead letters of every queue."""
    return state.pages(fx.messages(spark, sf), fx.queues(spark, sf), _now(), 5, 3, dead_only=True)


def list_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests for pages: sizes, state filters, unknown queues, and cursors of other lists or snapshots."""
    k = F.col("o_orderkey")
    named = fx.table(spark, sf, "orders").select(k.alias("request"), F.concat(F.lit("NATION_"), (k % 27).cast("string")).alias("queue"), F.element_at(F.array(*map(F.lit, ["", "ready", "dead", "waiting"])), (k % 4 + 1).cast("int")).alias("state"), (k % 5 == 0).alias("dead_only"), (k % 1_103 - 50).alias("page"))
    scope = V.cursor_scope("queue", F.when(F.col("request") % 10 == 0, "other").otherwise(F.col("state")), F.col("dead_only"))
    text = V.cursor_text(scope, F.col("request") % 900, F.lit(600), F.lit(7), F.when(F.col("request") % 13 == 0, 2).otherwise(3), F.lit(0).cast("bigint"), F.lit(0))
    cursor = F.when(F.col("request") % 3 == 0, F.lit(None).cast("string")).when(F.col("request") % 17 == 0, "v3.x").otherwise(text)
    return state.list_request_outcomes(named.withColumn("cursor", cursor), fx.queues(spark, sf), F.lit(800), F.lit(3))


def schedule_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests that may give a delay, a time, both or neither."""
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(k.alias("request"), F.when(k % 2 == 0, k % 700 - 9).alias("delay_ms"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("available_at"))
    delay = F.when(F.col("delay_ms").isNull(), F.lit(0)).otherwise(V.duration_us("delay_ms"))
    ok = V.schedule_exclusive("delay_ms", "available_at") & delay.isNotNull()
    return rows.select("request", F.when(ok, "ok").otherwise("invalid_request").alias("outcome"), F.when(ok, delay).cast("bigint").alias("delay_us"))


def queue_settings_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of queues, some of them damaged."""
    k = F.substring("queue", 8, 9).cast("int")
    damaged = {
        "queue": F.when(k % 11 == 0, F.concat("queue", F.lit("!"))).otherwise(F.col("queue")),
        "ordering": F.when(k % 7 == 0, "random").otherwise(F.col("ordering")),
        "default_delay_us": F.when(k % 5 == 0, -1).otherwise(F.col("default_delay_us")),
        "default_visibility_us": F.when(k % 4 == 0, 0).otherwise(F.col("default_visibility_us")),
        "created_at": F.when(k % 9 != 0, F.col("created_at")),
    }
    return audit.audit_queues(fx.queues(spark, sf).withColumns(damaged))


def acknowledged_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Tombstones of acknowledged messages: none is wrong."""
    return audit.audit_acknowledged(fx.messages(spark, sf), fx.receipts(spark, sf), fx.ack_receipts(spark, sf))


def acknowledged_audit_broken(spark: SparkSession, sf: str) -> DataFrame:
    """The same tombstones, damaged: lost, wrong, early, doubled and shared ones."""
    k = F.ascii(F.substring("message_id", 1, 1)) * 256 + F.ascii(F.substring("message_id", 2, 1))
    rows = fx.ack_receipts(spark, sf).withColumn("k", k).where("k % 13 <> 0")
    rows = rows.withColumns({"receipt": F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 7 == 0, "same").otherwise(F.col("receipt")), "expires_at": F.when(F.col("k") % 11 == 0, F.col("expires_at") - F.make_dt_interval(F.lit(2))).otherwise(F.col("expires_at")), "message_id": F.when(F.col("k") % 17 == 0, "none").otherwise(F.col("message_id"))})
    twice = rows.unionByName(rows.where("k % 19 = 0")).drop("k")
    return audit.audit_acknowledged(fx.messages(spark, sf), fx.receipts(spark, sf), twice)


def state_time_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stored states against the instant, before they are materialized: passed delays are still stored as ready."""
    rows = fx.messages(spark, sf)
    return audit.audit_times(rows, state.queue_counts(rows, fx.queues(spark, sf), _now()), _now())


def state_time_audit_materialized(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the materialized state: none is wrong."""
    rows = state.materialize(fx.messages(spark, sf), fx.queues(spark, sf), _now())
    return audit.audit_times(rows, state.queue_counts(rows, fx.queues(spark, sf), _now()), _now())


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical request digests of events."""
    return fx.table(spark, sf, "events").select("event_id", log.fingerprint("user_id", "event_type").alias("fingerprint"))


def name_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names, part names and receipts against the format rules."""
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("text"))
    return parts.select("k", V.queue_name_valid("text").alias("queue_name"), V.key_valid("text").alias("key"), V.fingerprint_valid("text").alias("fingerprint"))


def cursor_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors of every queue, list kind and state, and what they decode to."""
    states = F.explode(F.array(*map(F.lit, ["", "delayed", "ready", "leased", "acked", "dead"])))
    rows = fx.queues(spark, sf).select("queue", states.alias("state")).withColumn("dead_only", F.col("state") == "dead")
    scope = V.cursor_scope("queue", F.col("state"), F.col("dead_only"))
    seconds = F.length("queue").cast("bigint") - 9
    text = V.cursor_text(scope, F.lit(700), F.lit(600), F.length("state"), F.lit(3), seconds, F.lit(123_456_000))
    return rows.select("queue", "state", scope.alias("scope"), text.alias("cursor")).withColumn("f", V.cursor_fields("cursor")).select("queue", "state", "scope", "cursor", F.col("f.sequence").cast("bigint").alias("sequence"), F.col("f.second").alias("second"))


def reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of conversations as failure reasons, trimmed and cut to 512 bytes."""
    rows = fx.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", V.reason_trimmed("text").alias("reason"))


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as milliseconds around the largest duration."""
    k = F.col("o_orderkey")
    ms = F.when(k % 2 == 0, F.lit(9_223_372_036_800) + k).otherwise(k - 500)
    return fx.table(spark, sf, "orders").select(k.alias("k"), ms.alias("ms")).select("k", V.duration_us("ms").alias("us"))


def store_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """The change log written by ranges of positions, and its state from a snapshot of the first ranges and the rest."""
    path, rows = scratch(spark, "log"), fx.change_log(spark, sf)
    rows.withColumn("range", F.floor(F.col("lsn") / SNAPSHOT_LSN)).write.partitionBy("range").parquet(path)
    written = spark.read.parquet(path)
    held = log.fold(written.where("range = 0").drop("range"))
    return log.snapshot_plus_tail(held, written.where("range > 0").drop("range"), SNAPSHOT_LSN - 1).withColumnRenamed("entity", "key")


def strict_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events as request bodies, some of them damaged."""
    k = F.col("event_id")
    text = F.when(k % 5 == 1, F.concat("props", F.lit(" {}"))).when(k % 5 == 2, F.lit('{"k": 1, "k": 2}')).when(k % 5 == 3, F.lit("[1]")).when(k % 5 == 4, F.lit('{"other": 1}')).otherwise(F.col("props"))
    return fx.table(spark, sf, "events").select("event_id", text.alias("body")).select("event_id", V.strict_json("body", ("k",)).alias("accepted"), V.utf8_valid("body").alias("utf8"))


def receipt_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of messages against their id and epoch, and against the next epoch."""
    rows = fx.receipts(spark, sf).join(fx.messages(spark, sf).select("queue", "message_id", "sequence", "lease_epoch"), ["queue", "message_id"])
    return rows.withColumn("later", F.col("lease_epoch") + 1).select("sequence", V.receipt_valid("receipt", "message_id", "lease_epoch").alias("own"), V.receipt_valid("receipt", "message_id", "later").alias("next"))


def result_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results of events, by operation."""
    k = F.col("event_id")
    operation = F.element_at(F.array(*map(F.lit, ["enqueue", "ack", "receive", "nack"])), (k % 4 + 1).cast("int"))
    result = F.when(k % 3 == 0, F.concat(F.lit('{"message":{"id":"m'), k.cast("string"), F.lit('"}}'))).when(k % 3 == 1, F.lit('{"acked":true}')).otherwise(F.lit('{"message":{"id":""}}'))
    return fx.table(spark, sf, "events").select("event_id", operation.alias("operation"), result.alias("result")).select("event_id", V.result_shape_valid("operation", "result").alias("valid"))


def time_addition(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates plus days, some of them negative."""
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(k.alias("k"), V.added(F.col("o_orderdate"), (k % 50 - 5) * 86_400_000_000).alias("at"))


_QUERIES = [logical_state, select_candidate, reservation_order, topk_per_queue, queue_counts, service_stats, list_queues, get_queue, in_flight, next_event, list_messages_p1, list_messages_p2, list_dead_letters, delayed_schedule, materialize, compact, prune_retention, prune_idempotency, capacity_headroom, idempotency_outcomes, log_fold, snapshot_plus_tail, state_diff, lsn_gaps, log_positions, redrive_lineage, receipt_validity, lease_claims, invariant_audit, invariant_audit_broken, recovered_state_audit, delta_violations, idempotency_audit, enqueue_schedule, schedule_requests, queue_admission, queue_admission_full, message_pages, message_pages_next, dead_letter_pages, list_requests, prune_tombstones, queue_settings_audit, acknowledged_audit, acknowledged_audit_broken, state_time_audit, state_time_audit_materialized, fingerprints, name_validation, cursor_scopes, reasons, durations, store_recovery, strict_payloads, receipt_formats, result_shapes, time_addition]
QUERIES = {f.__name__: f for f in _QUERIES}
