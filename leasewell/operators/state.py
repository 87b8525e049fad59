"""State-as-of-time queries: what a queue table says at an instant.

Messages are facts, queues a dimension (at most ``Limits.queues`` rows, 1,000): a plain join, which Spark broadcasts by the
size it measures and otherwise shuffles and splits where a queue is hot.
Per-queue results are aggregates with partial aggregation, so a queue that holds a third of all messages costs its
tasks one row each; ranks are computed in chunks of the dense sequence so that no task sorts a whole queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasewell.functions.validation import at_epoch, cursor_fields, cursor_scope, cursor_text, epoch_second, nanosecond, page_limit
from leasewell.limits import DEFAULT, Limits
from leasewell.operators.log import positions
from leasewell.schemas import STATES

#: Sequence numbers in a chunk of the two-level rank: the most rows a task sorts together.
RANK_CHUNK = 65_536
#: Seconds in a chunk of the delayed order; delays are bounded, so a queue has at most 43,200 chunks of a minute.
DELAY_CHUNK = 60


def instant(text: str) -> Column:
    """A point in time."""
    return F.lit(text).cast("timestamp_ntz")


def with_config(messages: DataFrame, queues: DataFrame) -> DataFrame:
    """Messages with the settings of their queue (inner: a message of no queue is none)."""
    config = queues.select("queue", "ordering", "priority_enabled", "max_deliveries")
    return messages.join(config, "queue")


def logical_state(now: Column) -> Column:
    """The state a message really has: an expired lease makes it ready or dead, a passed delay makes it ready.

    A lease ends exactly at lease_until and a message is available exactly at available_at.
    """
    expired = (F.col("state") == "leased") & (F.col("lease_until").isNull() | (now >= F.col("lease_until")))
    waiting = F.col("state").isin("ready", "delayed")
    return (
        F.when(expired & (F.col("delivery_count") >= F.col("max_deliveries")), "dead")
        .when(expired, "ready")
        .when(waiting & (now < F.col("available_at")), "delayed")
        .when(waiting, "ready")
        .otherwise(F.col("state"))
    )


def with_logical_state(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """Messages with their queue's settings and logical_state."""
    return with_config(messages, queues).withColumn("logical_state", logical_state(now))


def eligible(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """Messages that a receive at this instant may take."""
    found = with_logical_state(messages, queues, now)
    return found.where((F.col("logical_state") == "ready") & (F.col("available_at") <= now) & (F.col("delivery_count") < F.col("max_deliveries")))


def order_keys() -> list[Column]:
    """Ascending sort keys of the delivery order: priority (largest first, if the queue has it), then sequence."""
    return [
        F.when(F.col("priority_enabled"), -F.col("priority").cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("priority_key"),
        F.when(F.col("ordering") == "lifo", -F.col("sequence")).otherwise(F.col("sequence")).alias("sequence_key"),
    ]


def select_candidate(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """The next message of each queue, by hash aggregation: the first of each priority, then the first of those.

    A minimum of whole structs would make Spark sort every row before it aggregates; minima of numbers do not.
    """
    shown = ["sequence", "priority", "delivery_count", "enqueued_at", "available_at"]
    rows = eligible(messages, queues, now).select("queue", *order_keys(), *shown)
    by_priority = rows.groupBy("queue", "priority_key").agg(F.min("sequence_key").alias("first"), *(F.min_by(c, "sequence_key").alias(c) for c in shown))
    best = by_priority.groupBy("queue").agg(F.min(F.struct("priority_key", "first", *shown)).alias("best"))
    return best.select("queue", *(F.col(f"best.{c}").alias(c) for c in shown))


def top_k(messages: DataFrame, queues: DataFrame, now: Column, k: int) -> DataFrame:
    """The next k messages of each queue, as k receives at one instant would take them."""
    priority_key, sequence_key = order_keys()
    rank = F.row_number().over(Window.partitionBy("queue").orderBy(priority_key, sequence_key))
    return eligible(messages, queues, now).withColumn("rank", rank).where(F.col("rank") <= k).select("queue", "rank", "sequence", "priority")


def reservation_order(messages: DataFrame, queues: DataFrame, now: Column, chunk: int = RANK_CHUNK) -> DataFrame:
    """The place of every eligible message in its queue's delivery order.

    Rows are numbered within (queue, priority, chunk of sequence) and moved on by the sizes of the chunks before, so
    the largest sort is one chunk however long a queue is.
    """
    rows = eligible(messages, queues, now).select("queue", "sequence", "priority", *order_keys()).withColumn("chunk", F.floor(F.col("sequence_key") / chunk))
    part = ["queue", "priority_key", "chunk"]
    sizes = rows.groupBy(*part).count()
    before = Window.partitionBy("queue").orderBy("priority_key", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*part).orderBy("sequence_key"))
    return rows.withColumn("within", within).join(offsets, part).select("queue", "sequence", "priority", (F.col("within") + F.col("offset")).alias("position"))


def count_columns() -> list[Column]:
    """Counts by logical state."""
    named = [("ready", "ready"), ("delayed", "delayed"), ("in_flight", "leased"), ("dead", "dead"), ("acked", "acked")]
    return [*(F.count_if(F.col("logical_state") == state).alias(name) for name, state in named), F.count("*").alias("total")]


def queue_counts(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """Counts of each queue that has messages."""
    return with_logical_state(messages, queues, now).groupBy("queue").agg(*count_columns())


def list_queues(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """All queues with their settings and counts, by name."""
    counts = queue_counts(messages, queues, now)
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ready", "delayed", "in_flight", "dead", "acked", "total")]
    return queues.join(counts, "queue", "left").select("queue", "ordering", "priority_enabled", "max_deliveries", *filled).orderBy("queue")


def get_queue(messages: DataFrame, queues: DataFrame, now: Column, name: str) -> DataFrame:
    """One queue with its counts; no row if there is none."""
    own = F.col("queue") == name
    return list_queues(messages.where(own), queues.where(own), now)


def service_stats(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """Counts of the whole service: one aggregate over messages and queues together."""
    rows = with_logical_state(messages, queues, now).select("logical_state", "last_lsn", F.lit(False).alias("is_queue"))
    both = rows.unionByName(queues.select(F.lit(True).alias("is_queue")), allowMissingColumns=True)
    states = count_columns()[:-1]
    return both.agg(*states, F.count_if(~F.col("is_queue")).alias("total"), F.count_if("is_queue").alias("queues"), F.coalesce(F.max("last_lsn"), F.lit(0)).alias("durable_lsn"))


def in_flight(messages: DataFrame, now: Column) -> DataFrame:
    """Leases that hold at this instant, by queue."""
    return messages.where((F.col("state") == "leased") & (now < F.col("lease_until"))).groupBy("queue").agg(F.count("*").alias("in_flight"))


def next_event(messages: DataFrame, now: Column) -> DataFrame:
    """The next instant at which a queue changes by itself: a delay or a lease ends."""
    deadline = F.when(F.col("state").isin("ready", "delayed"), F.col("available_at")).when(F.col("state") == "leased", F.col("lease_until"))
    return messages.withColumn("deadline", deadline).where(F.col("deadline") > now).groupBy("queue").agg(F.min("deadline").alias("next_event"))


def list_messages(messages: DataFrame, queues: DataFrame, now: Column, queue: str | None = None, state: str | None = None, after: int = 0, high_water: int | None = None, snapshot_lsn: int | None = None, limit: int = DEFAULT.default_list_limit) -> DataFrame:
    """A page of messages by sequence, as of a frozen instant.

    Rows changed since the first page (last_lsn beyond snapshot_lsn) and rows beyond its high-water mark are left
    out.  The filter reaches the scan and the page is a top-k, not a sort.
    """
    rows = messages if queue is None else messages.where(F.col("queue") == queue)
    rows = rows.where(F.col("sequence") > after)
    if high_water is not None:
        rows = rows.where(F.col("sequence") <= high_water)
    if snapshot_lsn is not None:
        rows = rows.where(F.col("last_lsn") <= snapshot_lsn)
    rows = with_logical_state(rows, queues, now)
    if state is not None:
        rows = rows.where(F.col("logical_state") == state)
    page = rows.orderBy("sequence").limit(limit)
    return page.select("queue", "sequence", "priority", F.col("logical_state").alias("state"), "delivery_count", "enqueued_at", "available_at")


def delayed_schedule(messages: DataFrame, queues: DataFrame, now: Column, seconds: int = DELAY_CHUNK) -> DataFrame:
    """Delayed messages in the order in which they become available (ties: delivery order).

    Rows are numbered within (queue, minute of availability) and moved on by the sizes of the minutes before.
    """
    rows = with_logical_state(messages, queues, now).where(F.col("logical_state") == "delayed")
    rows = rows.select("queue", "sequence", "available_at", *order_keys(), F.floor(epoch_second(F.col("available_at")) / seconds).alias("chunk"))
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("queue", "chunk").count().select("queue", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("queue", "chunk").orderBy("available_at", "priority_key", "sequence_key"))
    return rows.withColumn("within", within).join(offsets, ["queue", "chunk"]).select("queue", "sequence", "available_at", (F.col("within") + F.col("offset")).alias("position"))


def pages(messages: DataFrame, queues: DataFrame, now: Column, limit: int, generation: int = 0, state: str | None = None, dead_only: bool = False, cursors: DataFrame | None = None) -> DataFrame:
    """A page of every queue, by sequence, with the cursor of the next page (null on the last one).

    Without cursors (queue, cursor) these are first pages: the snapshot is the last log position, the high-water mark the
    last sequence, and the time is now.  Else each page goes on after its cursor, as of its snapshot and time; queues
    whose cursor is malformed or of another scope have no page.  A queue's page is a top-k of ``limit`` + 1 rows.
    """
    limit = page_limit(limit)
    if state is not None and state not in STATES:
        raise ValueError("invalid_request: message state filter is invalid")
    wanted = F.lit("dead" if dead_only else state)
    scope = cursor_scope("queue", F.lit(state or ""), F.lit(dead_only))
    if cursors is None:
        last = messages.agg(F.coalesce(F.max("last_lsn"), F.lit(0)).alias("lsn"), F.coalesce(F.max("sequence"), F.lit(0)).alias("high"))
        rows = messages.withColumns({"snapshot_lsn": last.select("lsn").scalar(), "high_water": last.select("high").scalar(), "after": F.lit(0), "generation": F.lit(generation), "at": now})
    else:
        fields = cursors.select("queue", cursor_fields("cursor").alias("f")).where((F.col("f.scope") == scope) & (F.col("f.snapshot_lsn") > 0) & (F.col("f.generation") == generation))
        at = at_epoch(F.col("f.second"), F.col("f.nano"))
        rows = messages.join(fields.select("queue", "f.snapshot_lsn", "f.high_water", F.col("f.sequence").alias("after"), "f.generation", at.alias("at")), "queue")
    rows = rows.where((F.col("sequence") > F.col("after")) & (F.col("sequence") <= F.col("high_water")) & (F.col("last_lsn") <= F.col("snapshot_lsn")))
    rows = with_config(rows, queues).withColumn("logical_state", logical_state(F.col("at")))
    if state is not None or dead_only:
        rows = rows.where(F.col("logical_state") == wanted)
    order = Window.partitionBy("queue").orderBy("sequence")
    page = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    whole = Window.partitionBy("queue")
    more, last_shown = F.max("place").over(whole) > limit, F.max(F.when(F.col("place") <= limit, F.col("sequence"))).over(whole)
    text = cursor_text(scope, F.col("snapshot_lsn"), F.col("high_water"), last_shown, F.col("generation"), epoch_second(F.col("at")), nanosecond(F.col("at")))
    page = page.withColumn("next_cursor", F.when(more, text)).where(F.col("place") <= limit)
    return page.select("queue", "sequence", F.col("logical_state").alias("state"), "next_cursor")


def list_request_outcomes(requests: DataFrame, queues: DataFrame, durable_lsn: Column, generation: Column) -> DataFrame:
    """ok, invalid_request or not_found for requests (request, queue, state, dead_only, page, cursor) of a page."""
    known = requests.join(queues.select("queue", F.lit(True).alias("known")), "queue", "left").withColumn("f", cursor_fields("cursor"))
    asked, f = F.coalesce("cursor", F.lit("")) != "", F.col("f")
    bad_page = (F.col("page") < 0) | (F.col("page") > DEFAULT.list_limit)
    bad_state = (F.coalesce("state", F.lit("")) != "") & ~F.col("state").isin(*STATES)
    bad_cursor = asked & (f.isNull() | (f["scope"] != cursor_scope("queue", F.col("state"), F.col("dead_only"))))
    lost = asked & ((f["snapshot_lsn"] == 0) | (f["snapshot_lsn"] > durable_lsn) | (f["generation"] != generation))
    sure = lambda c: F.coalesce(c, F.lit(False))
    outcome = F.when(sure(bad_page) | sure(bad_state) | sure(bad_cursor), "invalid_request").when(F.col("known").isNull(), "not_found").when(sure(lost), "invalid_request").otherwise("ok")
    return known.select("request", outcome.alias("outcome"))


def admission(requests: DataFrame, most_queues: int = DEFAULT.queues) -> DataFrame:
    """(op_seq, outcome) of requests (op_seq, queue, valid, key, fingerprint) to create queues, in the order of op_seq.

    The first valid request of a name creates it while there is room.  A later one is a replay if it carries the key of
    the request that did, and a conflict with it if it asks for something else under that key.  Places among the
    creating requests are dense ranks in chunks; refused requests leave no record.
    """
    first = requests.where("valid").groupBy("queue").agg(F.min("op_seq").alias("first"), F.min_by("key", "op_seq").alias("made_key"), F.min_by("fingerprint", "op_seq").alias("made_of"))
    placed = positions(first, "first", "place")
    same_key = F.col("key").isNotNull() & (F.col("key") == F.col("made_key"))
    outcome = (
        F.when(~F.col("valid"), "invalid_request")
        .when(F.col("place") > most_queues, "capacity_exceeded")
        .when(F.col("op_seq") == F.col("first"), "created")
        .when(same_key & (F.col("fingerprint") == F.col("made_of")), "replayed")
        .when(same_key, "idempotency_conflict")
        .otherwise("conflict")
    )
    return requests.join(placed, "queue", "left").select("op_seq", outcome.alias("outcome"))


def materialize(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """Messages with their logical state written into them.

    An expired lease is cleared with reason visibility_timeout; the message is dead from now, or available from now.
    """
    rows = with_logical_state(messages, queues, now)
    expired = (F.col("state") == "leased") & (F.col("logical_state") != "leased")
    changes = {
        "state": F.col("logical_state"),
        "available_at": F.when(expired & (F.col("logical_state") == "ready"), now).otherwise(F.col("available_at")),
        "leased_at": F.when(~expired, F.col("leased_at")),
        "lease_until": F.when(~expired, F.col("lease_until")),
        "dead_at": F.when(expired & (F.col("logical_state") == "dead"), now).otherwise(F.col("dead_at")),
        "last_failure_reason": F.when(expired, "visibility_timeout").otherwise(F.col("last_failure_reason")),
    }
    return rows.withColumns(changes).select(messages.columns)


def prune_acked(messages: DataFrame, now: Column, retention_us: int = DEFAULT.ack_retention) -> DataFrame:
    """Messages without those acknowledged so long ago."""
    gone = (F.col("state") == "acked") & (F.col("acked_at") + F.make_dt_interval(secs=F.lit(retention_us / 1e6)) <= now)
    return messages.where(~F.coalesce(gone, F.lit(False)))


def prune_expired(records: DataFrame, now: Column) -> DataFrame:
    """Idempotency records or acknowledgement tombstones that have not expired."""
    return records.where(F.col("expires_at") > now)


def capacity_headroom(messages: DataFrame, queues: DataFrame, now: Column, limits: Limits = DEFAULT) -> DataFrame:
    """What each queue may still take."""
    held = with_logical_state(messages, queues, now).groupBy("queue").agg(F.count("*").alias("n"), F.count_if(F.col("logical_state") == "leased").alias("leased"))
    return held.select("queue", (F.lit(limits.messages_per_queue) - F.col("n")).alias("message_headroom"), (F.lit(limits.in_flight_per_queue) - F.col("leased")).alias("in_flight_headroom"), (F.col("n") >= limits.messages_per_queue).alias("full"))


def compact(messages: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """The messages of the next snapshot: materialized, without acknowledged ones past retention."""
    return prune_acked(materialize(messages, queues, now), now)
