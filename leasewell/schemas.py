"""Schemas of the queue model.  Times are UTC without zone, in microseconds; unsigned 64-bit numbers are BIGINT."""

from __future__ import annotations




#: A queue's settings.  Durations are microseconds.
QUEUES = "queue string, ordering string, priority_enabled boolean, default_delay_us bigint, default_visibility_us bigint, max_deliveries bigint, created_at timestamp_ntz"
#: A message; lease columns are null unless it is leased.
MESSAGES = "message_id string, queue string, payload string, priority int, sequence bigint, enqueued_at timestamp_ntz, available_at timestamp_ntz, state string, delivery_count bigint, lease_epoch bigint, leased_at timestamp_ntz, lease_until timestamp_ntz, acked_at timestamp_ntz, dead_at timestamp_ntz, last_failure_reason string, replay_of string, last_lsn bigint"
RECEIPTS = "queue string, message_id string, receipt string"
ACK_RECEIPTS = "queue string, receipt string, message_id string, expires_at timestamp_ntz"
IDEMPOTENCY = "operation string, queue string, key string, fingerprint string, result string, created_at timestamp_ntz, expires_at timestamp_ntz, last_lsn bigint"
#: A change of the log: a tombstone has op 'delete' and a null value.
CHANGES = "lsn bigint, entity string, key string, op string, value string"

STATES = ("delayed", "ready", "leased", "acked", "dead")
ERRORS = ("invalid_request", "not_found", "conflict", "stale_receipt", "idempotency_conflict", "capacity_exceeded", "storage_unavailable", "closed")


def empty(spark, schema: str):
    """An empty table of a schema."""
    return spark.createDataFrame([], schema)
