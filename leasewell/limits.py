"""Limits of the queue model: each has an error outcome when it is passed."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


@dataclass(frozen=True)
class Limits:
    """Counts, bytes and durations (microseconds)."""

    queues: int = 1_000
    messages: int = 1_000_000
    messages_per_queue: int = 100_000
    payload_bytes: int = 1 << 20
    idempotency_records: int = 1_000_000
    key_bytes: int = 256
    wait: int = 30 * SECOND
    visibility: int = 12 * HOUR
    delay: int = 30 * DAY
    in_flight: int = 100_000
    in_flight_per_queue: int = 10_000
    idempotency_retention: int = DAY
    ack_retention: int = DAY
    list_limit: int = 1_000
    default_list_limit: int = 100
    reason_bytes: int = 512
    last_sequence: int = 2**63 - 1


DEFAULT = Limits()
