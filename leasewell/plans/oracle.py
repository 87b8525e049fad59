"""DuckDB SQL for the queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_AT = "TIMESTAMP '1998-01-01 00:00:00'"

#: Queues, messages, receipts and logical states of the fixture.
_BASE = f"""
WITH RECURSIVE q AS (
  SELECT n_name AS queue, CASE WHEN n_nationkey % 2 = 0 THEN 'fifo' ELSE 'lifo' END AS ordering,
         n_nationkey % 4 >= 2 AS priority_enabled, CAST(5 AS BIGINT) AS max_deliveries
  FROM nation),
b AS (
  SELECT o_orderkey AS k, o_orderkey + 1 AS sequence, n_name AS queue,
         CASE WHEN n_nationkey % 4 >= 2 THEN 3 - CAST(substring(o_orderpriority, 1, 1) AS INT) ELSE 0 END AS priority,
         o_orderdate AS enqueued_at, o_orderdate + INTERVAL '1' DAY * (o_orderkey % 30) AS available_at,
         CASE WHEN o_orderstatus = 'P' THEN 'leased' WHEN o_orderstatus = 'O' THEN 'ready'
              WHEN o_orderkey % 10 = 0 THEN 'dead' ELSE 'acked' END AS state,
         CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 5
                   WHEN o_orderstatus = 'O' THEN o_orderkey % 5 ELSE 1 + o_orderkey % 5 END AS BIGINT) AS delivery_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
m AS (
  SELECT md5(CAST(sequence AS VARCHAR)) AS message_id, queue, '{{"order":' || k || '}}' AS payload, priority, sequence,
         enqueued_at, available_at, state, delivery_count, delivery_count AS lease_epoch,
         CASE WHEN state = 'leased' THEN available_at END AS leased_at,
         CASE WHEN state = 'leased' THEN available_at + INTERVAL '1' DAY * (1 + k % 90) END AS lease_until,
         CASE WHEN state = 'acked' THEN available_at END AS acked_at,
         CASE WHEN state = 'dead' THEN available_at END AS dead_at,
         sequence * 2 + delivery_count AS last_lsn
  FROM b WHERE CASE WHEN state = 'ready' THEN enqueued_at ELSE available_at END <= {_AT}),
r AS (
  SELECT queue, message_id, message_id || '.' || lease_epoch || '.' || md5(message_id || '.' || lease_epoch) AS receipt
  FROM m WHERE state = 'leased'),
l AS (
  SELECT m.*, ordering, priority_enabled, max_deliveries,
         CASE WHEN state = 'leased' AND {_AT} >= lease_until
                THEN CASE WHEN delivery_count >= max_deliveries THEN 'dead' ELSE 'ready' END
              WHEN state IN ('ready', 'delayed')
                THEN CASE WHEN {_AT} < available_at THEN 'delayed' ELSE 'ready' END
              ELSE state END AS logical_state,
         CASE WHEN priority_enabled THEN -priority ELSE 0 END AS pk,
         CASE WHEN ordering = 'lifo' THEN -sequence ELSE sequence END AS sk
  FROM m JOIN q USING (queue)),
e AS (
  SELECT *, row_number() OVER (PARTITION BY queue ORDER BY pk, sk) AS place FROM l
  WHERE logical_state = 'ready' AND available_at <= {_AT} AND delivery_count < max_deliveries),
mat AS (
  SELECT message_id, queue, sequence, logical_state AS state, enqueued_at, acked_at,
         CASE WHEN gone AND logical_state = 'ready' THEN {_AT} ELSE available_at END AS available_at,
         CASE WHEN NOT gone THEN leased_at END AS leased_at, CASE WHEN NOT gone THEN lease_until END AS lease_until,
         CASE WHEN gone AND logical_state = 'dead' THEN {_AT} ELSE dead_at END AS dead_at,
         CASE WHEN gone THEN 'visibility_timeout' END AS last_failure_reason
  FROM (SELECT *, state = 'leased' AND logical_state <> 'leased' AS gone FROM l)),
claims AS (
  SELECT sequence AS claim_id, queue, CASE WHEN sequence % 11 = 0 THEN 'unknown' ELSE message_id END AS message_id,
         message_id || '.' || (lease_epoch + CASE WHEN sequence % 7 = 0 THEN 1 ELSE 0 END) || '.' || md5(message_id || '.' || lease_epoch) AS receipt,
         available_at + INTERVAL '1' DAY * (sequence % 60) AS moment FROM m),
outcomes AS (
  SELECT claim_id, CASE WHEN m.message_id IS NULL THEN 'not_found'
                        WHEN m.state = 'leased' AND moment >= m.leased_at AND moment < m.lease_until AND claims.receipt = r.receipt THEN 'ok'
                        ELSE 'stale_receipt' END AS outcome
  FROM claims LEFT JOIN m ON claims.queue = m.queue AND claims.message_id = m.message_id
              LEFT JOIN r ON claims.queue = r.queue AND claims.message_id = r.message_id)
"""

_COUNTS = """count(*) FILTER (logical_state = 'ready') AS ready, count(*) FILTER (logical_state = 'delayed') AS delayed,
  count(*) FILTER (logical_state = 'leased') AS in_flight, count(*) FILTER (logical_state = 'dead') AS dead,
  count(*) FILTER (logical_state = 'acked') AS acked, count(*) AS total"""

_LIST = f"""SELECT queue, ordering, priority_enabled, max_deliveries, coalesce(ready, 0) AS ready, coalesce(delayed, 0) AS delayed,
  coalesce(in_flight, 0) AS in_flight, coalesce(dead, 0) AS dead, coalesce(acked, 0) AS acked, coalesce(total, 0) AS total
  FROM q LEFT JOIN (SELECT queue, {_COUNTS} FROM l GROUP BY queue) USING (queue)"""

_PAGE = "SELECT queue, sequence, priority, logical_state AS state, delivery_count, enqueued_at, available_at FROM l WHERE queue = 'NATION_7'"

#: The change log and its folds.
_LOG = """
WITH c AS (SELECT event_id + 1 AS lsn, user_id AS entity, event_type = 'error' AS deleted,
                  CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
f AS (SELECT entity, lsn, value FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY lsn DESC) = 1 AND NOT deleted),
s AS (SELECT entity, lsn, value FROM c WHERE lsn <= 500
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY lsn DESC) = 1 AND NOT deleted)
"""

_REQUESTS = """
WITH k AS (SELECT event_id AS op_seq, user_id || '|' || event_type || '|' || CAST(ts AS DATE) AS key, sha256(props) AS fingerprint, ts FROM events)
"""


def _audit(messages: str) -> str:
    """Counts of violations over a messages relation."""
    valid_receipt = "receipt LIKE message_id || '.' || lease_epoch || '.%' AND regexp_matches(receipt, '^[0-9a-f]{32}[.][0-9]+[.][0-9a-f]{32}$')"
    rules = {
        "known_queue": "max_deliveries IS NULL",
        "message_state": "state NOT IN ('delayed', 'ready', 'leased', 'acked', 'dead')",
        "message_identity": "message_id IS NULL OR message_id = ''",
        "message_times": "enqueued_at IS NULL OR available_at IS NULL",
        "message_payload": "NOT json_valid(payload)",
        "message_sequence": "sequence IS NULL OR sequence < 1 OR sequence >= 10000000",
        "message_lsn": "last_lsn IS NULL OR last_lsn < 1 OR last_lsn > 100000000",
        "epoch_is_count": "lease_epoch IS DISTINCT FROM delivery_count",
        "waiting_has_deliveries_left": "state IN ('ready', 'delayed') AND delivery_count >= max_deliveries",
        "waiting_is_not_dead": "state IN ('ready', 'delayed') AND dead_at IS NOT NULL",
        "lease_complete": "state = 'leased' AND (receipt IS NULL OR leased_at IS NULL OR lease_until IS NULL)",
        "lease_count": "state = 'leased' AND (delivery_count < 1 OR delivery_count > max_deliveries)",
        "lease_times": "state = 'leased' AND (leased_at < enqueued_at OR leased_at >= lease_until)",
        "lease_receipt": f"state = 'leased' AND NOT coalesce({valid_receipt}, false)",
        "lease_is_not_dead": "state = 'leased' AND dead_at IS NOT NULL",
        "acked_time": "state = 'acked' AND (acked_at IS NULL OR acked_at < enqueued_at)",
        "acked_count": "state = 'acked' AND (delivery_count < 1 OR delivery_count > max_deliveries)",
        "dead_count": "state = 'dead' AND delivery_count <> max_deliveries",
        "dead_time": "state = 'dead' AND (dead_at IS NULL OR dead_at < enqueued_at)",
        "lease_data_without_lease": "state <> 'leased' AND (leased_at IS NOT NULL OR lease_until IS NOT NULL OR receipt IS NOT NULL)",
        "acked_time_without_ack": "state <> 'acked' AND acked_at IS NOT NULL",
    }
    rows = f"{messages} x LEFT JOIN (SELECT queue, max_deliveries FROM q) USING (queue) LEFT JOIN r USING (queue, message_id)"
    parts = [f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {rule}) AS violations FROM {rows}" for name, rule in rules.items()]
    parts += [f"SELECT '{name}', count(*) FILTER (WHERE {rule}) FROM q" for name, rule in {"queue_name": "NOT regexp_matches(queue, '^[A-Za-z0-9._-]{1,128}$')", "queue_ordering": "ordering NOT IN ('fifo', 'lifo')", "queue_settings": "max_deliveries <= 0"}.items()]
    parts += [
        f"SELECT 'sequence_unique', count(*) FROM (SELECT sequence FROM {messages} GROUP BY sequence HAVING count(*) > 1)",
        "SELECT 'receipt_unique', count(*) FROM (SELECT receipt FROM r GROUP BY receipt HAVING count(*) > 1)",
        f"SELECT 'receipt_of_lease', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM {messages} y WHERE y.queue = r.queue AND y.message_id = r.message_id AND y.state = 'leased')",
    ]
    return " UNION ALL ".join(parts)


_BROKEN = """, broken AS (
  SELECT message_id, CASE WHEN sequence % 31 = 0 THEN 'nowhere' ELSE queue END AS queue, CASE WHEN sequence % 17 = 0 THEN '{broken' ELSE payload END AS payload,
         priority, sequence, enqueued_at, available_at, state, delivery_count + CASE WHEN sequence % 13 = 0 THEN 1 ELSE 0 END AS delivery_count, lease_epoch, leased_at,
         CASE WHEN sequence % 23 = 0 THEN available_at ELSE lease_until END AS lease_until, acked_at,
         CASE WHEN sequence % 19 = 0 THEN enqueued_at ELSE dead_at END AS dead_at, CASE WHEN sequence % 29 = 0 THEN 0 ELSE last_lsn END AS last_lsn
  FROM m) """

def _admission(room: int) -> str:
    """Requests to create queues, where there is room for so many."""
    return f"""
        WITH a AS (SELECT c_custkey AS op_seq, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' bad' ELSE '' END || '-' || (c_custkey % 40) AS queue,
                          CASE WHEN c_custkey % 4 > 0 THEN 'k' || (c_custkey % 3) END AS key, c_custkey % 7 = 0 AS fp FROM customer),
        v AS (SELECT *, regexp_matches(queue, '^[A-Za-z0-9._-]{{1,128}}$') AS ok FROM a),
        f AS (SELECT queue, min(op_seq) AS first FROM v WHERE ok GROUP BY queue),
        g AS (SELECT f.queue, f.first, v.key AS made_key, v.fp AS made_fp, row_number() OVER (ORDER BY f.first) AS place FROM f JOIN v ON v.op_seq = f.first)
        SELECT op_seq, CASE WHEN NOT ok THEN 'invalid_request' WHEN place > {room} THEN 'capacity_exceeded' WHEN op_seq = first THEN 'created'
                            WHEN key = made_key AND fp = made_fp THEN 'replayed' WHEN key = made_key THEN 'idempotency_conflict' ELSE 'conflict' END AS outcome
        FROM v LEFT JOIN g USING (queue)"""


def _pages(state: str, limit: int, skip: int = 0) -> str:
    """Pages of all queues after so many messages, with the cursor of the next page."""
    kind, wanted = ("01", f"logical_state = '{state}'") if state else ("00", "true")
    digits = lambda x: f"lpad(CAST({x} AS VARCHAR), 20, '0')"
    return f""", s AS (SELECT max(last_lsn) AS lsn, max(sequence) AS high FROM m),
        p AS (SELECT queue, sequence, logical_state AS state, row_number() OVER (PARTITION BY queue ORDER BY sequence) AS place, count(*) OVER (PARTITION BY queue) AS n FROM l WHERE {wanted}),
        w AS (SELECT *, max(sequence) OVER (PARTITION BY queue) AS last FROM p WHERE place > {skip} AND place <= {skip + limit})
        SELECT queue, sequence, state, CASE WHEN n > {skip + limit} THEN 'v3.' || substring(sha256(encode(queue) || '\\x00\\x00\\x{kind}'::BLOB), 1, 32) || '.' || {digits('lsn')} || '.' || {digits('high')} || '.'
               || {digits('last')} || '.' || {digits(3)} || '.' || {digits('9223372036854775808::HUGEINT + 883612800')} || '.000000000' END AS next_cursor
        FROM w, s"""


#: Tombstones of acknowledged messages.
_TOMBSTONES = """, t AS (SELECT queue, message_id || '.' || lease_epoch || '.' || md5(message_id || '.' || lease_epoch) AS receipt, message_id,
        acked_at + INTERVAL '1' DAY AS expires_at FROM m WHERE state = 'acked') """


def _acknowledged(tombstones: str) -> str:
    """Counts of violations over a relation of tombstones."""
    rows = f"{tombstones} x LEFT JOIN (SELECT queue, message_id, lease_epoch, acked_at FROM m WHERE state = 'acked') y USING (queue, message_id)"
    valid = "receipt LIKE message_id || '.' || lease_epoch || '.%' AND regexp_matches(receipt, '^[0-9a-f]{32}[.][0-9]+[.][0-9a-f]{32}$')"
    return f"""SELECT 'acked_receipt_identity' AS rule, count(*) FILTER (lease_epoch IS NULL OR receipt = '') AS violations FROM {rows}
        UNION ALL SELECT 'acked_receipt_lease', count(*) FILTER (lease_epoch IS NOT NULL AND NOT ({valid})) FROM {rows}
        UNION ALL SELECT 'acked_receipt_expiry', count(*) FILTER (lease_epoch IS NOT NULL AND expires_at <= acked_at) FROM {rows}
        UNION ALL SELECT 'acked_receipt_count', count(*) FROM (SELECT m.queue, m.message_id FROM m LEFT JOIN {tombstones} x ON m.queue = x.queue AND m.message_id = x.message_id
            WHERE state = 'acked' GROUP BY m.queue, m.message_id HAVING count(x.message_id) <> 1)
        UNION ALL SELECT 'receipt_unique_with_tombstones', count(*) FROM (SELECT receipt FROM (SELECT receipt FROM r UNION ALL SELECT receipt FROM {tombstones}) GROUP BY receipt HAVING count(*) > 1)"""


def _times(messages: str) -> str:
    """Stored states against the instant, and counts that do not add up."""
    return f"""SELECT 'delayed_is_available' AS rule, count(*) FILTER (state = 'delayed' AND available_at <= {_AT}) AS violations FROM {messages}
        UNION ALL SELECT 'ready_is_not_available', count(*) FILTER (state = 'ready' AND available_at > {_AT}) FROM {messages}
        UNION ALL SELECT 'count_conservation', count(*) FROM (SELECT queue FROM {messages} GROUP BY queue
            HAVING count(*) <> count(*) FILTER (state IN ('ready', 'delayed', 'leased', 'dead', 'acked')))"""


SQL = {
    "logical_state": _BASE + "SELECT queue, sequence, state, logical_state FROM l",
    "select_candidate": _BASE + "SELECT queue, sequence, priority, delivery_count, enqueued_at, available_at FROM e WHERE place = 1",
    "reservation_order": _BASE + "SELECT queue, sequence, priority, place AS position FROM e",
    "topk_per_queue": _BASE + "SELECT queue, CAST(place AS INTEGER) AS rank, sequence, priority FROM e WHERE place <= 3",
    "queue_counts": _BASE + f"SELECT queue, {_COUNTS} FROM l GROUP BY queue",
    "service_stats": _BASE + f"SELECT {_COUNTS}, (SELECT count(*) FROM q) AS queues, (SELECT coalesce(max(last_lsn), 0) FROM m) AS durable_lsn FROM l",
    "list_queues": _BASE + _LIST + " ORDER BY queue",
    "get_queue": _BASE + _LIST + " WHERE queue = 'NATION_7'",
    "in_flight": _BASE + f"SELECT queue, count(*) AS in_flight FROM m WHERE state = 'leased' AND {_AT} < lease_until GROUP BY queue",
    "next_event": _BASE + f"SELECT queue, min(d) AS next_event FROM (SELECT queue, CASE WHEN state = 'leased' THEN lease_until WHEN state IN ('ready', 'delayed') THEN available_at END AS d FROM m) WHERE d > {_AT} GROUP BY queue",
    "list_messages_p1": _BASE + _PAGE + " ORDER BY sequence LIMIT 50",
    "list_messages_p2": _BASE + _PAGE + " AND sequence > 1000 AND sequence <= 9000 AND last_lsn <= 20000 ORDER BY sequence LIMIT 50",
    "list_dead_letters": _BASE + _PAGE + " AND logical_state = 'dead' ORDER BY sequence LIMIT 50",
    "delayed_schedule": _BASE + "SELECT queue, sequence, available_at, row_number() OVER (PARTITION BY queue ORDER BY available_at, pk, sk) AS position FROM l WHERE logical_state = 'delayed'",
    "materialize": _BASE + "SELECT message_id, queue, sequence, state, available_at, leased_at, lease_until, dead_at, last_failure_reason FROM mat",
    "compact": _BASE + f"SELECT queue, state, count(*) AS n, min(sequence) AS first_sequence FROM mat WHERE NOT coalesce(state = 'acked' AND acked_at + INTERVAL '24' HOUR <= {_AT}, false) GROUP BY queue, state",
    "prune_retention": _BASE + f"SELECT queue, count(*) AS kept, count(*) FILTER (state = 'acked') AS kept_acked FROM m WHERE NOT coalesce(state = 'acked' AND acked_at + INTERVAL '24' HOUR <= {_AT}, false) GROUP BY queue",
    "prune_idempotency": _REQUESTS + "SELECT op_seq, key, ts + INTERVAL '1' DAY AS expires_at FROM k WHERE ts + INTERVAL '1' DAY > (SELECT max(ts) - INTERVAL '1' DAY FROM k)",
    "capacity_headroom": _BASE + "SELECT queue, 100000 - count(*) AS message_headroom, 10000 - count(*) FILTER (logical_state = 'leased') AS in_flight_headroom, count(*) >= 100000 AS full FROM l GROUP BY queue",
    "idempotency_outcomes": _REQUESTS + "SELECT op_seq, key, CASE WHEN op_seq = min(op_seq) OVER w THEN 'new' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM k WINDOW w AS (PARTITION BY key ORDER BY op_seq)",
    "log_fold": _LOG + "SELECT * FROM f",
    "snapshot_plus_tail": _LOG + "SELECT * FROM f",
    "state_diff": _LOG + "SELECT coalesce(s.entity, f.entity) AS entity, CASE WHEN s.entity IS NULL THEN 'insert' WHEN f.entity IS NULL THEN 'delete' ELSE 'update' END AS change, s.value AS old, f.value AS new FROM s FULL JOIN f ON s.entity = f.entity WHERE s.entity IS NULL OR f.entity IS NULL OR s.value IS DISTINCT FROM f.value",
    "lsn_gaps": _LOG + ", n AS (SELECT lsn, lead(lsn) OVER (ORDER BY lsn) AS following FROM c WHERE NOT deleted) SELECT lsn AS after_lsn, following AS next_lsn, following - lsn - 1 AS missing FROM n WHERE following - lsn > 1",
    "log_positions": _LOG + "SELECT lsn, entity, row_number() OVER (ORDER BY lsn) AS position FROM c WHERE NOT deleted",
    "redrive_lineage": "WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn AS root, CAST(0 AS BIGINT) AS depth, conv_id, turn FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id * 1000 + c.turn, t.root, t.depth + 1, c.conv_id, c.turn FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT node, root, depth FROM t",
    "receipt_validity": _BASE + "SELECT * FROM outcomes",
    "lease_claims": _BASE + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "invariant_audit": _BASE + _audit("m"),
    "invariant_audit_broken": _BASE + _BROKEN + _audit("broken"),
    "recovered_state_audit": _BASE + """, p AS (SELECT queue, count(*) AS n, count(*) FILTER (state = 'leased') AS leased FROM mat GROUP BY queue)
        SELECT 'limit_queues' AS rule, CAST(count(*) > 1000 AS BIGINT) AS violations FROM q
        UNION ALL SELECT 'limit_messages', CAST(coalesce(sum(n), 0) > 1000000 AS BIGINT) FROM p
        UNION ALL SELECT 'limit_in_flight', CAST(coalesce(sum(leased), 0) > 100000 AS BIGINT) FROM p
        UNION ALL SELECT 'limit_messages_per_queue', count(*) FILTER (n > 100000) FROM p
        UNION ALL SELECT 'limit_in_flight_per_queue', count(*) FILTER (leased > 10000) FROM p""",
    "delta_violations": """
        WITH c AS (SELECT event_id // 3 AS lsn, user_id % 5 AS key, event_type = 'error' AS deleted, 'NATION_' || (user_id % 30) AS queue FROM events),
        n AS (SELECT event_id AS lsn, event_id - CASE WHEN event_id % 101 = 100 THEN 2 ELSE 0 END AS s FROM events)
        SELECT 'deleted_and_written' AS rule, count(*) AS n FROM (SELECT 1 FROM c GROUP BY lsn, key HAVING bool_or(deleted) AND bool_or(NOT deleted))
        UNION ALL SELECT 'unknown_queue', count(*) FROM c WHERE queue NOT IN (SELECT n_name FROM nation)
        UNION ALL SELECT 'sequence_went_back', count(*) FROM (SELECT s, lead(s) OVER (ORDER BY lsn) AS t FROM n) WHERE t < s""",
    "idempotency_audit": """
        WITH i AS (SELECT list_extract(['create_queue', 'enqueue', 'receive', 'ack', 'nack', 'extend', 'redrive', 'compact'], CAST(event_id % 8 + 1 AS INT)) AS operation,
                   'NATION_' || (user_id % 26) AS queue, CASE WHEN event_id % 37 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS key,
                   CASE WHEN event_id % 41 = 0 THEN '00ff' ELSE sha256(props) END AS fingerprint, props AS result, ts AS created_at,
                   ts + INTERVAL '1' DAY * (CASE WHEN event_id % 43 = 0 THEN 0 ELSE 1 END) AS expires_at, event_id AS last_lsn FROM events)
        SELECT 'record_operation' AS rule, count(*) FILTER (operation = 'compact') AS violations FROM i
        UNION ALL SELECT 'record_key', count(*) FILTER (key = '' OR queue = '') FROM i
        UNION ALL SELECT 'record_fingerprint', count(*) FILTER (NOT regexp_matches(fingerprint, '^[0-9a-f]{64}$')) FROM i
        UNION ALL SELECT 'record_times', count(*) FILTER (NOT expires_at > created_at) FROM i
        UNION ALL SELECT 'record_lsn', count(*) FILTER (last_lsn < 1 OR last_lsn > 100000000) FROM i
        UNION ALL SELECT 'record_result', count(*) FILTER (NOT json_valid(result)) FROM i
        UNION ALL SELECT 'record_result_shape', count(*) FILTER (operation <> 'receive') FROM i
        UNION ALL SELECT 'record_queue', count(*) FILTER (queue NOT IN (SELECT n_name FROM nation)) FROM i""",
    "enqueue_schedule": """
        WITH x AS (SELECT o_orderkey AS message, o_orderdate AS now, o_orderkey % 33 - 1 AS d,
                          CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '1' DAY * (o_orderkey % 45) END AS requested FROM orders),
        y AS (SELECT *, greatest(now + INTERVAL '1' DAY * d, coalesce(requested, now)) AS moment FROM x),
        z AS (SELECT *, d BETWEEN 0 AND 30 AND moment <= now + INTERVAL '30' DAY AS ok FROM y)
        SELECT message, CASE WHEN ok THEN moment END AS available_at, CASE WHEN ok THEN CASE WHEN moment > now THEN 'delayed' ELSE 'ready' END END AS state,
               CASE WHEN NOT ok THEN 'invalid_request' END AS error FROM z""",
    "queue_admission": _admission(1000),
    "queue_admission_full": _admission(60),
    "message_pages": _BASE + _pages("", 50),
    "message_pages_next": _BASE + _pages("", 50, 50),
    "dead_letter_pages": _BASE + _pages("dead", 5),
    "list_requests": """
        WITH o AS (SELECT o_orderkey AS request, o_orderkey % 27 AS n, list_extract(['', 'ready', 'dead', 'waiting'], CAST(o_orderkey % 4 + 1 AS INT)) AS state,
                          o_orderkey % 1103 - 50 AS page, o_orderkey % 3 > 0 AS asked FROM orders)
        SELECT request, CASE WHEN page < 0 OR page > 1000 OR state = 'waiting' OR (asked AND (request % 17 = 0 OR request % 10 = 0)) THEN 'invalid_request'
                             WHEN n > 24 THEN 'not_found'
                             WHEN asked AND (request % 900 = 0 OR request % 900 > 800 OR request % 13 = 0) THEN 'invalid_request' ELSE 'ok' END AS outcome FROM o""",
    "schedule_requests": """
        WITH o AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 700 - 9 END AS ms, o_orderkey % 3 = 0 AS timed FROM orders),
        v AS (SELECT *, NOT (ms IS NOT NULL AND timed) AND coalesce(ms, 0) >= 0 AS ok FROM o)
        SELECT request, CASE WHEN ok THEN 'ok' ELSE 'invalid_request' END AS outcome, CASE WHEN ok THEN CAST(coalesce(ms, 0) * 1000 AS BIGINT) END AS delay_us FROM v""",
    "prune_tombstones": _BASE + f"""SELECT queue, message_id, message_id || '.' || lease_epoch || '.' || md5(message_id || '.' || lease_epoch) AS receipt, acked_at + INTERVAL '1' DAY AS expires_at
        FROM m WHERE state = 'acked' AND acked_at + INTERVAL '1' DAY > {_AT} - INTERVAL '100' DAY""",
    "queue_settings_audit": """
        SELECT 'queue_name' AS rule, count(*) FILTER (n_nationkey % 11 = 0) AS violations FROM nation
        UNION ALL SELECT 'queue_ordering', count(*) FILTER (n_nationkey % 7 = 0) FROM nation
        UNION ALL SELECT 'queue_settings', count(*) FILTER (n_nationkey % 5 = 0 OR n_nationkey % 4 = 0 OR n_nationkey % 9 = 0) FROM nation""",
    "acknowledged_audit": _BASE + _TOMBSTONES + _acknowledged("t"),
    "acknowledged_audit_broken": _BASE + _TOMBSTONES + """, k AS (SELECT *, ascii(substring(message_id, 1, 1)) * 256 + ascii(substring(message_id, 2, 1)) AS n FROM t),
        d AS (SELECT queue, CASE WHEN n % 5 = 0 THEN '' WHEN n % 7 = 0 THEN 'same' ELSE receipt END AS receipt, CASE WHEN n % 17 = 0 THEN 'none' ELSE message_id END AS message_id,
                     CASE WHEN n % 11 = 0 THEN expires_at - INTERVAL '2' DAY ELSE expires_at END AS expires_at, n FROM k WHERE n % 13 <> 0),
        w AS (SELECT queue, receipt, message_id, expires_at FROM d UNION ALL SELECT queue, receipt, message_id, expires_at FROM d WHERE n % 19 = 0)
        """ + _acknowledged("w"),
    "state_time_audit": _BASE + _times("m"),
    "state_time_audit_materialized": _BASE + _times("mat"),
    "fingerprints": """SELECT event_id, sha256('{"user_id":' || user_id || ',"event_type":"' || event_type || '"}') AS fingerprint FROM events""",
    "name_validation": """SELECT p_partkey AS k, regexp_full_match(p_name, '[A-Za-z0-9._-]{1,128}') AS queue_name, regexp_full_match(p_name, '[!-~]{1,256}') AS key,
        regexp_full_match(p_name, '[0-9a-f]{64}') AS fingerprint FROM part""",
    "cursor_scopes": """
        WITH s AS (SELECT n_name AS queue, unnest(['', 'delayed', 'ready', 'leased', 'acked', 'dead']) AS state FROM nation),
        t AS (SELECT queue, state, substring(sha256(encode(queue) || '\\x00'::BLOB || encode(state) || '\\x00'::BLOB || CASE WHEN state = 'dead' THEN '\\x01'::BLOB ELSE '\\x00'::BLOB END), 1, 32) AS scope FROM s)
        SELECT queue, state, scope, 'v3.' || scope || '.' || lpad('700', 20, '0') || '.' || lpad('600', 20, '0') || '.' || lpad(CAST(length(state) AS VARCHAR), 20, '0') || '.'
               || lpad('3', 20, '0') || '.' || lpad(CAST(9223372036854775808::HUGEINT + length(queue) - 9 AS VARCHAR), 20, '0') || '.123456000' AS cursor,
               CAST(length(state) AS BIGINT) AS sequence, CAST(length(queue) - 9 AS BIGINT) AS second FROM t""",
    "reasons": """
        WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations),
        c AS (SELECT conv_id, turn, s, unnest(range(0, CAST(length(s) AS BIGINT) + 1)) AS n FROM t)
        SELECT conv_id, turn, left(any_value(s), max(n)) AS reason FROM c WHERE strlen(left(s, n)) <= 512 GROUP BY conv_id, turn""",
    "durations": """
        WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 9223372036800 + o_orderkey ELSE o_orderkey - 500 END AS ms FROM orders)
        SELECT k, CASE WHEN ms >= 0 AND ms <= 9223372036854 THEN ms * 1000 END AS us FROM t""",
    "store_recovery": _LOG + "SELECT entity AS key, lsn, value FROM f",
    "strict_payloads": "SELECT event_id, event_id % 5 = 0 AS accepted, true AS utf8 FROM events",
    "receipt_formats": _BASE + "SELECT sequence, true AS own, false AS next FROM m WHERE state = 'leased'",
    "result_shapes": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 3 = 0 WHEN 1 THEN event_id % 3 = 1 WHEN 2 THEN true ELSE event_id % 3 = 0 END AS valid FROM events""",
    "time_addition": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 >= 5 THEN o_orderdate + INTERVAL '1' DAY * (o_orderkey % 50 - 5) END AS at FROM orders",
}
