"""Literal cases of order, boundaries, retention and pages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leasewell.operators import log, state
from leasewell.schemas import MESSAGES, QUEUES

T0 = datetime(2026, 8, 26, 20)


def queue(spark, name="jobs", ordering="fifo", priority=False, most=2):
    return spark.createDataFrame([(name, ordering, priority, 0, 60_000_000, most, T0)], QUEUES)


def messages(spark, *rows):
    names = [c.split()[0] for c in MESSAGES.split(", ")]
    base = {"queue": "jobs", "payload": "{}", "priority": 0, "enqueued_at": T0, "available_at": T0, "state": "ready", "delivery_count": 0, "lease_epoch": 0, "last_lsn": 1}
    full = [{n: (base | {"message_id": f"m{k}", "sequence": k} | r).get(n) for n in names} for k, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], MESSAGES)


def at(moment):
    return state.instant(moment.isoformat(sep=" "))


def order(spark, rows, q, moment=T0):
    return [r.sequence for r in state.reservation_order(rows, q, at(moment)).orderBy("position").collect()]


def test_four_policies(spark):
    rows = messages(spark, *({"priority": p} for p in (1, 3, 3, -1)))
    assert order(spark, rows, queue(spark)) == [1, 2, 3, 4]
    assert order(spark, rows, queue(spark, ordering="lifo")) == [4, 3, 2, 1]
    assert order(spark, rows, queue(spark, priority=True)) == [2, 3, 1, 4]
    assert order(spark, rows, queue(spark, ordering="lifo", priority=True)) == [3, 2, 1, 4]


def test_rank_is_the_same_in_small_chunks(spark):
    rows = messages(spark, *({"priority": k % 3} for k in range(30)))
    for q in (queue(spark, priority=True), queue(spark, ordering="lifo"), queue(spark, ordering="lifo", priority=True)):
        got = {r.sequence: r.position for r in state.reservation_order(rows, q, at(T0), chunk=4).collect()}
        assert got == {r.sequence: r.position for r in state.reservation_order(rows, q, at(T0)).collect()}
        top = state.top_k(rows, q, at(T0), 30).collect()
        assert got == {r.sequence: r.rank for r in top}


def test_delay_gates_and_does_not_rank(spark):
    rows, q = messages(spark, {"priority": 10, "available_at": T0 + timedelta(minutes=1)}, {"priority": 1}), queue(spark, priority=True)
    assert order(spark, rows, q) == [2]
    assert order(spark, rows, q, T0 + timedelta(minutes=1)) == [1, 2]
    assert order(spark, rows, q, T0 + timedelta(seconds=60, microseconds=-1)) == [2]


def test_lease_is_half_open(spark):
    lease = {"state": "leased", "delivery_count": 1, "lease_epoch": 1, "leased_at": T0, "lease_until": T0 + timedelta(seconds=1)}
    rows, q = messages(spark, lease, lease | {"delivery_count": 2, "lease_epoch": 2}), queue(spark)
    said = lambda moment: [r.logical_state for r in state.with_logical_state(rows, q, at(moment)).orderBy("sequence").collect()]
    assert said(T0 + timedelta(microseconds=999_999)) == ["leased", "leased"]
    assert said(T0 + timedelta(seconds=1)) == ["ready", "dead"]


def test_materialize_writes_expired_leases(spark):
    lease = {"state": "leased", "delivery_count": 1, "leased_at": T0, "lease_until": T0 + timedelta(seconds=1)}
    now = T0 + timedelta(seconds=9)
    first, second = state.materialize(messages(spark, lease, lease | {"delivery_count": 2}), queue(spark), at(now)).orderBy("sequence").collect()
    assert (first.state, first.available_at, first.lease_until, first.last_failure_reason) == ("ready", now, None, "visibility_timeout")
    assert (second.state, second.dead_at, second.available_at) == ("dead", now, T0)


def test_pages_leave_out_later_changes(spark):
    rows, q = messages(spark, *({"last_lsn": 5 if k == 2 else 1} for k in range(5))), queue(spark)
    page = state.list_messages(rows, q, at(T0), "jobs", after=1, high_water=4, snapshot_lsn=4, limit=10)
    assert [r.sequence for r in page.collect()] == [2, 4]


def test_empty_tables(spark):
    rows, q = messages(spark).limit(0), queue(spark)
    assert state.select_candidate(rows, q, at(T0)).count() == 0
    assert state.list_queues(rows, q, at(T0)).first().total == 0
    assert state.service_stats(rows, q, at(T0)).first().durable_lsn == 0
    assert state.reservation_order(rows, q, at(T0)).count() == 0


def test_candidate_shuffles_one_row_a_task(spark):
    plan = state.select_candidate(messages(spark, {}, {}), queue(spark), at(T0))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_retention_boundary(spark):
    rows = messages(spark, {"state": "acked", "acked_at": T0}, {"state": "acked", "acked_at": T0 + timedelta(microseconds=1)})
    assert [r.sequence for r in state.prune_acked(rows, at(T0 + timedelta(days=1))).collect()] == [2]


def test_gaps_across_chunks(spark):
    rows = spark.createDataFrame([(k,) for k in (1, 2, 5, 8, 9, 17)], "lsn bigint")
    got = sorted(tuple(r) for r in log.gaps(rows, chunk=4).collect())
    assert got == [(2, 5, 2), (5, 8, 2), (9, 17, 7)]


def test_diff_and_fold(spark):
    changes = spark.createDataFrame([(1, "a", False, "1"), (2, "b", False, "2"), (3, "a", True, None), (4, "c", False, "3")], "lsn bigint, entity string, deleted boolean, value string")
    folded = {r.entity: r.value for r in log.fold(changes).collect()}
    assert folded == {"b": "2", "c": "3"}
    tail = log.snapshot_plus_tail(log.fold(changes.where("lsn <= 2")), changes, 2)
    assert {r.entity: r.value for r in tail.collect()} == folded
    diff = log.state_diff(log.fold(changes.where("lsn <= 2")), log.fold(changes))
    assert sorted((r.entity, r.change) for r in diff.collect()) == [("a", "delete"), ("c", "insert")]


def test_roots_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k - 1 if k % 100 else None) for k in range(300)], "node bigint, parent bigint")
    got = log.roots(edges).agg(F.count_if(F.col("root") == F.floor(F.col("node") / 100) * 100), F.max("depth")).first()
    assert tuple(got) == (300, 99)


def test_deadlines_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from leasewell.streaming.deadlines import deadlines

    begin = datetime(2026, 8, 26, 20)
    rows = [("q", begin + timedelta(seconds=10 * k)) for k in range(12)] + [("q", begin + timedelta(days=1))]
    spark.createDataFrame(rows, "queue string, lease_until timestamp_ntz").selectExpr("queue", "CAST(lease_until AS timestamp) AS lease_until").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("queue string, lease_until timestamp").parquet(str(tmp_path / "in"))
    query = deadlines(stream).writeStream.format("memory").queryName("deadlines").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("deadlines").collect()) == [1, 6, 6]


def test_delayed_order_is_the_same_in_chunks(spark):
    from leasewell.operators import state
    from leasewell.sources import fixtures as fx
    from tests.oracle import DATA

    rows, queues, now = fx.messages(spark, DATA), fx.queues(spark, DATA), state.instant(fx.AS_OF)
    got = {tuple(r) for r in state.delayed_schedule(rows, queues, now, 10**9).collect()}
    assert got == {tuple(r) for r in state.delayed_schedule(rows, queues, now, 60).collect()}
