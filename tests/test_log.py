"""Golden values, invariants and edges of the log operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.keys import blob_key, floor_to, id_floor, id_text, id_time_ms, parse_window_key, sip_partition, siphash13, varint_size, virtual_partition, window_key
from tidemark.operators import control, inspect, lease, log, placement, scan
from tidemark.operators.cost import DEFAULTS, cost, parameters, parse_override
from tidemark.plans import windows
from tidemark.streaming.reader import Reader, read_batch


def test_siphash_golden():
    got = siphash13([b"", b"a", b"telemetry", b"partition-key-177", bytes([0, 1, 2, 3, 255])])
    assert [f"{int(x):016x}" for x in got] == ["bd60acb658c79e45", "beb9a6bbf61b58b4", "082f9fc92c2bb490", "2555fd88a87d0004", "cd619664a1386abe"]
    assert [int(got[3]) % 17, int(got[4]) % 17] == [9, 11]


def test_partition_of_keys(spark):
    df = spark.createDataFrame([(b"partition-key-177",), (bytes([0, 1, 2, 3, 255]),), (None,)], "k binary")
    assert [r[0] for r in df.select(sip_partition(F.col("k"), 17)).collect()] == [9, 11, None]


def test_keys(spark):
    row = spark.range(1).select(
        floor_to(F.lit(1_700_000_000), 300).alias("w"),
        floor_to(F.lit(-1), 300).alias("neg"),
        window_key(F.lit("telemetry"), F.lit(1699999800)).alias("key"),
        parse_window_key(F.lit("a#b#-300")).alias("p"),
        parse_window_key(F.lit("nothing")).alias("bad"),
        id_text(F.lit(12)).alias("t"),
        id_time_ms(id_floor(F.lit(1_700_000_000_003))).alias("up"),
        virtual_partition(F.lit(3), 2, 16).alias("vp"),
        virtual_partition(F.lit(2**32 - 2), 5, 16).alias("held"),
        blob_key(F.lit(300), F.lit(7), prefix=" x/ ").alias("blob"),
        F.array(*[varint_size(F.lit(v)) for v in (0, 127, 128, 16383, 16384, 2**35)]).alias("sizes"),
    ).first()
    assert (row.w, row.neg, row.key, row.t, row.vp, row.held) == (1699999800, -300, "telemetry#1699999800", "00000000000000000012", 35, 2**32 - 1)
    assert (row.p.topic, row.p.window_start, row.bad.topic, row.bad.window_start) == ("a#b", -300, None, None)
    assert (row.up, row.blob, row.sizes) == (1_700_000_000_010, "x/shared/300/7.zst", [1, 1, 2, 2, 3, 6])


GOLDEN = [  # cursor, batches in source order, issues in source order, issues in sequence order
    (10, [(1, 20), (5, 30)], [("overlap", 11, 20, None)], [("overlap", 11, 20, None)]),
    (10, [(11, 30), (12, 20)], [("overlap", 12, 20, None)], [("overlap", 12, 20, None)]),
    (10, [(21, 25), (11, 20)], [("gap", 11, 20, None), ("out_of_order", 11, 20, 26)], []),
    (11480895592, [(11480895580, 11480895592), (11480907916, 11480907920)], [("gap", 11480895593, 11480907915, None)], [("gap", 11480895593, 11480907915, None)]),
    (10, [(1, 100)], [], []),
]


@pytest.mark.parametrize("cursor,rows,source,sequence", GOLDEN)
def test_continuity_golden(spark, cursor, rows, source, sequence):
    idx = spark.createDataFrame([("t", 0, k, s, e) for k, (s, e) in enumerate(rows)], "topic string, vp int, snowflake_id long, seq_start long, seq_end long")
    cur = spark.createDataFrame([("t", 0, cursor)], "topic string, vp int, cursor long")
    take = lambda order: [tuple(r)[3:] for r in inspect.continuity(idx, cur, order, "x").orderBy("issue_start", "kind").collect()]
    assert take(["snowflake_id"]) == source
    assert take(["seq_start", "seq_end"]) == sequence


def fold(cursor, rows):
    """The frontier rule, row by row."""
    expected, high, out = cursor + 1, cursor + 1, []
    for s, e in rows:
        if e < expected:
            if e > cursor:
                out.append(("overlap", s, e, None) if s >= high else ("out_of_order", s, e, expected))
            continue
        if s > expected:
            out.append(("gap", expected, s - 1, None))
        elif max(s, cursor + 1) < expected:
            out.append(("overlap", max(s, cursor + 1), expected - 1, None))
        expected, high = e + 1, s
    return out


def test_continuity_random(spark):
    rng, rows, want = random.Random(5), [], {}
    for vp in range(150):
        batch = [(s := rng.randint(0, 40), s + rng.randint(0, 9)) for _ in range(rng.randint(1, 9))]
        rows += [("t", vp, k, s, e) for k, (s, e) in enumerate(batch)]
        want[vp] = sorted(fold(10, batch), key=str)
    idx = spark.createDataFrame(rows, "topic string, vp int, snowflake_id long, seq_start long, seq_end long")
    cur = spark.createDataFrame([("t", vp, 10) for vp in want], "topic string, vp int, cursor long")
    got = {vp: [] for vp in want}
    for r in inspect.continuity(idx, cur, ["snowflake_id"], "x").collect():
        got[r.vp].append(tuple(r)[3:])
    assert {k: sorted(v, key=str) for k, v in got.items()} == want


def test_cursor_context_golden(spark):
    ends = (90, 100, 110, 120, 130)
    idx = spark.createDataFrame([("t", 0, e, e - 9, e) for e in ends], "topic string, vp int, snowflake_id long, seq_start long, seq_end long")
    cur = spark.createDataFrame([("t", 0, 100)], "topic string, vp int, cursor long")
    got = inspect.cursor_context(idx, cur, 1).orderBy("position").collect()
    assert [(r.position, r.relation) for r in got] == [(1, "before_or_at"), (2, "crosses"), (3, "after")]


def test_boundaries(spark):
    idx = spark.createDataFrame([("t", 0, 0, 5, 1, 3, 10), ("t", 0, 0, 6, 4, 6, 11)], "topic string, vp int, window_start long, snowflake_id long, seq_start long, seq_end long, published_ms long")
    cur = spark.createDataFrame([("t", 0, 3)], "topic string, vp int, cursor long")
    assert [(r.seq_start, r.deliver_from, r.suffix) for r in scan.after_cursor(idx, cur).collect()] == [(4, 4, False)]
    cur = spark.createDataFrame([("t", 0, 5)], "topic string, vp int, cursor long")
    assert [r.offset for r in scan.exploded(scan.after_cursor(idx, cur)).collect()] == [6]
    assert [r.visible for r in scan.visibility(idx, 10).orderBy("seq_start").collect()] == [True, False]
    bounds = spark.createDataFrame([("t", 0, 6)], "topic string, vp int, min_snowflake long")
    assert [r.snowflake_id for r in scan.bounded_scan(idx, bounds).collect()] == [6]
    none = spark.createDataFrame([("t", 0, None), ("t", 1, 6)], "topic string, vp int, min_snowflake long")
    assert windows.shared_floor(none, ["topic"]).first().floor is None
    leases = spark.createDataFrame([("t", 0, 100), ("t", 1, 101)], "topic string, vp int, expiry_ms long")
    assert [r.vp for r in lease.active(leases, 100).collect()] == [1]


def test_capacity_is_a_prefix(spark):
    rows = spark.createDataFrame([("t", 0, k, b) for k, b in enumerate((50, 10, 5))] + [("t", 1, k, b) for k, b in enumerate((5, 20, 1))], "topic string, vp int, n long, payload_bytes long")
    got = scan.capacity_prefix(rows, 12, ["topic", "vp"], ["n"]).orderBy("vp", "n").collect()
    assert [r.admitted for r in got] == [True, False, False, True, False, False]


def test_offset_sources_equals_brute_force(spark):
    rng = random.Random(3)
    batches, at = [], 0
    for k in range(40):
        at += rng.choice((0, 0, 7))
        batches.append(("t", k % 2, k, k, at, at + rng.randint(0, 30)))
        at += 31
    offsets = [("t", v, o) for v in (0, 1) for o in range(at + 5)]
    got = scan.offset_sources(spark.createDataFrame(offsets, "topic string, vp int, offset long"), spark.createDataFrame(batches, "topic string, vp int, window_start long, snowflake_id long, seq_start long, seq_end long"), 16)
    want = {(v, o): next((b[2] for b in batches if b[1] == v and b[4] <= o <= b[5]), None) for _, v, o in offsets}
    assert {(r.vp, r.offset): r.source_window for r in got.collect()} == want


def test_islands_and_cover(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 12), ("a", 10, 11)], "k string, start long, end long")
    assert sorted((r.start, r.end) for r in windows.islands(i, ["k"], "start", "end").collect()) == [(0, 7), (9, 12)]
    want = spark.createDataFrame([("a", 1, 6), ("a", 6, 10), ("a", 8, 9)], "k string, start long, end long")
    got = windows.uncovered(want, windows.islands(i, ["k"], "start", "end").drop("parts"), ["k"])
    assert sorted((r.start, r.rest_start) for r in got.collect()) == [(1, 6), (6, 7), (8, 8)]


def test_horizons():
    assert windows.Horizon().ms == 15_010
    assert windows.Horizon.eventual().ms == 17_260


def test_pack_sizes():
    assert control.pack_sizes([3, 3, 3], 10) == [0, 0, 0]
    assert control.pack_sizes([10], 10) == [0]
    assert control.pack_sizes([25, 1, 1], 10) == [0, 1, 1]
    assert control.pack_sizes([], 10) == []
    rng = random.Random(2)
    for _ in range(300):
        cap, sizes = 50, [rng.randint(1, 60) for _ in range(rng.randint(1, 15))]
        got = control.pack_sizes(sizes, cap)
        greedy, total = 1, 0
        for s in sizes:
            if total and total + s > cap:
                greedy, total = greedy + 1, 0
            total += s
        assert got == sorted(got) and got[-1] + 1 == greedy
        for k in set(got):
            part = [s for s, o in zip(sizes, got, strict=True) if o == k]
            assert sum(part) <= cap or len(part) == 1


def test_flush_delay():
    c = control.FlushDelay(50, 1000)
    assert [c.observe(3, True) for _ in range(3)] == [1000, 1000, 812]
    assert [c.observe(0, True) for _ in range(3)] == [812, 812, 906]
    assert c.observe(0, False) == 906 and c.clean == 0
    at_floor = control.FlushDelay(50, 50)
    assert [at_floor.observe(9, True) for _ in range(5)] == [50] * 5 and at_floor.split == 5
    assert control.FlushDelay(50, 1000, enabled=False).observe(5, True) == 1000


def test_backoff():
    assert [control.backoff_ms(k) for k in range(8)] == [25, 50, 100, 200, 400, 800, 1000, 1000]


def test_producer_lease():
    s = lease.ProducerLease()
    do = lambda cmd, now, who="a", session="1", size=None: s.apply(cmd, now, who, session, 100, size)
    assert do("heartbeat", 0)["status"] == "Expired"
    assert do("acquire", 0)["epoch"] == 1
    assert do("acquire", 50)["epoch"] == 1
    assert do("acquire", 149, "b")["status"] == "HeldByOther"
    assert do("acquire", 149, "a", "2")["status"] == "HeldByOther"
    assert do("reserve", 140, size=10)["block_end"] == 9
    assert do("reserve", 140, size=5)["block_start"] == 10
    assert do("reserve", 140, size=0)["status"] == "InvalidSize"
    assert do("acquire", 150, "a", "1")["epoch"] == 2
    assert do("release", 160)["expiry_ms"] == 160
    assert do("acquire", 160, "b", "9", 3) == {"status": "Ok", "epoch": 3, "expiry_ms": 260, "block_start": 15, "block_end": 17, "max_seq": 17}
    s.max_seq = 2**63 - 2
    assert do("reserve", 170, "b", "9", 5)["status"] == "Overflow" and s.max_seq == 2**63 - 2


def test_consumer_lease():
    s = lease.ConsumerLease()
    do = lambda cmd, now, who="a", generation=1, cursor=None: s.apply(cmd, now, who, generation, 100, cursor)
    assert do("assign", 0)["transition"] == "Initial"
    assert do("commit", 10, cursor=7)["cursor"] == 7
    assert do("commit", 10, generation=2)["status"] == "HeldByOther"
    assert do("assign", 20, generation=0)["status"] == "HeldByOther"
    assert do("assign", 20, generation=3)["transition"] == "Retained"
    assert do("assign", 119, "b", 3)["status"] == "HeldByOther"
    assert do("assign", 120, "b", 3) == {"status": "Ok", "transition": "ExpiryTakeover", "owner": "b", "generation": 3, "expiry_ms": 220, "cursor": 7}
    assert do("release", 130, "b", 3)["status"] == "Ok"
    assert do("assign", 130, "c", 4)["transition"] == "GracefulHandoff"
    assert do("heartbeat", 140, "c", 4, 9)["cursor"] == 9


def test_planner_lease():
    s = lease.PlannerLease()
    do = lambda cmd, now, who="a", session="1", planner="a": s.apply(cmd, now, who, session, 100, planner)
    assert do("publish", 0)["status"] == "Rejected"
    assert do("acquire", 0)["status"] == "Ok"
    assert do("acquire", 10, "a", "2")["status"] == "HeldByOther"
    assert do("publish", 20)["version"] == 1
    assert do("publish", 20, planner="b")["status"] == "Rejected"
    assert do("publish", 100)["status"] == "Rejected"


def test_reservations_never_overlap(spark):
    rows = spark.createDataFrame([("t", v, k, (k * 7) % 5) for v in (0, 1) for k in range(30)], "topic string, vp int, arrival long, size long")
    got = log.hilo_reservations(rows).where("accepted").orderBy("vp", "arrival").collect()
    last = {}
    for r in got:
        assert r.block_start == last.get(r.vp, -1) + 1 and r.block_end == r.block_start + r.size - 1
        last[r.vp] = r.block_end


def test_balanced():
    parts = [("t", k) for k in range(23)]
    plan = placement.balanced(parts, ["c", "a", "b", "a"])
    loads = [sum(o == n for o in plan.values()) for n in "abc"]
    assert max(loads) - min(loads) <= 1
    assert plan == placement.balanced(parts[::-1], ["a", "b", "c"])
    assert placement.balanced(parts, []) == {}
    assert placement.distinct_nodes([("b", "2"), ("a", "9"), ("a", "1")]) == [("a", "1"), ("b", "2")]
    assert placement.inventory([("t", 4)], 2) == [("t", 8), ("t", 9), ("t", 10), ("t", 11)]


def test_sticky_and_repair():
    rng = random.Random(4)
    for _ in range(60):
        n, logical, m = rng.randint(1, 60), rng.randint(1, 12), rng.randint(1, 7)
        owners = [f"m{k}" for k in range(m)]
        before = {v: f"m{rng.randint(0, 8)}" for v in range(n) if rng.random() < 0.8}
        plan = placement.sticky(list(range(n)), logical, owners, before)
        loads = [sum(o == x for o in plan.values()) for x in owners]
        assert set(plan) == set(range(n)) and max(loads) - min(loads) <= 1
        assert placement.sticky(list(range(n)), logical, owners[::-1], plan) == plan
        for percent in (0, 10, 100):
            better = placement.repair(plan, logical, percent)
            moved = sum(better[v] != plan[v] for v in plan)
            assert moved <= (0 if percent == 0 else min(n, max(2, n * percent // 100)))
            assert placement.quality(better, logical) <= placement.quality(plan, logical)
            assert sorted(better.values()) == sorted(plan.values())
    assert placement.sticky([1], 1, [], {}) == {}


def test_pod_aware():
    members = {"a1": "a", "a2": "a", "b1": "b", "b2": "b"}
    plan = placement.pod_aware(list(range(16)), 4, members, {})
    assert sorted(sum(o == m for o in plan.values()) for m in members) == [4, 4, 4, 4]
    assert placement.pod_aware(list(range(16)), 4, members, plan) == plan
    assert placement.pod_aware([0, 1], 2, {"x": None, "y": "p"}, {}) == placement.sticky([0, 1], 2, ["x", "y"], {})


def test_cost(spark):
    got = {r.scenario: r for r in cost(parameters(spark, {"strong": {}, "size": {"flush_max_delay_s": 1e9}})).collect()}
    assert got["strong"].segments == 57600 and round(got["strong"].total_cost, 4) == 0.5383
    assert round(got["size"].segments) == 104
    assert parse_override("n_cons=3") == ("n_cons", 3.0) and parse_override("metadata_eventual_reads=true")[1] == 1.0
    with pytest.raises(ValueError):
        parse_override("nothing=1")
    assert len(DEFAULTS) == 41


def test_codec_errors(spark):
    data = codec.encode_batch(3, 10, [(1, b"x"), (2, b"")])
    assert codec.decode_batch(data, 3, 2) == (10, [(1, b"x"), (2, b"")])
    for vp, n in ((4, 2), (3, 1)):
        with pytest.raises(ValueError):
            codec.decode_batch(data, vp, n)


def test_append_status_order(spark):
    rows = [(None, None, 1, 1, True, False, True), (4, 2, 8, 0, True, False, True), (4, 2, 7, 0, True, False, True), (4, 2, 7, 1, True, False, True), (4, 2, 7, 1, False, False, False), (4, 2, 7, 1, False, True, True), (4, 2, 7, 1, False, True, False)]
    df = spark.createDataFrame(rows, "partition_count int, num_writers int, vp int, record_count int, overloaded boolean, assigned boolean, draining boolean")
    assert [r.status for r in log.append_status(df).collect()] == ["UNKNOWN_TOPIC", "BAD_REQUEST", "BAD_REQUEST", "OVERLOADED", "NOT_LEASE_HOLDER", "NOT_LEASE_HOLDER", "OK"]


def test_stress_counts_ids(spark):
    want = spark.createDataFrame([(0, k) for k in range(5)], "producer int, sequence long")
    seen = spark.createDataFrame([("r", 0, 0), ("r", 0, 1), ("r", 0, 1), ("r", 0, 9), ("x", 0, 2)], "run string, producer int, sequence long")
    r = inspect.stress_validation(want, seen, "r").first()
    assert (r.expected, r.unique_seen, r.duplicates, r.missing, r.unexpected, r.other_runs) == (5, 2, 1, 3, 1, 1)


def test_reader_any_order():
    rng = random.Random(6)
    batches = [(w, w * 10, w * 10 + 9) for w in range(20)]
    for _ in range(50):
        r, out, order = Reader(10**6, -1), [], batches[:]
        rng.shuffle(order)
        for k in range(0, 20, 3):
            out += r.take(order[k : k + 3], 0)
        assert [(s, e, g) for _, s, e, g in out] == [(w * 10, w * 10 + 9, 0) for w in range(20)]
    r = Reader(5, 4)
    assert r.take([(100, 0, 6), (100, 9, 9)], 101) == [(100, 5, 6, 0)] and r.held == [(100, 9, 9)]
    assert r.take([], 105) == [(100, 9, 9, 2)]


def test_reader_batch_form(spark):
    rows = [("t", 0, w, w * 10, w * 10 + 9) for w in (0, 2, 1)] + [("t", 1, 5, 3, 4)]
    df = spark.createDataFrame(rows, "topic string, vp int, window_start long, seq_start long, seq_end long")
    got = read_batch(df, 10, 100, -1).orderBy("vp", "deliver_from").collect()
    assert [(r.vp, r.deliver_from, r.seq_end, r.gap) for r in got] == [(0, 0, 9, 0), (0, 10, 19, 0), (0, 20, 29, 0), (1, 3, 4, 3)]


def test_store(spark, tmp_path):
    from tidemark.sources import store

    rows = [("t", v, w, w // 300 * 4 + k, k, f"{v}-{w}-{k}".encode()) for v in (0, 1) for w in (0, 300, 600) for k in range(4)]
    records = spark.createDataFrame(rows, "topic string, vp int, window_start long, offset long, event_ts_ms long, payload binary")
    store.publish(records.where("window_start < 600 or vp = 0"), str(tmp_path), 1)
    store.publish(records.where("window_start = 600 and vp = 1"), str(tmp_path), 2)  # another write to the same window
    store.publish(records.where("window_start = 600 and vp = 1"), str(tmp_path), 2)  # and its retry
    found = store.load_index(spark, str(tmp_path), "t", [300, 600], 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThanOrEqual(snowflake_id,1)" in plan
    assert sorted((r.vp, r.window_start, r.seq_start, r.seq_end) for r in found.collect()) == [(v, w, w // 300 * 4, w // 300 * 4 + 3) for v in (0, 1) for w in (300, 600)]
    back = store.read(spark, str(tmp_path), found)
    assert sorted((r.vp, r.offset, bytes(r.payload)) for r in back.collect()) == sorted((r[1], r[3], r[5]) for r in rows if r[2])
    assert scan.lost(found.withColumn("blob_key", F.concat("blob_key", F.lit("x"))), store.load_blobs(spark, str(tmp_path))).count() == 4
    whole = spark.read.parquet(str(tmp_path / "index"))
    assert whole.count() == 6 and whole.where("window_start = 600").select("snowflake_id", "blob_key").distinct().count() == 2
    store.publish(records, str(tmp_path / "small"), 3, most_bytes=100)  # a partition's four records have more than half of that
    assert store.load_blobs(spark, str(tmp_path / "small")).select("blob_key").distinct().count() == 6
    everything = store.load_index(spark, str(tmp_path / "small"), "t", [0, 300, 600])
    assert store.read(spark, str(tmp_path / "small"), everything).count() == len(rows)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_bytes(b"12345")
    (tmp_path / "raw" / "b.bin").write_bytes(b"123456")
    assert [bytes(r.content) for r in store.whole_objects(spark, str(tmp_path / "raw"), 5).collect()] == [b"12345"]
