import hashlib
import json
import random
import time

import pytest
from helpers import T0, at, events, moment
from pyspark.sql import functions as F
from test_ingest import ID, envelope

from trailmark.operators import governance, ingest, insights, replay, signals
from trailmark.operators import tables as ops
from trailmark.sources.daytable import DayTable
from trailmark.sources.erasure import REQUEST, Store, run_erasure
from trailmark.sources.snapshots import Snapshot


def test_redelivery_collapses_whatever_the_order(spark):
    rows = [("s", f"{i}", i, "CLICK", {"received": i}) for i in range(20)]
    again = [(s, e, ms, k, {"received": 500, "url": "later"}) for s, e, ms, k, _ in rows[::3]]
    wanted = {(f"{i}", "later" if i % 3 == 0 else "") for i in range(20)}
    for seed in range(3):
        mixed = rows + again + again
        random.Random(seed).shuffle(mixed)
        got = ops.dedup_latest(ops.union_deliveries(events(spark, mixed[:15]), events(spark, mixed[15:])))
        assert got.columns == events(spark, mixed).columns
        assert {(r["event_id"], r["url"]) for r in got.collect()} == wanted and got.count() == 20


def test_tenants_read_their_own(spark):
    rows = events(spark, [("s", "1", 0, "CLICK"), ("s", "2", 1, "CLICK", {"tenant": "t2"})])
    assert [r["event_id"] for r in ops.session_events(rows, "t1", "s").collect()] == ["1"]
    assert [r["event_id"] for r in ops.session_events(rows, "t2", "s").collect()] == ["2"]
    assert ops.for_tenant(rows, None).count() == 0


def records(spark, *triples):
    rows = [("log", p, o, at(t)) for p, o, t in triples]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp timestamp")


def token(spark, *triples):
    return ops.batch_token(records(spark, *triples)).first()["token"]


def test_tokens(spark):
    """The order of the records does not matter; any other record in the place of one does."""
    draw = random.Random(3)
    rows = [(part, offset, 100 * part + offset) for part in range(3) for offset in range(20, 26) if offset != 23]
    same = token(spark, *rows)
    draw.shuffle(rows)
    assert token(spark, *rows) == same and same.startswith("log:") and len(same) == 36
    first = min(rows)
    changed = [rows[:-1], [*rows, (1, 23, 123)], [(first[0], first[1], 0) if r == first else r for r in rows], [(p + 1, o, t) for p, o, t in rows]]
    assert len({token(spark, *other) for other in changed} | {same}) == 5


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_runs_across_blocks(spark, width):
    offsets = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 40]
    runs = ops.offset_runs(records(spark, *[(0, o, o) for o in offsets + offsets[:4]]), width=width)
    got = sorted((r["first_offset"], r["last_offset"], r["first_timestamp"]) for r in runs.collect())
    assert got == [(0, 10, at(0)), (13, 14, at(13)), (20, 30, at(20)), (40, 40, at(40))]


def test_retention(spark):
    day = 86_400_000
    rows = ops.events_layout(events(spark, [("s", "old", -31 * day, "CLICK"), ("s", "edge", -30 * day, "CLICK"), ("s", "new", 0, "CLICK")]))
    assert {r["event_id"] for r in ops.expire(rows, "ts", 30, moment(T0), "event_date").collect()} == {"edge", "new"}
    tenants = spark.createDataFrame([("t1", 1)], "id string, event_retention_days int")
    left = ops.expire_by_tenant(rows, tenants, "ts", "event_retention_days", moment(T0))
    assert {r["event_id"] for r in left.collect()} == {"new"}


def test_lags(spark):
    rows = events(spark, [("s", f"{i}", i * 100, "CLICK", {"received": i * 100 + i}) for i in range(1, 101)])
    row = ops.lag_report(rows).first()
    assert (row["n"], row["p50_ms"], row["p95_ms"], row["max_ms"]) == (100, 50, 95, 100)


def test_profile_counts_copies(spark):
    rows = [("s", "1", 0, "CLICK"), ("s", "1", 0, "CLICK"), ("s", "2", 0, "CUSTOM")]
    row = ops.session_profile(events(spark, rows)).first()
    assert (row["n_rows"], row["duplicates"], row["click"], row["custom"], row["input"]) == (3, 1, 2, 1, 0)


def chunks(spark, *rows):
    return spark.createDataFrame(
        [("t", "s", session, seq, text, at(T0)) for session, seq, text in rows],
        "tenant_id string, site_id string, session_id string, chunk_seq int, events string, ingested_at timestamp",
    )


FULL = '[{"type":3,"timestamp":1700},{"type":2,"timestamp":1200},{"type":3,"timestamp":2400}]'


def test_manifest(spark):
    made = replay.chunk_manifest(chunks(spark, ("a", 7, FULL), ("a", 8, '[{"type":3,"timestamp":5}]'))).orderBy("chunk_seq").collect()
    row = made[0]
    assert row["object_key"] == "tenants/t/sessions/a/000007.json.zst"
    assert (row["event_count"], row["first_ts"], row["last_ts"], row["has_full_snapshot"]) == (3, at(1200), at(2400), True)
    assert row["payload_bytes"] == len(FULL) and made[1]["has_full_snapshot"] is False


def test_gaps(spark):
    seqs = [("a", 0), ("a", 1), ("a", 4), ("b", 2), ("c", 0)]
    made = replay.chunk_manifest(chunks(spark, *[(s, n, FULL) for s, n in seqs], ("a", 4, FULL)))
    got = {(r["session_id"], r["missing_from"], r["missing_to"]) for r in replay.chunk_gaps(made).collect()}
    assert got == {("a", 2, 3), ("b", 0, 1)}


def sequential_cut(rows, max_bytes):
    """Plain sequential cutting of one session."""
    sealed, size, out = True, 0, []
    for _, seq, kind, text in sorted(rows):
        if sealed or kind == 4:
            out.append([])
            size, sealed = 0, False
        out[-1].append(seq)
        size += len(text)
        sealed = size >= max_bytes
    return [(c[0], c[-1], len(c)) for c in out]


@pytest.mark.parametrize("width", [2_000, 3_600_000])
def test_rechunk_equals_sequential_cutting(spark, width):
    rng = random.Random(3)
    sessions = {}
    for number in range(100):
        n = 600 if number == 0 else rng.randrange(1, 40)
        times = sorted(rng.randrange(0, 20_000) for _ in range(n))
        metas = 0 if number == 1 else 0.05
        sizes = rng.choice([(0, 90), (1, 20), (150, 700), (0, 2)])
        sessions[f"s{number}"] = [(t, i, 4 if rng.random() < metas else 3, "x" * rng.randint(*sizes)) for i, t in enumerate(times)]
    rows = [("t", s, at(t), q, k, e) for s, items in sessions.items() for t, q, k, e in items]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tenant_id string, session_id string, ts timestamp, seq bigint, type int, event string")
    made = replay.rechunk_replay(df, 200, width)
    got = made.toPandas()
    for name, items in sessions.items():
        mine = got[got["session_id"] == name].sort_values("chunk_seq")
        assert list(mine["chunk_seq"]) == list(range(len(mine)))
        assert list(zip(mine["first_seq"], mine["last_seq"], mine["event_count"])) == sequential_cut(items, 200), name
        assert sum(mine["bytes"]) == sum(len(text) for *_, text in items)
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
    assert replay.rechunk_replay(df.limit(0), 200, width).count() == 0


def ticked_cut(rows, max_bytes, flush_ms):
    """Plain sequential cutting of one session with flush ticks; an event without text has no size."""
    sealed, size, tick, out = True, 0, None, []
    for ts, seq, kind, text in sorted(rows, key=lambda row: row[:2]):
        if sealed or kind == 4 or ts // flush_ms != tick:
            out.append([])
            size, sealed = 0, False
        tick = ts // flush_ms
        out[-1].append(seq)
        size += len(text or "")
        sealed = size >= max_bytes
    return [(c[0], c[-1], len(c)) for c in out]


REPLAY_DDL = "tenant_id string, session_id string, ts timestamp, seq bigint, type int, event string"


@pytest.mark.parametrize("width", [2_000, 3_600_000])
def test_rechunk_cuts_at_flush_ticks(spark, width):
    rng = random.Random(5)
    sessions = {}
    for number in range(40):
        times = sorted(rng.randrange(0, 20_000) for _ in range(400 if number == 0 else rng.randrange(1, 40)))
        metas = 0 if number < 10 else 0.05
        sizes = rng.choice([(0, 90), (1, 20), (150, 700), (0, 2)])
        texts = ["x" * rng.randint(*sizes) if rng.random() < 0.9 else None for _ in times]
        sessions[f"s{number}"] = [(t, i, 4 if rng.random() < metas else 3, e) for i, (t, e) in enumerate(zip(times, texts))]
    rows = [("t", s, at(t), q, k, e) for s, items in sessions.items() for t, q, k, e in items]
    rng.shuffle(rows)
    got = replay.rechunk_replay(spark.createDataFrame(rows, REPLAY_DDL), 200, width, flush_ms=5_000).toPandas()
    for name, items in sessions.items():
        mine = got[got["session_id"] == name].sort_values("chunk_seq")
        assert list(mine["chunk_seq"]) == list(range(len(mine)))
        wanted = ticked_cut([(T0 + t, *rest) for t, *rest in items], 200, 5_000)
        assert list(zip(mine["first_seq"], mine["last_seq"], mine["event_count"])) == wanted, name


def test_rechunk_counts_repeated_events_as_often_as_they_come(spark):
    events = [(0, 4, "a" * 30), (1_000, 3, "b" * 90), (2_000, 3, "c" * 20), (5_000, 3, "d" * 10), (6_000, 3, "")]
    rows = [("t", "s", at(ms), n, kind, text) for n, (ms, kind, text) in enumerate(events)] * 2
    got = replay.rechunk_replay(spark.createDataFrame(rows, REPLAY_DDL), 100, flush_ms=5_000).orderBy("chunk_seq").collect()
    assert [(r["chunk_seq"], r["first_seq"], r["last_seq"], r["event_count"], r["bytes"]) for r in got] == [
        (0, 0, 0, 1, 30), (1, 0, 1, 2, 120), (2, 1, 2, 2, 110), (3, 2, 2, 1, 20), (4, 3, 4, 4, 20)
    ]


def test_rechunk_query_flushes_every_five_seconds(spark, tmp_path):
    import duckdb

    from trailmark.plans import load

    runs, sql = load()
    turns = [(c, t, "user", "x" * (40 * t + c)) for c in range(6) for t in range(20)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(path)
    got = runs["rechunk_replay"](spark, str(tmp_path))
    # Turns 6 and 7 of the first conversation lie before the tick at 5 s, turn 8 behind it: one run of Meta, two chunks.
    first = got.filter("session_id = '0' AND first_seq BETWEEN 6 AND 8").orderBy("chunk_seq").collect()
    assert [(r["first_seq"], r["last_seq"], r["starts_with_snapshot"]) for r in first] == [(6, 7, True), (8, 8, False)]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        wanted = db.sql(sql["rechunk_replay"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


def plain_bucket(times, burst, refill, period_ms):
    """A token bucket, request by request: refused requests and all requests by period."""
    level, last, out = burst, None, {}
    for ms in sorted(times):
        step = ms * refill // period_ms
        level = burst if last is None else min(burst, level + step - last)
        last = step
        line = out.setdefault(ms // period_ms * period_ms, [0, 0])
        line[0] += 1
        if level:
            level -= 1
        else:
            line[1] += 1
    return {start: tuple(line) for start, line in out.items() if line[1]}


@pytest.mark.parametrize("burst, refill, period_ms", [(100, 50, 1000), (3, 2, 1000), (40, 7, 777)])
def test_rate_audit_equals_a_bucket(spark, burst, refill, period_ms, monkeypatch):
    monkeypatch.setattr(ingest, "PERIODS", 8)
    rng = random.Random(burst)
    keys = {"hot": [T0 + int(rng.expovariate(1 / 50_000)) for _ in range(6000)], "one": [T0], "calm": [T0 + i * 10 * period_ms for i in range(40)]}
    for number in range(5):
        start, bursts = T0 + rng.randrange(10**6), [rng.randrange(10**6) for _ in range(6)]
        keys[f"k{number}"] = [start + rng.choice(bursts) + int(rng.gauss(0, 400)) for _ in range(rng.randrange(1, 900))]
    rows = [(key, at(ms)) for key, times in keys.items() for ms in times]
    rng.shuffle(rows)
    got = ingest.rate_audit(spark.createDataFrame(rows, "key_hash string, ts timestamp"), burst, refill, period_ms).collect()
    want = {(key, start, *line) for key, times in keys.items() for start, line in plain_bucket(times, burst, refill, period_ms).items()}
    assert {(r["key_hash"], r["window_start_ms"], r["n"], r["refused"]) for r in got} == want
    assert len(got) == len(want) and all(r["accepted"] + r["refused"] == r["n"] for r in got) and "hot" in {r["key_hash"] for r in got}


def leaks(spark, tables, secrets):
    found = governance.leak_scan(tables, spark.createDataFrame(secrets, "name string, secret string")).collect()
    assert len(found) == len(tables) * len(secrets)
    return {(r["table"], r["secret"]): (r["rows_with_secret"], r["rows_masked"]) for r in found}


def test_leaks_are_counted_even_when_absent(spark):
    rows = spark.createDataFrame([("pin 4711 here", None), ("nothing", "4711"), ("****", "x 4711 4711")], "a string, b string")
    other = spark.createDataFrame([("*****", "correct horse"), (None, "correct hors"), ("", "incorrect horse!")], "c string, d string")
    secrets = [("pin", "4711"), ("no", "zzzzz"), ("words", "correct horse"), ("empty", ""), ("null", None), ("twin", "correct home")]
    got = leaks(spark, {"one": (rows, ["a", "b"]), "two": (other, ["c", "d"])}, secrets)
    assert got["one", "pin"] == (3, 1) and got["two", "pin"] == (0, 1) and got["two", "no"] == (0, 1)
    assert got["two", "words"] == (2, 0) and got["two", "twin"] == (0, 0)
    assert got["one", "empty"] == got["one", "null"] == got["two", "null"] == (0, 0)


def test_leaks_of_many_secrets(spark, monkeypatch):
    monkeypatch.setattr(governance, "ANCHORS", 4000)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh1234", k=rng.randrange(3, 20))) for _ in range(10_000)]
    texts = [" ".join(rng.choices("abcdefgh1234", k=30)).replace(" ", "") + rng.choice(["", "***", "*" * 12]) + rng.choice(words) for _ in range(60)]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    got = leaks(spark, {"t": (df, ["text"])}, [(f"n{i}", word) for i, word in enumerate(words)])
    for i, word in enumerate(words):
        assert got["t", f"n{i}"] == (sum(word in text for text in texts), sum("*" * len(word) in text for text in texts)), word


def test_leaks_next_to_each_other(spark):
    words = ["a.b", "a.bc", "a.bcdefg!", "bcdefg!?x", "^", "x\\y", "[z]-", "\U0001f511key", "ke", "\n\n*", "tail-", "tail-end-"]
    texts = ["a.bcdefg!?x", "aXbc a.b", "x\\y^[z]-", "é\U0001f511key", "\n\n***\n", "key tail-en", "", None, "tail-end-a.b"]
    got = leaks(spark, {"t": (spark.createDataFrame([(t,) for t in texts], "text string"), ["text"])}, [(w, w) for w in words])
    for word in words:
        assert got["t", word][0] == sum(word in (text or "") for text in texts), word


def test_leaks_in_a_long_text(spark):
    """The time grows with the length of a text, not with its square."""
    text = "no sécret is in here " * 50_000
    df = spark.createDataFrame([(text + "but this: hunter-two-",), (text,)], "text string")
    begun = time.monotonic()
    got = leaks(spark, {"t": (df, ["text"])}, [("own", "hunter-two-"), ("other", "hunter-ten-"), ("short", "-")])
    assert (got["t", "own"], got["t", "other"], got["t", "short"]) == ((1, 0), (0, 0), (1, 0))
    assert time.monotonic() - begun < 60


def test_sampling_extremes(spark):
    rows = events(spark, [(f"s{i}", f"{i}", 0, "CLICK") for i in range(200)] * 2)
    for rate, low, high in ((0.0, 0, 0), (1.0, 400, 400), (0.5, 120, 280)):
        kept = governance.sample_sessions(rows, spark.createDataFrame([("s1", rate)], "id string, sampling_rate double"))
        counts = kept.groupBy("session_id").count().toPandas()
        assert low <= counts["count"].sum() <= high and (counts["count"] == 2).all()


def test_erasure_leaves_nothing(spark):
    table = spark.createDataFrame(
        [("a", "t", "u1"), ("b", "t", "u1"), ("c", "t", "u2"), ("a2", "t2", "u1")], "id string, tenant_id string, end_user_id string"
    )
    rows = spark.createDataFrame([("t", s) for s in "aabc"] + [("t2", "a2")], "tenant_id string, session_id string")
    users = spark.createDataFrame([("t", "u1"), ("t", "u2"), ("t2", "u1")], "tenant_id string, id string")
    requests = spark.createDataFrame(
        [("t", "END_USER", "u1", "PENDING"), ("t", "SESSION", "c", "COMPLETED")],
        "tenant_id string, subject_type string, subject_id string, status string",
    ).withColumn("progress", F.lit(None).cast("map<string,string>"))
    kept, progress = governance.erase({"sessions": table, "events": rows, "end_users": users}, requests)
    assert {r["id"] for r in kept["sessions"].collect()} == {"c", "a2"}
    assert {r["session_id"] for r in kept["events"].collect()} == {"c", "a2"}
    assert {(r["tenant_id"], r["id"]) for r in kept["end_users"].collect()} == {("t", "u2"), ("t2", "u1")}
    assert {r["table"]: r["erased"] for r in progress.collect()} == {"sessions": 2, "events": 3, "end_users": 1}


@pytest.fixture
def erasable(spark, tmp_path):
    """Sessions on forty days, three events each, visitors, and requests; and what is to be left of them."""
    day, users = 86_400_000, 20
    rows = [(f"s{i}", "t", f"u{i % users}", at(T0 + i * day), at(T0 + i * day), None) for i in range(40)] + [("s3", "t2", "u3", at(T0), at(T0), None)]
    sessions = spark.createDataFrame(rows, "id string, tenant_id string, end_user_id string, started_at timestamp, last_active_at timestamp, ended_at timestamp")
    events_ = [(tenant, name, f"{name}-{n}", at(T0 + i * day + n)) for i, (name, tenant, *_) in enumerate(rows[:40]) for n in range(3)]
    events_ = spark.createDataFrame(events_ + [("t2", "s3", "x", at(T0))], "tenant_id string, session_id string, event_id string, ts timestamp")
    visitors = spark.createDataFrame([("t", f"u{i}", at(T0)) for i in range(users)] + [("t2", "u3", at(T0))], "tenant_id string, id string, seen timestamp")

    def stored(df, name, bounds):
        table = DayTable(spark, str(tmp_path / name), df.schema, bounds)
        table.write(df, F.to_date(bounds).cast("string"), [], 0, -1)
        return table

    stores = {
        "events": Store(stored(events_, "events", "ts"), "session_id", dated=True),
        "end_users": Store(stored(visitors, "end_users", "seen"), "id", "END_USER"),
        "sessions": Store(stored(sessions, "sessions", "started_at"), "id", dated=True),
    }
    asked = [("1", "t", "END_USER", "u3", "PENDING", None, {}), ("2", "t", "SESSION", "s10", "PENDING", None, {}), ("3", "t", "SESSION", "s5", "COMPLETED", None, {}), ("4", "t", "SESSION", "none", "PENDING", None, {})]
    requests = str(tmp_path / "requests")
    Snapshot(spark, requests, REQUEST).write(spark.createDataFrame(asked, REQUEST), 0)
    gone = {f"s{i}" for i in range(3, 40, 20)} | {"s10"}
    left = {
        "sessions": {("t", name) for name, tenant, *_ in rows if tenant == "t" and name not in gone} | {("t2", "s3")},
        "end_users": {("t", f"u{i}") for i in range(users) if i != 3} | {("t2", "u3")},
    }
    return requests, stores, left, gone


def check_erased(spark, requests, stores, left, gone):
    for name, want in left.items():
        assert {(r["tenant_id"], r["id"]) for r in stores[name].table.read().collect()} == want
    kept = {(r["tenant_id"], r["session_id"]) for r in stores["events"].table.read().collect()}
    assert kept == left["sessions"]
    done = {r["id"]: (r["status"], sorted(r["progress"])) for r in Snapshot(spark, requests, REQUEST).read().collect()}
    assert done == {"1": ("COMPLETED", sorted(stores)), "2": ("COMPLETED", sorted(stores)), "3": ("COMPLETED", []), "4": ("COMPLETED", sorted(stores))}
    # Nothing of it is left in old folders either.
    raw = spark.read.parquet(*[f"{stores['events'].table.path}/data/{n}" for n in stores["events"].table._names("data")])
    assert not raw.filter(F.col("session_id").isin(*gone) & (F.col("tenant_id") == "t")).count()


def test_erasure_job(spark, erasable):
    requests, stores, left, gone = erasable
    events_ = stores["events"].table
    before = {(e["part"], e["folder"]) for e in events_.entries()}
    run_erasure(spark, requests, stores, moment(T0))
    check_erased(spark, requests, stores, left, gone)
    changed = before - {(e["part"], e["folder"]) for e in events_.entries()}
    assert len(changed) == 3 and len(before) == 40
    version = events_.version()
    run_erasure(spark, requests, stores, moment(T0))
    assert events_.version() == version


@pytest.mark.parametrize("dies_at", [1, 3, 4, 6])
def test_erasure_is_resumed(spark, erasable, monkeypatch, dies_at):
    requests, stores, left, gone = erasable
    real, calls = Snapshot.write, []

    def write(self, df, version):
        calls.append(self.path)
        if len(calls) == dies_at:
            raise OSError("lost")
        real(self, df, version)
        statuses = {r["status"] for r in Snapshot(spark, requests, REQUEST).read().filter("id IN ('1', '2', '4')").collect()}
        assert "COMPLETED" not in statuses or all(r["id"] != "s10" for r in stores["sessions"].table.read().collect())

    with monkeypatch.context() as patch:
        patch.setattr(Snapshot, "write", write)
        with pytest.raises(OSError):
            run_erasure(spark, requests, stores, moment(T0))
    run_erasure(spark, requests, stores, moment(T0))
    check_erased(spark, requests, stores, left, gone)


def test_transitions(spark):
    steps = [("PENDING", "PROCESSING"), ("PROCESSING", "FAILED"), ("FAILED", "PROCESSING"), ("FAILED", "PROCESSING"), ("PENDING", "AI_ANALYZED")]
    rows = [("t", "s", i, a, b, at(T0 + i * 3_000_000)) for i, (a, b) in enumerate(steps)]
    df = spark.createDataFrame(rows, "tenant_id string, session_id string, id int, from_status string, to_status string, created_at timestamp")
    assert {(r["id"], r["fault"]) for r in governance.illegal_transitions(df).collect()} == {(3, "broken_chain"), (4, "illegal")}


def test_traits(spark):
    df = spark.createDataFrame([({"email": "kim@mail.example", "note": "ask kim@mail.example"},)], "traits map<string,string>")
    traits = governance.redact_traits(df).first()["traits"]
    assert traits["note"] == "ask [email]" and len(traits["email"]) == 64


def click(event_id, ms, selector="b", session="s"):
    return (session, event_id, ms, "CLICK", {"selector": selector, "path": "/p"})


def test_signals_at_their_borders(spark):
    rows = [click("1", 0), click("2", 500), click("3", 1000), click("4", 1001), click("5", 1002, "other")]
    assert {r["event_id"] for r in signals.rage_clicks(events(spark, rows)).collect()} == {"3", "4"}
    rows = [click("1", 0), ("s", "e", 1000, "EXCEPTION"), click("2", 1001), ("s", "n", 2001, "NAVIGATION")]
    made = events(spark, rows)
    assert {r["event_id"] for r in signals.error_clicks(made).collect()} == {"1"}
    assert {r["event_id"] for r in signals.dead_clicks(made).collect()} == {"1"}
    rows = [("s", f"{i}", i * 2500, "EXCEPTION") for i in range(6)]
    assert {r["event_id"] for r in signals.error_bursts(events(spark, rows)).collect()} == {"4", "5"}


def test_scores_and_gate(spark):
    rows = [click(f"{i}", i * 100) for i in range(6)] + [("calm", "c", 0, "INPUT")]
    counts = signals.signal_counts(events(spark, rows))
    scores = {r["session_id"]: r["friction_score"] for r in signals.friction_scores(counts).collect()}
    assert scores == {"s": 100, "calm": 0}


def test_marks_are_what_the_single_signals_find(spark):
    draw = random.Random(9)
    kinds = ["CLICK", "CLICK", "NAVIGATION", "EXCEPTION", "CONSOLE_ERROR", "MUTATION", "INPUT"]
    rows = [(draw.choice("abc"), f"{i}", draw.randrange(60_000), draw.choice(kinds), {"selector": draw.choice(["x", "y", ""])}) for i in range(500)]
    made = events(spark, rows)
    for width in (2_000, 3_600_000):
        marked = signals.mark_signals(made, 3, 1000, 4, 5000, width, 2000)
        assert marked.count() == 500
        single = {
            "rage_click": signals.rage_clicks(made, 3, 2000, width),
            "dead_click": signals.dead_clicks(made, 1000, width),
            "error_click": signals.error_clicks(made, 1000, width),
            "error_burst": signals.error_bursts(made, 4, 5000, width),
        }
        for name, found in single.items():
            got = {r["event_id"] for r in marked.filter(name).collect()}
            assert got == {r["event_id"] for r in found.collect()} and got, name


@pytest.mark.parametrize("share, threshold", [(0.05, 10), (0.5, 10), (0.6, 100), (0.3, 101), (1.0, 0)])
def test_gate_passes_the_highest_scores(spark, share, threshold):
    rows = [(f"t{i % 3}", f"s{i}", min(100, 2 * i)) for i in range(200)]
    scores = spark.createDataFrame(rows, "tenant_id string, session_id string, friction_score int")
    got = {r["session_id"] for r in signals.gate_sessions(scores, threshold, share).collect()}
    order = sorted(rows, key=lambda r: (-r[2], hashlib.md5(f"{r[0]}/{r[1]}".encode()).hexdigest()))
    assert got == {r[1] for r in order[: int(200 * share)] if r[2] >= threshold}


def test_stuck_page(spark):
    rows = [("s", "n1", 0, "NAVIGATION", {"path": "/p", "url": "p"}), ("s", "n2", 90_000, "NAVIGATION", {"path": "/q", "url": "q"})]
    rows += [click(f"{i}", i * 1000) for i in range(4)]
    found = signals.stuck_pages(events(spark, rows), 60_000, 3).collect()
    assert [(r["path"], r["stay_ms"], r["repeats"]) for r in found] == [("/p", 90_000, 4)]


def test_nearest(spark):
    draw = random.Random(12)
    vectors = {f"v{i}": [draw.uniform(-1, 1) for _ in range(5)] for i in range(30)}
    rows = [(name, "t" if i % 3 else "other", vector) for i, (name, vector) in enumerate(vectors.items())] + [("none", "t", None)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, embedding array<double>")
    asked = [draw.uniform(-1, 1) for _ in range(5)]

    def cosine(name):
        v = vectors[name]
        return sum(a * b for a, b in zip(v, asked)) / sum(a * a for a in v) ** 0.5

    own = [name for i, name in enumerate(vectors) if i % 3]
    assert [r["id"] for r in insights.nearest_insights(df, asked, "t", 6).collect()] == sorted(own, key=cosine, reverse=True)[:6]


def test_funnel(spark):
    def step(session, event_id, ms, kind):
        return (session, event_id, ms, kind)

    rows = [step("a", "1", 0, "NAVIGATION"), step("a", "2", 10, "CLICK"), step("a", "3", 20, "CUSTOM")]
    rows += [step("b", "4", 10, "CLICK"), step("b", "5", 20, "NAVIGATION"), step("b", "6", 20, "CLICK")]
    rows += [step("c", "7", 0, "NAVIGATION"), step("c", "8", 5, "CLICK"), step("c", "9", 2000, "CUSTOM")]
    steps = [F.col("event_type") == kind for kind in ("NAVIGATION", "CLICK", "CUSTOM")]
    made = events(spark, rows)
    got = [(r["sessions"], r["conversion"], r["dropped"]) for r in insights.funnel(made, steps, 1000).collect()]
    assert got == [(3, 1.0, 1), (2, 0.666667, 1), (1, 0.5, 0)]
    progress = insights.funnel_progress(made, steps, 1000)
    assert {r["session_id"] for r in insights.funnel_dropoffs(progress, 2).collect()} == {"c"}


def test_alerts(spark):
    hour = 3_600_000
    rows = []
    for h, n in ((0, 2), (1, 2), (3, 6), (4, 2)):
        rows += [("s", f"{h}-{i}", h * hour - T0 % hour + i, "RAGE_CLICK", {"path": "/pay"}) for i in range(n)]
    alerts = insights.signal_alerts(events(spark, rows), hour, 3.0).collect()
    assert [(r["n"], round(r["baseline"], 3)) for r in alerts] == [(6, 1.333)]


def test_network_and_guardrails(spark):
    rows = spark.createDataFrame(
        [("1", "NETWORK", 500, 10), ("2", "NETWORK", 200, 5000), ("3", "NETWORK", 200, 10), ("4", "CLICK", None, None)],
        "event_id string, event_type string, http_status int, http_duration_ms bigint",
    )
    assert {(r["event_id"], r["issue"]) for r in insights.network_issues(rows, 1000).collect()} == {("1", "failed"), ("2", "slow")}
    sessions = spark.createDataFrame([(1, 3, "AI_ANALYZED"), (2, 0, "AI_ANALYZED")], "id int, rage int, analysis_status string")
    judged = insights.apply_guardrails(sessions, {"rage": F.col("rage") >= 3, "any": F.col("rage") >= 2}).collect()
    assert [(r["guardrail_rule"], r["analysis_status"]) for r in judged] == [("rage", "REVIEW_REQUIRED"), (None, "AI_ANALYZED")]


def plain_progress(rows, kinds, within):
    """Times of the steps of one session, step by step."""
    reached, last = [], None
    for kind in kinds:
        times = [ms for ms, own in rows if own == kind and (last is None or ms > last)]
        times = [ms for ms in times if within is None or not reached or ms <= reached[0] + within]
        if not times:
            break
        last = min(times)
        reached.append(last)
    return reached


@pytest.mark.parametrize("within, width", [(None, 700), (900, 700), (900, 3_600_000)])
def test_funnel_equals_going_step_by_step(spark, within, width):
    draw = random.Random(14)
    kinds = ["NAVIGATION", "CLICK", "CLICK", "CUSTOM"]
    rows = [(f"s{draw.randrange(60)}", f"{i}", draw.randrange(60) * 100, draw.choice(["NAVIGATION", "CLICK", "CUSTOM", "INPUT"])) for i in range(700)]
    progress = insights.funnel_progress(events(spark, rows), [F.col("event_type") == kind for kind in kinds], within, width)
    got = {r["session_id"]: [r[f"t{i}"] - T0 for i in range(1, 5) if r[f"t{i}"] is not None] for r in progress.collect()}
    want = {}
    for name in {row[0] for row in rows}:
        reached = plain_progress([(row[2], row[3]) for row in rows if row[0] == name], kinds, within)
        if reached:
            want[name] = reached
    assert got == want


def test_network_columns(spark):
    def call(props, kind="NETWORK"):
        return json.dumps({**json.loads(envelope()), "event": {"clientEventId": ID.format(4), "type": kind, "ts": T0, "props": props}})

    values = [
        call({"method": "GET", "url": "https://a.test/x?mail=me%40example.com", "status": 404, "durationMs": 12.7}),
        call({"status": 70000, "durationMs": -1, "url": "https://a.test/y"}),
        call({"method": "GET", "status": 500}, "CUSTOM"),
        call({"status": 200, "durationMs": 5000}),
    ]
    records = spark.createDataFrame([(value,) for value in values], "value string")
    good, _ = ingest.split_poison(ingest.classify_telemetry(ingest.decode_envelope(records, "telemetry")))
    rows = ingest.to_event_rows(good)
    got = [tuple(r) for r in rows.select("http_method", "http_url", "http_status", "http_duration_ms").collect()]
    assert got[0][0] == "GET" and "example" not in got[0][1] and got[0][2:] == (404, 12)
    assert got[1] == ("", "https://a.test/y", 0, 0) and got[2] == ("", "", 0, 0) and got[3] == ("", "", 200, 5000)
    assert [r["issue"] for r in insights.network_issues(rows, 800).collect()] == ["failed", "failed", "slow"]
