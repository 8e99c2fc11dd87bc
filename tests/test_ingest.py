import json
import random

import pytest
from helpers import T0, at
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.operators import ingest

ID = "0a1b2c3d-0000-7000-8000-00000000000{}"
RECEIVED = "2025-06-15T15:06:40.000Z"


def envelope(**changes):
    event = {"clientEventId": ID.format(4), "type": "CLICK", "ts": T0, "url": "https://web.test/a", "props": {"a": 1}}
    whole = {
        "schemaVersion": 1,
        "tenantId": ID.format(1),
        "siteId": ID.format(2),
        "sessionId": ID.format(3),
        "anonymousId": "who",
        "receivedAt": RECEIVED,
        "event": event,
    }
    for name, value in changes.items():
        target = event if name in {"clientEventId", "type", "ts", "props"} else whole
        if value is None:
            target.pop(name, None)
        else:
            target[name] = value
    return json.dumps(whole)


GOOD = envelope()


# What can be wrong, in the order in which it is told.
TELEMETRY_FAULTS = {
    "deserialization": [{"siteId": "17"}, {"ts": []}, {"receivedAt": "noon"}, {"schemaVersion": "one"}],
    "bad_type": [{"type": "GAZE"}, {"type": "custom"}, {"type": False}],
    "unsupported_schema_version": [{"schemaVersion": 0}, {"schemaVersion": None}],
    "missing_tenant": [{"tenantId": None}],
    "missing_site": [{"siteId": None}],
    "missing_session": [{"sessionId": None}],
    "missing_event_id": [{"clientEventId": None}],
    "missing_type": [{"type": None}],
    "missing_ts": [{"ts": None}, {"receivedAt": None}],
}


def reasons(spark, values, kind, classify):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    found = {r["i"]: r["reason"] for r in classify(ingest.decode_envelope(rows, kind)).collect()}
    return [found[i] for i in range(len(values))]


def test_telemetry_reasons(spark):
    """Each fault alone and with each later one: the first is told."""
    codes = list(TELEMETRY_FAULTS)
    wanted, values = [], []
    for place, code in enumerate(codes):
        for changes in TELEMETRY_FAULTS[code]:
            for other in [{}, *[fault for later in codes[place + 1 :] for fault in TELEMETRY_FAULTS[later]]]:
                if not changes.keys() & other.keys():
                    values.append(envelope(**changes, **other))
                    wanted.append(code)
    assert reasons(spark, values, "telemetry", ingest.classify_telemetry) == wanted


def test_telemetry_texts(spark):
    doubled = GOOD.replace('"a": 1', '"a": 1, "a": 2')
    broken = ["", None, "17", '"text"', f"[{GOOD}]", GOOD[:-1], GOOD[1:], GOOD + "0", GOOD + "\n" + GOOD]
    values = [GOOD, f"\t{GOOD}\n", envelope(more={"x": [1]}), doubled, *broken, envelope(event=None), envelope(event=None, siteId=None)]
    wanted = [None] * 3 + ["store_rejected"] + ["deserialization"] * len(broken) + ["missing_event", "missing_site"]
    assert reasons(spark, values, "telemetry", ingest.classify_telemetry) == wanted


def test_event_rows(spark):
    odd = envelope(props=[1], clientEventId=ID.format(4).upper())
    rows = spark.createDataFrame([(GOOD,), (odd,)], "value string")
    stored = ingest.to_event_rows(ingest.classify_telemetry(ingest.decode_envelope(rows, "telemetry"))).collect()
    assert {r["props"] for r in stored} == {'{"a":1}', "{}"}
    assert {r["event_id"] for r in stored} == {ID.format(4)}
    assert {(r["ts"], r["ingested_at"], r["event_name"], r["end_user_id"]) for r in stored} == {
        (at(T0), at(1_750_000_000_000), "", None)
    }


def chunk(**changes):
    whole = {
        "schemaVersion": 1,
        "tenantId": ID.format(1),
        "siteId": ID.format(2),
        "sessionId": ID.format(3),
        "chunkSeq": 0,
        "receivedAt": RECEIVED,
        "events": [{"type": 4, "timestamp": 1}, {"type": 2, "timestamp": 2.5}],
        **changes,
    }
    return json.dumps({k: v for k, v in whole.items() if v is not None})


def test_replay_reasons(spark):
    lists = [None, [], "text", {}, [1], [None], [{}], [{"timestamp": True}], [{"timestamp": 1}, {"timestamp": None}]]
    values = [chunk(events=events) for events in lists] + [chunk(chunkSeq=-7), chunk(payload="Zg==")]
    wanted = ["invalid_chunk"] * len(values)
    values += [chunk(), chunk(chunkSeq=None), chunk(events=[{"timestamp": 0.5}] * 3), chunk(events=None, payload="Zg=="), chunk()[:-2]]
    wanted += [None, None, None, "unsupported_payload", "deserialization"]
    values += [chunk(**{name: None, "events": []}) for name in ("schemaVersion", "tenantId", "siteId", "sessionId", "receivedAt")]
    wanted += ["unsupported_schema_version", "missing_tenant", "missing_site", "missing_session", "missing_ts"]
    assert reasons(spark, values, "replay", ingest.classify_replay) == wanted


def event(ts=T0, **changes):
    whole = {"clientEventId": ID.format(5), "type": "CLICK", "ts": ts, **changes}
    return {k: v for k, v in whole.items() if v is not None}


def bodies(spark, *texts):
    rows = [(i, t, at(T0), "t", "s", "curl/1.0") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "i int, body string, received_at timestamp, tenant_id string, site_id string, user_agent string"
    )


def body(*events, session=ID.format(3), **more):
    whole = {"sessionId": session, "events": list(events), **more}
    return json.dumps({k: v for k, v in whole.items() if v is not None})


def test_batch_rules(spark):
    """A fault in any place of a body, alone and in a body that is too large."""
    unbound = [{"clientEventId": "x"}, {"type": 7}, {"ts": "now"}]
    lacking = [{"clientEventId": None}, {"type": None}, {"ts": None}, {"props": "text"}]
    strange = event(type="GAZE", ts=None)
    texts, wanted = [], []

    def add(rejection, *events, **more):
        texts.append(body(*events, **more))
        wanted.append(rejection)

    for changes in unbound + lacking:
        add("invalid", event(**changes))
        add("invalid", event(), strange, event(**changes), event())
        add("invalid" if changes in unbound else "too_large", *[event()] * 500, event(**changes))
    for count, rejection in ((1, None), (500, None), (501, "too_large")):
        add(rejection, *[event()] * count)
        add(rejection, *[strange] * count)
        add(rejection, *[event(), strange] * (count // 2), *[event()] * (count % 2))
    for session in (None, "", "123"):
        add("invalid", event(), session=session)
        add("invalid", *[event()] * 501, session=session)
    add("invalid")
    judged = ingest.validate_batches(ingest.parse_batches(bodies(spark, *texts)))
    found = {r["i"]: r["rejection"] for r in judged.select("i", "rejection").collect()}
    assert [found[i] for i in range(len(texts))] == wanted


def test_window_and_unknown_types(spark):
    hour = 3_600_000
    text = body(
        event(T0),
        event(T0 - 24 * hour),
        event(T0 - 24 * hour - 1),
        event(T0 + 300_000),
        event(T0 + 300_001),
        event(type="GAZE"),
    )
    judged = ingest.validate_batches(ingest.parse_batches(bodies(spark, text, "{nope")))
    kept = ingest.within_time_window(ingest.drop_unknown_types(judged))
    report = {(r["outcome"], r["reason"]): r["n"] for r in ingest.ingest_report(kept).collect()}
    assert report == {
        ("accepted", ""): 3,
        ("dropped", "unknown_type"): 1,
        ("dropped", "ts_out_of_window"): 2,
        ("rejected", "invalid"): 1,
        ("rejected", "too_large"): 0,
    }


@pytest.mark.parametrize("name, limit", [("targetText", 1024), ("errorMessage", 2048), ("errorStack", 8192)])
def test_a_cut_leaves_no_half_address(spark, name, limit):
    """An address across the limit, at every place of it, is redacted as a whole and then cut."""
    address = "b.c@de.fgh"
    texts = [body(event(**{name: "-" * (limit - inside) + " " + address + " tail"})) for inside in range(len(address) + 2)]
    found = ingest.accept_batches(bodies(spark, *texts)).select(f"event.{name}").collect()
    assert len(found) == len(texts)
    assert {row[name] for row in found} == {("-" * (limit - inside) + " [email] tail")[:limit] for inside in range(len(address) + 2)}


def test_replay_bodies(spark):
    good = {"sessionId": ID.format(3), "chunkSeq": 4, "events": [{"type": 3}, {}]}
    changes = [{}, {"payload": "x"}, {"chunkSeq": 0}, {"events": None}, {"events": "[]"}, {"events": {}}, {"chunkSeq": None}, {"chunkSeq": -2}, {"sessionId": "3"}]
    texts = [json.dumps({k: v for k, v in {**good, **change}.items() if v is not None}) for change in changes]
    found = {r["i"]: r["rejection"] for r in ingest.replay_envelopes(bodies(spark, *texts)).collect()}
    # A text that begins like an array is one on the wire as well.
    assert [found[i] is None for i in range(len(texts))] == [True] * 3 + [False, True] + [False] * 4


def test_site_keys(spark):
    ddl = "id string, tenant_id string, allowed_origins array<string>, sampling_rate double, is_active boolean, deleted_at timestamp"
    site = spark.createDataFrame(
        [("s1", "t1", ["https://a.test"], 1.0, True, None), ("s2", "t1", [], 1.0, False, None), ("s3", "t2", [], 1.0, True, None)], ddl
    )
    tenant = spark.createDataFrame(
        [("t1", True, None), ("t2", True, at(T0))], "id string, is_active boolean, deleted_at timestamp"
    )
    keys = [("k1", "t1", "s1", None), ("k2", "t1", "s1", at(T0)), ("k3", "t1", "s2", None), ("k4", "t2", "s3", None), ("k5", "t2", "s1", None)]
    site_key = (
        spark.createDataFrame(keys, "key string, tenant_id string, site_id string, revoked_at timestamp")
        .withColumn("key_hash", F.sha2("key", 256))
        .withColumn("is_active", F.lit(True))
        .withColumn("deleted_at", F.lit(None).cast("timestamp"))
    )
    asked = [("k1", "https://a.test"), ("k1", "https://b.test"), ("k2", "x"), ("k3", "x"), ("k4", "x"), ("k5", "x"), ("k9", "x"), (" ", "x"), ("k" * 300, "x")]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, site_key string, origin string")
    judged = {r["i"]: r["rejection"] for r in ingest.authorize(requests, site_key, site, tenant).collect()}
    assert judged == {
        0: None,
        1: "origin_not_allowed",
        **{i: "unknown_key" for i in (2, 3, 4, 5, 6)},
        7: "missing_key",
        8: "unknown_key",
    }
    resolved = ingest.resolve_sites(requests, site_key, site, tenant)
    assert {(r["i"], r["tenant_id"], r["site_id"]) for r in resolved.collect()} == {(0, "t1", "s1"), (1, "t1", "s1")}


def test_references(spark):
    from helpers import events

    rows = events(
        spark,
        [
            ("a", "1", 0, "CLICK"),
            ("a", "2", 5, "CLICK", {"tenant": "t2"}),
            ("b", "3", 9, "NAVIGATION", {"url": "https://web.test/a\x00b"}),
            ("b", "6", 4, "CLICK"),
            ("e", "7", 0, "CLICK", {"url": "https://web.test/not\x00stored"}),
            ("c", "4", 0, "CLICK", {"tenant": "t9"}),
            ("d", "5", 0, "CLICK"),
        ],
    )
    sites = spark.createDataFrame([("s1", "t1"), ("s1", "t2")], "id string, tenant_id string")
    held = spark.createDataFrame([("d", "t2")], "id string, tenant_id string")
    checked = {r["event_id"]: r["reason"] for r in ingest.reject_unknown_refs(rows, sites, held).collect()}
    assert checked == {"1": None, "7": None, **{i: "store_rejected" for i in "23456"}}


def plain_refusals(rows, sites, held):
    """What `reject_unknown_refs` says, event by event: the reasons of the events that are kept."""
    low = lambda row, *names: tuple((row[name] is not None, row[name] or "") for name in names)
    first, per = {}, {}
    for row in rows:
        if row["session_id"] is not None:
            first[row["session_id"]] = min(first.get(row["session_id"], row), row, key=lambda r: low(r, "received", "tenant_id"))
            if row["ts"] is not None:
                per.setdefault((row["tenant_id"], row["session_id"]), []).append(row)
    out = {}
    for (tenant, session), own in per.items():
        owner = held.get(session) or first[session]["tenant_id"]
        who = min(own, key=lambda r: low(r, "received", "event_id", "anonymous_id"))["anonymous_id"] or ""
        pages = [r for r in own if r["kind"] == "NAVIGATION" and r["url"]]
        page = min(pages, key=lambda r: low(r, "ts", "event_id"))["url"] if pages else ""
        lost = any((r["tenant_id"], r["site_id"]) not in sites for r in own)
        refused = lost or (owner is not None and owner != tenant) or "\x00" in who + page
        out |= {r["event_id"]: "store_rejected" if refused else None for r in own if tenant is not None}
    return out


def test_references_equal_a_plain_check(spark):
    """One session has a third of the events; ids, times and tenants are missing here and there."""
    rng, rows = random.Random(4), []
    for n in range(900):
        session = "hot" if n % 3 == 0 else rng.choice([None, *(f"s{i}" for i in range(120))])
        tenant = rng.choice(["t1"] * 12 + ["t2", None]) if session != "hot" else "t1"
        site = rng.choice(["a"] * 30 + ["b", None]) if session != "hot" else "a"
        url = rng.choice(["https://web.test/"] * 9 + ["", None, "https://web.test/\x00"]) if session != "hot" else "x"
        who = rng.choice(["u"] * 20 + ["", "u\x00"]) if session != "hot" else "u"
        times = [rng.choice([None, *range(1, 40)]) if session != "hot" else n * 7_000_000 + 1 for _ in range(2)]
        rows.append({"event_id": f"{n:04d}", "session_id": session, "tenant_id": tenant, "site_id": site, "url": url, "anonymous_id": who})
        rows[-1] |= {"kind": rng.choice(["CLICK", "NAVIGATION"]), "ts": times[0], "received": times[1]}
    columns = ["event_id", "session_id", "tenant_id", "site_id", "url", "anonymous_id", "kind", "ts", "received"]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {'bigint' if c in ('ts', 'received') else 'string'}" for c in columns))
    df = df.withColumns({"ts": F.timestamp_millis("ts"), "ingested_at": F.timestamp_millis("received"), "event_type": F.col("kind")})
    sites = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t2"), (None, "t1"), ("b", "t9")], "id string, tenant_id string")
    held = {f"s{i}": "t2" for i in range(0, 120, 9)}
    for known in ({}, held):
        sessions = spark.createDataFrame(list(known.items()), "id string, tenant_id string") if known else None
        want = plain_refusals(rows, {("t1", "a"), ("t2", "a")}, known)
        found = ingest.reject_unknown_refs(df, sites, sessions).collect()
        assert {r["event_id"]: r["reason"] for r in found} == want and len(found) == len(want)
        assert {None, "store_rejected"} == set(want.values())
        refused = ingest.refused_sessions(df, sites, sessions)
        pairs = [tuple(r) for r in refused.collect()]
        assert len(pairs) == len(set(pairs)) and {(r["tenant_id"], r["session_id"]) for r in rows if want.get(r["event_id"])} <= set(pairs)


def test_events_of_accepted_sessions_are_not_moved(spark):
    """When few sessions are refused, events are marked where they are."""
    from helpers import events

    rows = events(spark, [("a", "1", 0, "CLICK"), ("b", "2", 0, "CLICK", {"tenant": "t9"})])
    sites = spark.createDataFrame([("s1", "t1")], "id string, tenant_id string")
    refused = ingest.refused_sessions(rows, sites).persist()
    assert [tuple(r) for r in refused.collect()] == [("t9", "b")]
    marked = ingest.reject_unknown_refs(rows, sites, None, refused)
    marked.collect()
    plan = marked._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    refused.unpersist()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_types_are_twelve():
    assert len(S.EVENT_TYPES) == 12 == len(set(S.EVENT_TYPES))


@pytest.mark.parametrize(
    "text, alone",
    [
        ('{"x":1}', True),
        (' {"x":[{"y":2}]} ', True),
        ('{"x":1}] junk}', False),
        ('{"x":1}],{"y":2}', False),
        ('{"x":1},{"y":2}', False),
        ('{"x":1}}', False),
        ('[{"x":1}]', False),
        ("", False),
        (None, False),
    ],
)
def test_one_object_and_nothing_behind_it(spark, text, alone):
    from trailmark.functions.json import is_single_object

    row = spark.createDataFrame([(text,)], "text string").select(is_single_object(F.col("text")).alias("alone")).first()
    assert row["alone"] is alone


@pytest.mark.parametrize("received", ["2025-01-01", "2025-01-01 00:00:00", "2025-01-01T00:00:00", "20250101T000000Z"])
def test_an_instant_has_a_time_and_a_zone(spark, received):
    decoded = ingest.decode_envelope(spark.createDataFrame([(envelope(receivedAt=received),)], "value string"), "telemetry")
    assert [r["well_formed"] for r in decoded.collect()] == [False]


def test_unknown_types_cannot_spoil_a_body(spark):
    strange = {"clientEventId": 5, "type": "GAZE", "ts": "soon", "props": [1]}
    judged = ingest.validate_batches(ingest.parse_batches(bodies(spark, body(event(), strange), body(strange), body(*[event(clientEventId="x")] * 501))))
    rows = judged.select("rejection", "unknown_events", F.size("batch.events").alias("known")).collect()
    assert sorted((r["rejection"] or "", r["unknown_events"], r["known"]) for r in rows) == [("", 1, 0), ("", 1, 1), ("invalid", 0, 501)]
