import random

import pytest
from helpers import T0, at, events, moment
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.operators import sessions as ops
from trailmark.session import written

MINUTE = 60_000
CHROME = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36"


def nav(session, event_id, ms, url, **more):
    return (session, event_id, ms, "NAVIGATION", {"url": url, **more})


def empty(spark):
    return spark.createDataFrame([], S.USER_SESSION)


def track(spark, table, rows):
    return ops.upsert_sessions(table, ops.session_updates(events(spark, rows)))


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("width", [1000, 3_600_000])
def test_pages_are_changes_of_the_url(spark, width):
    urls = ["a", "a", "b", "b", "a", "c"]
    rows = [nav("s", f"{i}", i * 700, u) for i, u in enumerate(urls)] + [("s", "x", 10, "CLICK")]
    rows += [nav("one", "o", 0, "a"), ("none", "n", 0, "CLICK")]
    rows += [nav("f", "f1", 0, "a#x"), nav("f", "f2", 1500, "a#y"), nav("f", "f3", 3000, "b", props='{"trigger":"replaceState"}')]
    got = {r["session_id"]: r for r in ops.session_stats(events(spark, rows), width).collect()}
    assert {k: v["page_count"] for k, v in got.items()} == {"s": 4, "one": 1, "none": 0, "f": 1}
    assert got["s"]["duration_ms"] == 3500


def test_batch_becomes_a_session(spark):
    rows = [
        nav("s", "1", 0, "https://web.test/in", received=100, ua=CHROME),
        ("s", "2", 1000, "CLICK", {"received": 1100}),
        nav("s", "3", 2000, "https://web.test/next", received=2100),
    ]
    row = only(track(spark, empty(spark), rows))
    assert (row["started_at"], row["last_active_at"], row["ended_at"]) == (at(T0), at(T0 + 2100), None)
    assert (row["entry_url"], row["entry_at"]) == ("https://web.test/in", at(T0))
    assert (row["platform"], row["browser"], row["page_count"], row["version"]) == ("desktop", "Chrome 131", 0, 0)
    assert row["end_user_id"] and row["anonymous_id"] == "anon"


def test_redelivery_changes_nothing(spark):
    rows = [nav("s", "1", 0, "a", ua=CHROME), ("s", "2", 5, "CLICK", {"received": 3000})]
    once = track(spark, empty(spark), rows)
    assert only(track(spark, once, rows)) == only(once)
    users = ops.end_user_updates(ops.session_updates(events(spark, rows)))
    table = ops.upsert_end_users(spark.createDataFrame([], S.END_USER), users)
    assert only(ops.upsert_end_users(table, users)) == only(table)


def test_out_of_order(spark):
    late = [nav("s", "2", 60_000, "second", received=70_000)]
    early = [nav("s", "1", 0, "first", received=100), ("s", "0", 1, "CLICK", {"received": 101})]
    row = only(track(spark, track(spark, empty(spark), late), early))
    assert (row["started_at"], row["last_active_at"]) == (at(T0), at(T0 + 70_000))
    assert (row["entry_url"], row["entry_at"], row["version"]) == ("first", at(T0), 1)


def test_folding_updates_equals_one_batch(spark):
    rows = [nav("s", f"{i}", i * 10, f"u{i}", received=500 - i, ua=CHROME if i == 3 else " ") for i in range(6)]
    whole = ops.session_updates(events(spark, rows))
    parts = [ops.session_updates(events(spark, rows[i::3])) for i in range(3)]
    folded = ops.fold_updates(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0]))
    assert only(folded.select(*whole.columns)) == only(whole)


def test_another_tenant_cannot_touch_a_session(spark):
    table = track(spark, empty(spark), [("s", "1", 0, "CLICK")])
    row = only(track(spark, table, [("s", "2", 90_000, "CLICK", {"tenant": "t2"})]))
    assert row["tenant_id"] == "t1" and row["version"] == 0 and row["last_active_at"] == at(T0)


class Model:
    """Sessions in plain Python: what the table and the closing job have to say."""

    def __init__(self):
        self.stored, self.rows = [], {}

    def receive(self, rows, stored=True):
        self.stored += rows if stored else []
        for session, _, ms, kind, more in rows:
            row = self.rows.setdefault(session, {"start": ms, "active": more["received"], "end": None, "flag": False, "counts": (0, 0)})
            late = row["end"] is not None and (ms < row["start"] or more["received"] > row["active"])
            row["start"], row["active"] = min(row["start"], ms), max(row["active"], more["received"])
            if late:
                row["end"], row["flag"] = max(row["end"], ms), True

    def close(self, now, idle):
        out = {}
        for session, row in self.rows.items():
            own = sorted((ms, event_id, kind, more) for s, event_id, ms, kind, more in self.stored if s == session)
            is_open = row["end"] is None
            if not (row["flag"] or is_open and row["active"] < now - idle):
                continue
            if not own and is_open and row["active"] > now - 2 * idle:
                continue
            pages = [more["url"] for _, _, kind, more in own if kind == "NAVIGATION"]
            counts = sum(a != b for a, b in zip([None, *pages], pages)), sum(kind == "EXCEPTION" for _, _, kind, _ in own)
            row["end"], row["flag"], row["counts"] = (own[-1][0] if own else row["start"]), False, counts
            out[session] = ("CLOSED" if is_open else "UPDATED", *counts, own[-1][0] - own[0][0] if own else 0)
        return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_of_the_closing_job(spark, seed):
    """Batches at random, some late and some not stored, with a pass behind each."""
    draw, model, table, number, clock = random.Random(seed), Model(), empty(spark), 0, 0
    for batch in range(3):
        clock += draw.choice([7, 40]) * MINUTE
        rows, lost = [], []
        for _ in range(25):
            number += 1
            session = f"s{draw.randrange(9)}"
            ms = clock - draw.randrange(1, 30 * MINUTE) * (1 if draw.random() < 0.8 else 3)
            more = {"received": clock + number, "url": draw.choice("pqr")}
            kind = draw.choice(["NAVIGATION", "EXCEPTION", "CLICK"])
            target = lost if session in ("s7", "s8") and batch < 2 else rows
            target.append((session, f"{number:04d}", ms, kind, more))
        model.receive(rows)
        model.receive(lost, stored=False)
        table = written(track(spark, table, rows + lost), "model")
        now, idle = clock + draw.choice([3, 21]) * MINUTE, 20 * MINUTE
        table, records = ops.close_sessions(table, events(spark, model.stored), moment(T0 + now), idle)
        found = {r["sessionId"]: (r["type"], r["pageCount"], r["errorCount"], r["durationMs"]) for r in records.collect()}
        assert found == model.close(now, idle)
        table = written(table, "model")
        state = {r["id"]: (r["ended_at"], r["needs_recompute"], (r["page_count"], r["error_count"])) for r in table.collect()}
        assert state == {k: (None if v["end"] is None else at(T0 + v["end"]), v["flag"], v["counts"]) for k, v in model.rows.items()}


def test_claims_take_the_longest_idle_first(spark):
    rows = [(f"s{i}", f"{i}", i * MINUTE, "CLICK") for i in range(5)]
    claims = ops.claim_sessions(track(spark, empty(spark), rows), moment(T0 + 34 * MINUTE), 30 * MINUTE, limit=2)
    assert [r["id"] for r in claims.collect()] == ["s0", "s1"]
    everything = ops.claim_sessions(track(spark, empty(spark), rows), moment(T0 + 34 * MINUTE), 30 * MINUTE, limit=None)
    assert {r["id"] for r in everything.collect()} == {"s0", "s1", "s2", "s3"}


def test_links_only_what_is_not_linked(spark):
    table = track(spark, empty(spark), [("a", "1", 0, "CLICK"), ("b", "2", 0, "CLICK", {"anonymous": "else"})])
    who = spark.createDataFrame([("s1", "anon", "member")], "site_id string, anonymous_id string, end_user_id string")
    linked = ops.link_sessions(table, who)
    assert {(r["id"], r["end_user_id"] == "member", r["version"]) for r in linked.collect()} == {("a", True, 1), ("b", False, 0)}
    assert {r["version"] for r in ops.link_sessions(linked, who).collect()} == {0, 1}


def test_several_identities_of_a_visitor(spark):
    table = track(spark, empty(spark), [("a", "1", 0, "CLICK"), ("b", "2", 0, "CLICK", {"anonymous": " "})])
    who = [("s1", "anon", "zoe", 1), ("s1", "anon", "adam", 2), ("s1", " ", "nobody", 3), ("s1", " ", "noone", 4)]
    who = spark.createDataFrame(who, "site_id string, anonymous_id string, end_user_id string, identified_at int")
    linked = ops.link_sessions(table, who).collect()
    assert {(r["id"], r["end_user_id"]) for r in linked} == {("a", "adam"), ("b", None)} and len(linked) == 2


def test_blank_visitors_have_no_user(spark):
    rows = [("a", "1", 0, "CLICK", {"anonymous": " "})]
    assert ops.end_user_updates(ops.session_updates(events(spark, rows))).count() == 0
    assert only(track(spark, empty(spark), rows))["end_user_id"] is None


def test_error_cap(spark):
    rows = [("s", f"{i:02d}", i * 100, "EXCEPTION") for i in range(40)] + [("s", "c", 50, "CLICK")]
    rows = [(s, e, ms - T0 % 60_000, k) for s, e, ms, k in rows]
    kept = {r["event_id"] for r in ops.cap_errors(events(spark, rows)).collect()}
    assert kept == {f"{i:02d}" for i in range(30)} | {"c"}


def test_navigations_and_trail(spark):
    rows = [nav("s", f"{i}", i, u) for i, u in enumerate(["a", "a", "a#x", "b"])]
    assert {r["event_id"] for r in ops.distinct_navigations(events(spark, rows)).collect()} == {"0", "2", "3"}
    trail = ops.navigation_trail(events(spark, rows)).orderBy("position").collect()
    assert [(r["position"], r["page"]) for r in trail] == [(1, "a"), (2, "a"), (3, "a"), (4, "b")]


def test_session_list_pages(spark):
    rows = [(f"s{i}", f"{i}", i // 2, "CLICK") for i in range(6)]
    table = track(spark, empty(spark), rows)
    seen, cursor = [], None
    while page := ops.list_sessions(table, "t1", is_open=True, after=cursor, limit=2).collect():
        seen += [r["id"] for r in page]
        cursor = (F.lit(page[-1]["started_at"]), page[-1]["id"])
    assert seen == ["s4", "s5", "s2", "s3", "s0", "s1"]
    assert ops.list_sessions(table, None).count() == ops.list_sessions(table, "t2").count() == 0


def test_events_page(spark):
    rows = events(spark, [("s", f"{i}", i // 2, "CLICK") for i in range(5)])
    first = ops.events_page(rows, "t1", "s", limit=3).collect()
    assert [r["event_id"] for r in first] == ["0", "1", "2"]
    rest = ops.events_page(rows, "t1", "s", (F.lit(first[-1]["ts"]), "2")).collect()
    assert [r["event_id"] for r in rest] == ["3", "4"]
    assert ops.events_page(rows, "t2", "s").count() == 0
