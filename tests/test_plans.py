"""What the physical plans must look like."""

import contextlib
import io

import pytest
from helpers import events, moment

from trailmark import schemas as S
from trailmark.operators import tables
from trailmark.plans import load
from trailmark.sources.writers import write_events

FOLDER = "/root/testdata/sf0.001"
RUNS = load()[0]
RUNNING = {
    *("events_stream", "replay_stream", "session_stream", "closer_job", "lifecycle_stream", "dedup_stream", "compact_days", "close_sessions"),
    *("stored_sessions", "pipeline_counters", "erasure_job"),
}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "events")
    rows = events(spark, [("s", f"{i}", i * 50_000_000, "CLICK") for i in range(8)])
    write_events(rows, path, 0)
    return spark.read.parquet(path)


def test_session_reads_push_their_keys_to_the_scan(stored):
    text = plan(tables.session_events(stored, "t1", "s").select("event_id", "ts"))
    assert "EqualTo(tenant_id,t1)" in text and "EqualTo(session_id,s)" in text


def test_retention_prunes_days(stored):
    text = plan(tables.expire(stored, "ts", 1, moment(1_750_300_000_000), "event_date"))
    assert "PartitionFilters: [isnotnull(event_date" in text and ">=" in text


def test_narrow_reads_read_few_columns(stored):
    from trailmark.operators.sessions import session_stats

    text = plan(session_stats(stored))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("target_text" not in line and "anonymous_id" not in line for line in schemas)
    assert "url" in schemas[0] and set(S.EVENT_KEYS) <= set(stored.columns)


@pytest.mark.parametrize("name", sorted(set(RUNS) - RUNNING))
def test_no_nested_loops(spark, name):
    text = plan(RUNS[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_sessions_are_counted_without_a_join(stored):
    from trailmark.operators.sessions import session_stats

    text = plan(session_stats(stored))
    assert "Join" not in text.split("\n\n(1)")[0] and text.split("\n\n(1)")[0].count("Exchange") == 2


def shuffles(text: str) -> tuple[int, int]:
    """Scans and exchanges of a plan."""
    tree = text.split("\n\n(1)")[0]
    return tree.count("Scan parquet"), tree.count("Exchange")


def test_funnel_reads_events_once(stored):
    from trailmark.operators.insights import funnel

    steps = [stored["event_type"] == kind for kind in ("NAVIGATION", "CLICK", "CUSTOM")]
    scans, exchanges = shuffles(plan(funnel(stored, steps, 1000)))
    assert scans == 1 and exchanges <= 3


def test_signals_share_one_shuffle(stored):
    from trailmark.operators.signals import signal_counts

    scans, exchanges = shuffles(plan(signal_counts(stored)))
    assert scans == 1 and exchanges <= 3
