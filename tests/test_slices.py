"""Sliced work against plain pandas, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from helpers import T0
from pyspark.sql import functions as F

from trailmark.operators import slices
from trailmark.operators.sessions import sessionize

MINUTE = 60_000


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.35, 0, rng.integers(1, 60, n)),
            "ms": T0 + rng.integers(0, 20 * 3_600_000, n) // 1000 * 1000,
            "event_id": [f"{i:05d}" for i in range(n)],
            "v": rng.integers(0, 5, n),
        }
    ).sort_values(["key", "ms", "event_id"], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_millis("ms"))
    return pdf, df.repartition(7)


@pytest.mark.parametrize("width", [7 * MINUTE, 60 * MINUTE, 10_000 * MINUTE])
def test_previous(rows, width):
    pdf, df = rows
    got = slices.with_previous(df, ["key"], ["ts", "event_id"], ["v"], width).select("event_id", "prev_v").toPandas()
    wanted = pdf.assign(p=pdf.groupby("key")["v"].shift())
    merged = wanted.merge(got, on="event_id")
    assert len(got) == len(pdf)
    assert (merged["p"].fillna(-1) == merged["prev_v"].fillna(-1)).all()


@pytest.mark.parametrize("width", [7 * MINUTE, 10_000 * MINUTE])
def test_running_total(rows, width):
    pdf, df = rows
    got = slices.with_running_total(df, ["key"], ["ts", "event_id"], F.col("v"), "total", width)
    merged = pdf.assign(t=pdf.groupby("key")["v"].cumsum()).merge(got.select("event_id", "total").toPandas(), on="event_id")
    assert len(merged) == len(pdf) and (merged["t"] == merged["total"]).all()


@pytest.mark.parametrize("width", [MINUTE, 60 * MINUTE])
@pytest.mark.parametrize("before, after", [(0, 5 * MINUTE), (12 * MINUTE, 0), (3 * MINUTE, 3 * MINUTE)])
def test_neighbours(rows, width, before, after):
    pdf, df = rows
    got = slices.with_neighbours(df, ["key"], {"n": F.sum("v")}, before, after, width_ms=width)
    got = got.select("event_id", "n").toPandas()
    wanted = {}
    for _, group in pdf.groupby("key"):
        for r in group.itertuples():
            wanted[r.event_id] = group.loc[group["ms"].between(r.ms - before, r.ms + after), "v"].sum()
    assert len(got) == len(pdf)
    assert dict(zip(got["event_id"], got["n"])) == wanted


def test_attach(rows):
    pdf, df = rows
    firsts = df.groupBy("key").agg(F.min("ms").alias("first"))
    got = slices.attach_per_key(df, firsts, ["key"]).select("event_id", "first").toPandas()
    merged = pdf.assign(f=pdf.groupby("key")["ms"].transform("min")).merge(got, on="event_id")
    assert len(merged) == len(pdf) and (merged["f"] == merged["first"]).all()


@pytest.mark.parametrize("width", [7 * MINUTE, 60 * MINUTE, 10_000 * MINUTE])
def test_sessionize(rows, width):
    pdf, df = rows
    gap = 20 * MINUTE
    got = sessionize(df, ["key"], gap, width).select("event_id", "session_no").toPandas()
    pause = pdf.groupby("key")["ms"].diff()
    wanted = pdf.assign(no=(pause.isna() | (pause > gap)).groupby(pdf["key"]).cumsum())
    merged = wanted.merge(got, on="event_id")
    assert len(got) == len(pdf) and (merged["no"] == merged["session_no"]).all()


def test_a_gap_of_exactly_the_timeout_stays(spark):
    rows = spark.createDataFrame([(0, "a"), (1_800_000, "b"), (3_600_001, "c")], "ms bigint, event_id string")
    rows = rows.select(F.lit(1).alias("key"), F.timestamp_millis(F.col("ms") + T0).alias("ts"), "event_id")
    got = {r["event_id"]: r["session_no"] for r in sessionize(rows, ["key"]).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
