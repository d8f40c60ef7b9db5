"""A stream of bars, replayed in pieces and out of order, against the same bars as a table and against a plain loop."""

import datetime as dt

import numpy as np
import pytest

from tidewick.streaming import states

SCHEMA = "ticker string, ts timestamp, close double"


def bars(n=160, seed=9):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    return [(t, start + dt.timedelta(minutes=30 * i), float(100 + x)) for t in ("a", "b") for i, x in enumerate(rng.normal(size=n).cumsum())]


def plain(rows, fast=9, slow=21, k=3):
    out, by = [], {}
    for t, ts, close in sorted(rows):
        f, s, raw, raw_age, state, age = by.get(t, (None, None, None, 0, None, 0))
        f, s = (close, close) if f is None else (0.2 * close + 0.8 * f, 2 / 22 * close + (1 - 2 / 22) * s)
        now = "risk_on" if f > s else "risk_off" if f < s else "neutral"
        raw_age = raw_age + 1 if now == raw else 1
        before, state = state, now if state is None or raw_age >= k else state
        age = age + 1 if state == before else 1
        by[t] = f, s, now, raw_age, state, age
        out.append((t, ts, round(close, 8), round(f, 8), round(s, 8), now, state, age))
    return out


def as_list(df):
    return sorted((r["ticker"], r["ts"], *(round(r[c], 8) for c in ("close", "ema_fast", "ema_slow")), r["raw"], r["state"], r["age"]) for r in df.collect())


def replay(spark, folder, pieces, late="4 hours"):
    for i, rows in enumerate(pieces):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/piece={i:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in/*")
    run = states.live_states(source, late).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return spark.read.schema(states.OUT).parquet(f"{folder}/out")


def test_table_equals_plain_loop(spark):
    rows = bars()
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("b", dt.datetime(2030, 1, 1), None)], SCHEMA)
    assert as_list(states.states_of(df)) == plain(rows)
    assert states.states_of(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [1, 5])
def test_replay_in_pieces_equals_the_table(spark, tmp_path, many):
    """Bars come out of order by less than the delay; what the watermark has reached is the table's result, row for row."""
    rows = bars()
    rng = np.random.default_rng(1)
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=float(rng.uniform(0, 100))))
    step = -(-len(arrival) // many)
    found = as_list(replay(spark, str(tmp_path), [arrival[i : i + step] for i in range(0, len(arrival), step)]))
    border = max(r[1] for r in rows) - dt.timedelta(hours=4)
    assert found == [r for r in as_list(states.states_of(spark.createDataFrame(rows, SCHEMA))) if r[1] <= border]


def test_late_bars_are_dropped(spark, tmp_path):
    rows = bars(60)
    late = [("a", rows[0][1] + dt.timedelta(minutes=1), 1e6)]
    found = as_list(replay(spark, str(tmp_path), [rows[:40] + rows[60:100], rows[40:60] + rows[100:], late, []], "1 hour"))
    border = max(r[1] for r in rows) - dt.timedelta(hours=1)
    assert found == [r for r in plain(rows) if r[1] <= border]
