"""Approvals as a stream equal those as a table, however events are dealt into micro-batches."""

import datetime as dt
import random

import pytest

from sparkloom.streaming import approvals

START, WAIT = dt.datetime(2024, 1, 1), dt.timedelta(hours=6)


def events(seed=1, n=40):
    rng, rows = random.Random(seed), []
    for i in range(n):
        asked = START + dt.timedelta(minutes=7 * rng.randrange(200))
        if rng.random() < 0.9:
            rows.append((i, "request", None, "agent", asked))
        if rng.random() < 0.2:
            rows.append((i, "request", None, "again", asked + dt.timedelta(hours=2)))
        for k in range(rng.randrange(4)):
            rows.append((i, "decision", rng.choice(["approved", "rejected", "rejected", "perhaps"]), f"p{k}", asked + dt.timedelta(minutes=rng.choice((-30, 10, 90, 200, 500)) + k)))
    rows.append((999, "request", None, "late one", START + dt.timedelta(days=9)))  # moves the watermark on
    return sorted(rows, key=lambda r: r[4])


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_table_under_any_split(spark, tmp_path, parts):
    rows = events()
    cuts = sorted(random.Random(parts).sample(range(1, len(rows)), parts - 1)) if parts > 1 else []
    (tmp_path / "in").mkdir()
    stream = approvals.changes_stream(spark.readStream.schema(approvals.EVENTS).parquet(str(tmp_path / "in")), WAIT)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], approvals.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        # a new run goes on from the stored state
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(approvals.CHANGES).parquet(str(tmp_path / "out")).collect()
    until = rows[-1][4] - dt.timedelta(hours=1)
    want = approvals.changes(spark.createDataFrame(rows, approvals.EVENTS), WAIT, until).collect()
    key = lambda found: sorted((r["id"], str(r["at"]), r["status"], r["actor"] or "", r["reason"] or "") for r in found)
    assert key(got) == key(want)
    assert {r["status"] for r in want} == {"pending", "approved", "rejected", "refused", "expired"}
    assert {r["reason"] for r in want} >= {"already approved", "already rejected", "not found", "expired", "unknown decision"}
    decided = [r["id"] for r in want if r["status"] in approvals.DECISIONS]
    assert len(decided) == len(set(decided))
