"""The stream of distinct messages over several micro-batches, far apart in time."""

import datetime as dt
import os

from millrace.plans import streams
from millrace.streaming import messages

SCHEMA = "event_id string, owner_id string, task_record_id string, checksum string, received_at timestamp"


def test_late_messages_and_late_repeats(spark, tmp_path, monkeypatch):
    """Of four files, one a batch: the last repeats a message 201 days later and brings a new one that is 190 days late."""
    at = lambda day: dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
    files = [[("a", 0), ("b", 1)], [("c", 200)], [("d", 200)], [("a", 201), ("e", 10), ("c", 202)]]
    folder = tmp_path / "task_enrich_events.parquet"
    folder.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame([(c * 64, "o", "t", "c", at(d)) for c, d in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        [part] = (tmp_path / f"part{i}").glob("*.parquet")
        part.rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    real = messages.file_stream
    monkeypatch.setattr(messages, "file_stream", lambda spark, path, schema, *_: real(spark, path, schema, 1))
    assert sorted(r.event_id for r in streams.stream_once(spark, str(tmp_path)).collect()) == [c * 64 for c in "abcde"]
