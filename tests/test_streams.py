import json

from histmetrics.demo.stream_queries import drained
from histmetrics.streaming import progress

COLUMNS = "run_id string, seq int, type string, commits_total int, processed int"


def check(spark, *events):
    rows = [("r", i, *e) for i, e in enumerate(events)]
    return progress.check_progress(spark.createDataFrame(rows, COLUMNS)).first()


START, DONE = (progress.STARTED, 2, None), (progress.COMPLETED, None, None)


def step(n, total=2):
    return (progress.PROGRESS, total, n)


def test_valid_sequences(spark):
    assert check(spark, START, step(1), step(2), DONE)["valid"]
    assert check(spark, START, (progress.FAILED, None, None))["valid"]


def test_invalid_sequences(spark):
    assert not check(spark, step(1), START, step(2), DONE)["starts_first"]
    assert not check(spark, START, step(1), step(1), DONE)["numbered"]
    assert not check(spark, START, step(2), DONE)["numbered"]
    assert not check(spark, START, step(1), step(2))["one_terminal"]
    assert not check(spark, START, step(1), DONE, DONE)["one_terminal"]
    assert not check(spark, START, DONE, step(1))["ends_last"]
    assert not check(spark, START, step(1, 3), DONE)["constant_total"]


def test_status(spark, rows):
    data = [
        ("a", 0, progress.STARTED, 4, None), ("a", 1, progress.PROGRESS, 4, 1), ("b", 0, progress.STARTED, 0, None),
        ("b", 1, progress.COMPLETED, None, None), ("c", 0, progress.FAILED, None, None),
    ]
    out = progress.run_status(spark.createDataFrame(data, COLUMNS))
    assert rows(out, "run_id", "state", "percent") == [("a", "running", 25.0), ("b", "completed", None), ("c", "failed", None)]


def test_progress_files(spark, rows, tmp_path):
    events = [
        {"type": "run_started", "run_id": "r1", "commits_total": 1},
        {"type": "commit_progress", "processed": 1, "commits_total": 1, "short_hash": "abcdef12"},
        {"type": "other"},
        {"type": "run_completed", "run_id": "r1", "commits_succeeded": 1, "commits_failed": 0},
    ]
    (tmp_path / "r1.jsonl").write_text("\n".join(json.dumps(e) for e in events))
    out = drained(spark, progress.read_progress(spark, str(tmp_path)), "t")
    assert rows(out, "run_id", "type") == [("r1", "commit_progress"), ("r1", "run_completed"), ("r1", "run_started")]


def test_idle_runs_are_closed(spark, rows, tmp_path):
    lines = "\n".join(
        f'{{"run_id": "{r}", "type": "{t}", "commits_total": 2, "processed": {p}, "arrived_at": "{at}"}}'
        for r, t, p, at in [
            ("a", progress.STARTED, "null", "2024-01-01T00:00:00Z"), ("a", progress.PROGRESS, 1, "2024-01-01T00:10:00Z"),
            ("b", progress.STARTED, "null", "2024-01-02T00:00:00Z"),
        ]
    )
    (tmp_path / "1.json").write_text(lines)
    stream = spark.readStream.schema("run_id string, type string, commits_total int, processed int, arrived_at timestamp").json(str(tmp_path))
    out = drained(spark, progress.run_status(stream, idle="1 hour"), "idle")
    assert rows(out, "run_id", "state", "percent") == [("a", "running", 50.0)]
