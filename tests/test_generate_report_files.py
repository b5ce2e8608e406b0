"""U3 with waits and a ledger, S4 by manifest."""
import pathlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import generate as gen
from tessera.sources.report_files import read_report_run, write_report_run


def test_waits_between_attempts_and_none_after_the_last():
    slept = []

    def fail(prompt, n):
        raise TimeoutError(n)
    assert gen.attempt(fail, "p", sleep=slept.append) == (None, "TimeoutError: 3", 3) and slept == [1.0, 2.0]
    slept.clear()
    assert gen.attempt(lambda p, n: p if n == 2 else fail(p, n), "p", sleep=slept.append) == ("p", None, 2) and slept == [1.0]
    slept.clear()
    gen.attempt(fail, "p", max_attempts=5, waits=(0.5,), sleep=slept.append)
    assert slept == [0.5] * 4


def calls(folder):
    return [p.read_text() for p in sorted(pathlib.Path(folder).iterdir())]


@pytest.fixture
def model():
    """A model that notes each call in a file of its own, fails for good on "bad" and once on "slow".
    (Functions within a function travel to the workers whole.)"""
    def of(folder, stop=None):
        def fn(prompt, n):
            import os
            import pathlib
            import uuid
            if stop and os.path.exists(stop) and len(os.listdir(folder)) >= 150:
                raise KeyboardInterrupt  # the worker dies, as with its executor
            (pathlib.Path(folder) / uuid.uuid4().hex).write_text(prompt or "")
            if prompt == "bad" or prompt and prompt.startswith("slow") and n == 1:
                raise ValueError("no")
            return (prompt or "").upper()
        return fn
    return of


def test_no_prompt_is_generated_twice(spark, tmp_path, model):
    seen, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    seen.mkdir()
    rows = [(i, f"p{i % 30}") for i in range(60)] + [(100, "slow1"), (101, None), (102, None)]
    df = spark.createDataFrame(rows, "id long, p string")
    out = gen.batch_generate(df, "id", "p", model(str(seen)), waits=(), ledger=ledger, buckets=5)
    for _ in range(2):                   # the plan runs twice, the model does not
        got = {r.id: (r.output, r.error, r.attempts) for r in out.collect()}
    assert got == {i: ((p or "").upper(), None, 2 if p == "slow1" else 1) for i, p in rows}
    assert sorted(calls(seen)) == sorted([f"p{i}" for i in range(30)] + ["slow1", "slow1", ""])


def test_a_killed_run_is_resumed(spark, tmp_path, model):
    seen, ledger, stop = tmp_path / "calls", str(tmp_path / "ledger"), tmp_path / "stop"
    seen.mkdir()
    stop.write_text("x")
    df = spark.createDataFrame([(i, f"p{i:03d}") for i in range(400)], "id long, p string").coalesce(1)

    def job():
        return gen.batch_generate(df, "id", "p", model(str(seen), str(stop)), waits=(), ledger=ledger, buckets=3)
    with pytest.raises(Exception):
        job().collect()
    before = len(calls(seen))
    assert 0 < before < 400
    stop.unlink()
    assert {r.id: r.output for r in job().collect()} == {i: f"P{i:03d}" for i in range(400)}
    assert sorted(calls(seen)) == [f"p{i:03d}" for i in range(400)]


def test_failed_prompts_are_tried_again_or_kept(spark, tmp_path, model):
    seen, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    seen.mkdir()
    df = spark.createDataFrame([(1, "bad"), (2, "good")], "id long, p string")
    for retry, more in ((True, 4), (False, 4), (True, 7)):
        got = {r.id: (r.output, r.error, r.attempts) for r in
               gen.batch_generate(df, "id", "p", model(str(seen)), waits=(), ledger=ledger, buckets=2, retry_errors=retry).collect()}
        assert got == {1: (None, "ValueError: no", 3), 2: ("GOOD", None, 1)} and len(calls(seen)) == more


def test_report_run_round_trip(spark, tmp_path):
    bodies = {"1": "# Ü report\n\nline", "2": "# two\n", "a/b ü": "", "3": "x" * 100_000}
    df = spark.createDataFrame([*bodies.items(), ("4", None)], "report_id string, body string").repartition(3)
    write_report_run(df, str(tmp_path), "20240101_000000")
    assert {r.report_id: r.body for r in read_report_run(spark, str(tmp_path), "20240101_000000").collect()} == bodies | {"4": ""}
    assert (tmp_path / "20240101_000000" / "1.md").read_text() == "# Ü report\n\nline"
    assert not [p for p in (tmp_path / "20240101_000000").iterdir() if p.is_dir() and p.name != "lists"]
    with pytest.raises(ValueError):
        write_report_run(df, str(tmp_path), "20240101_000000")
    write_report_run(df.limit(0), str(tmp_path), "empty")
    assert read_report_run(spark, str(tmp_path), "empty").count() == 0


def test_aborted_run_cannot_be_seen(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("report_id"), F.when(F.col("id") < 99, "b").otherwise(F.raise_error(F.lit("lost"))).alias("body"))
    with pytest.raises(Exception):
        write_report_run(df.repartition(4, "report_id"), str(tmp_path), "r")
    with pytest.raises(FileNotFoundError):
        read_report_run(spark, str(tmp_path), "r")
    good = df.where("report_id < 99")
    write_report_run(good, str(tmp_path), "r")
    assert read_report_run(spark, str(tmp_path), "r").count() == 99
    (tmp_path / "r" / "5.md").write_text("changed")
    with pytest.raises(Exception):
        read_report_run(spark, str(tmp_path), "r").collect()


@pytest.mark.parametrize("ids", [[1, 1], [None, 2]])
def test_ids_must_tell_reports_apart(spark, tmp_path, ids):
    with pytest.raises(ValueError):
        write_report_run(spark.createDataFrame([(i, "b") for i in ids], "report_id long, body string"), str(tmp_path), "r")
