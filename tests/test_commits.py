"""Keyed tables and compacted logs: what counts after crashes, repeats and races, and which files are read."""

import pytest
from pyspark.sql import functions as F

from ratergrid.sources import append_keyed, keyed, read_keyed
from ratergrid.sources.manifest import commit, latest_commit
from ratergrid.streaming import annotation_log as A

FLAT = "unit_id string, rater string, attempt int, V1 int, V1_reason string, total_score int"


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_df(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_commits_are_numbered_and_given_once(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert latest_commit(spark, folder) == (0, None)
    assert commit(spark, folder, 1, {"a": 1}) and not commit(spark, folder, 1, {"a": 2})
    assert commit(spark, folder, 2, {"a": 3}) and latest_commit(spark, folder) == (2, {"a": 3})


def test_a_commit_that_was_never_written_is_passed_over(spark, tmp_path, monkeypatch):
    from ratergrid.sources import manifest

    monkeypatch.setattr(manifest, "GIVEN_UP", 0.1)
    folder = str(tmp_path / "c")
    commit(spark, folder, 1, {"a": 1})
    (tmp_path / "c" / f"{2:010d}").write_text("")
    assert latest_commit(spark, folder) == (2, {"a": 1})


def test_keys_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_keyed(spark, path) is None
    assert append_keyed(spark, rows_df(spark, [(1, "b"), (1, "a"), (None, "n"), (2, "c")]), path, ["k"]) == 3
    assert append_keyed(spark, rows_df(spark, [(None, "z"), (2, "z"), (3, "d")]), path, ["k"], buckets=3) == 1
    assert append_keyed(spark, rows_df(spark, [(3, "z")]), path, ["k"]) == 0
    got = read_keyed(spark, path)
    assert got.columns == ["k", "v"]
    assert table_of(got) == sorted([(1, "a"), (None, "n"), (2, "c"), (3, "d")], key=str)


def test_an_interrupted_append_stores_nothing_and_is_made_good(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    append_keyed(spark, rows_df(spark, [(1, "a")]), path, ["k"])

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(keyed, "commit", dies)
        with pytest.raises(RuntimeError):
            append_keyed(spark, rows_df(spark, [(2, "b")]), path, ["k"])
    assert table_of(read_keyed(spark, path)) == [(1, "a")]
    append_keyed(spark, rows_df(spark, [(2, "b"), (3, "c")]), path, ["k"])
    assert table_of(read_keyed(spark, path)) == [(1, "a"), (2, "b"), (3, "c")]


def test_two_writers_at_a_time(spark, tmp_path, monkeypatch):
    path, real, raced = str(tmp_path / "t"), keyed.commit, []

    def overtaken(*args):
        if not raced:
            raced.append(1)
            append_keyed(spark, rows_df(spark, [(1, "other"), (5, "other")]), path, ["k"])
        return real(*args)

    monkeypatch.setattr(keyed, "commit", overtaken)
    append_keyed(spark, rows_df(spark, [(1, "mine"), (2, "mine")]), path, ["k"])
    assert table_of(read_keyed(spark, path)) == [(1, "other"), (2, "mine"), (5, "other")]


def test_other_buckets_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    append_keyed(spark, spark.range(400).selectExpr("id AS k", "'x' AS v"), path, ["k"], buckets=16)
    content = latest_commit(spark, f"{path}/{keyed.COMMITS}")[1]
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(keyed._committed(spark, path, content, None))) == 16
    assert len(files(keyed._committed(spark, path, content, [3, 5]))) == 2
    text = keyed._committed(spark, path, content, [3])._jdf.queryExecution().executedPlan().toString()
    assert keyed.BUCKET in text.split("PartitionFilters:")[1].split("]")[0]


def batch(spark, out, run, n, rows):
    df = spark.createDataFrame([(u, "m", a, s, "r", s) for u, a, s in rows], FLAT)
    df.write.mode("overwrite").parquet(f"{out}/{A.RUN}={run}/{A.BATCH}={n}")


def log_of(spark, out):
    return sorted((r["unit_id"], r["attempt"], r["V1"]) for r in A.read_annotation_log(spark, out, ["V1"]).collect())


def test_compaction_keeps_the_log_and_reads_only_the_rest(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "log")
    batch(spark, out, "r1", 0, [("u1", 3, 3), ("u2", 2, 2)])
    batch(spark, out, "r1", 1, [("u1", 2, 1), ("u2", 11, 1)])
    batch(spark, out, "r2", 0, [("u3", 1, 1)])
    before = log_of(spark, out)
    assert A.compact_annotation_log(spark, out, ["V1"]) and not A.compact_annotation_log(spark, out, ["V1"])
    assert log_of(spark, out) == before == [("u1", 2, 1), ("u2", 2, 2), ("u3", 1, 1)]
    batch(spark, out, "r1", 2, [("u1", 1, 2), ("u4", 5, 2)])
    batch(spark, out, "r1", 0, [("u1", 3, 3), ("u2", 2, 2)])  # a replay of a covered batch
    after = [("u1", 1, 2), ("u2", 2, 2), ("u3", 1, 1), ("u4", 5, 2)]
    assert log_of(spark, out) == after
    view, *_ = A._log_view(spark, out)
    read = {tuple(r) for r in view.select(A.RUN, A.BATCH).distinct().collect()}
    assert len(read) == 2 and ("r1", 2) in read
    with monkeypatch.context() as m:  # broken off before its commit
        m.setattr(A, "commit", lambda *_: False)
        assert not A.compact_annotation_log(spark, out, ["V1"])
    assert log_of(spark, out) == after
    assert A.compact_annotation_log(spark, out, ["V1"]) and log_of(spark, out) == after


def test_a_batch_that_is_being_written_is_left_for_later(spark, tmp_path):
    out = str(tmp_path / "log")
    batch(spark, out, "r1", 0, [("u1", 2, 1)])
    batch(spark, out, "r1", 1, [("u1", 1, 3)])
    (tmp_path / "log" / "run_id=r1" / "batch_id=1" / "_SUCCESS").unlink()
    assert A.compact_annotation_log(spark, out, ["V1"])
    assert latest_commit(spark, f"{out}/{A.COMPACTIONS}")[1]["covered"] == {"r1": 0}
    assert log_of(spark, out) == [("u1", 1, 3)]
