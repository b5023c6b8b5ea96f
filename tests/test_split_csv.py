"""CSV in byte ranges: equal to the whole-file reader wherever the cuts fall."""

import csv
import io
import random

import pytest

from ratergrid.plans import REGISTRY, ingestion
from ratergrid.plans.studies import write_reports
from ratergrid.sources import scan_csv, scan_csv_split

SCHEMA = "a string, b string, n int"


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def made(rng, n):
    pieces = ["x", "yz ", '"', '""', "\n", "\n\n", ",", "é漢", "", "long text without any break " * 3]
    return [("".join(rng.choice(pieces) for _ in range(rng.randrange(6))), "".join(rng.choice(pieces) for _ in range(rng.randrange(3))),
             rng.choice(["1", "22", "no", ""])) for _ in range(n)]


def written(rows, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", "extra", "b", "n"])
    writer.writerows([(a, "e", b, n) for a, b, n in rows])
    return out.getvalue()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_ranges, seed, end):
    rng = random.Random(seed)
    data = [made(rng, 120), made(rng, 3)]
    for i, rows in enumerate(data):
        (tmp_path / f"f{i}.csv").write_text(written(rows, end), newline="")
    got = scan_csv_split(spark, str(tmp_path), schema=SCHEMA)
    assert got.rdd.getNumPartitions() >= 1
    want = [(a or None, b or None, int(n) if n.isdigit() else None) for rows in data for a, b, n in rows]
    assert rows_of(got) == sorted(want, key=str)
    assert rows_of(got) == rows_of(scan_csv(spark, str(tmp_path), schema=SCHEMA))


def test_records_longer_than_ranges_and_odd_files(spark, tmp_path, small_ranges):
    long = ('line "quoted" and, more\n' * 40) + "end"
    (tmp_path / "a.csv").write_text(written([(long, "x", "1"), ("", "", ""), ("last", long, "2")], "\n"))
    (tmp_path / "b.csv").write_text("a,extra,b,n\n\n\nq,w,e,3")
    got = rows_of(scan_csv_split(spark, str(tmp_path), schema=SCHEMA))
    assert got == sorted([(long, "x", 1), (None, None, None), ("last", long, 2), ("q", "e", 3)], key=str)
    (tmp_path / "c.csv").write_text("b,a,extra,n\n1,2,3,4\n")
    with pytest.raises(Exception, match="header"):
        scan_csv_split(spark, str(tmp_path), schema=SCHEMA).collect()


def test_many_tasks_read_one_file(spark, tmp_path, small_ranges):
    (tmp_path / "one.csv").write_text(written([(f"a\n{i}", "b", str(i)) for i in range(300)], "\n"))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    got = scan_csv_split(spark, str(tmp_path / "one.csv"), schema=SCHEMA, required=["a"])
    assert rows_of(got) == sorted([(f"a\n{i}", "b", i) for i in range(300)], key=str)
    with pytest.raises(ValueError, match="missing|csv"):
        scan_csv_split(spark, str(tmp_path), schema="zzz string")


def test_the_query_writes_in_many_tasks_and_reads_ranges(spark, tmp_path, small_ranges, monkeypatch):
    rows = [(i, f'line "{i}",\nand the next one', "en", "web", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(6).write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(ingestion, "scratch_path", lambda _, label: f"{tmp_path}/{label}")
    got = REGISTRY["scan_csv_split"].run(spark, f"{tmp_path}/sf").select("tweet_id", "post_type", "text")
    assert rows_of(got) == sorted([(str(i), source, text) for i, text, _, source, _ in rows], key=str)
    files = list((tmp_path / "csv").glob("part-*.csv"))
    assert len(files) >= 6 and spark.read.text(f"{tmp_path}/csv").rdd.getNumPartitions() > len(files)


def test_reports_with_a_row_per_post_are_written_in_many_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).selectExpr("CAST(id AS STRING) AS unit_id")
    write_reports({"missing_ids": rows, "invalid_rows": rows, "summary": rows}, str(tmp_path))
    assert [len(list((tmp_path / n).glob("part-*"))) for n in ("missing_ids", "invalid_rows", "summary")] == [4, 4, 1]
    assert scan_csv(spark, f"{tmp_path}/missing_ids", schema="unit_id int").selectExpr("sum(unit_id)").first()[0] == 780
