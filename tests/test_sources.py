"""Delimited files in many tasks against Python's own reader, the data source, and connectors."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from plumbline.sources import connectors, rowcsv, splits


def written_file(path, rows, delimiter=",", end="\n", encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        out = csv.writer(f, delimiter=delimiter, lineterminator=end)
        out.writerow(["id", "text", "more"])
        out.writerows(rows)
    return str(path)


def drawn(seed, n):
    r = random.Random(seed)
    bits = ["a", "word ", '"', '""', "\n", ",", "\r\n", ";", "é", " ", "x" * 30, '",\n"', ""]
    rows = []
    for k in range(n):
        row = [str(k), "".join(r.choice(bits) for _ in range(r.randrange(9))), "".join(r.choice(bits) for _ in range(r.randrange(4)))]
        rows.append(row + ["too", "long"][: r.choice([0, 0, 0, 0, 1, 2])] if r.random() < 0.3 else row)
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_scan_of_ranges(tmp_path, seed):
    """Ranges of any size give the records, wide ones and places that one reader gives."""
    path = written_file(tmp_path / "a.csv", drawn(seed, 300), end=["\n", "\r\n"][seed % 2])
    whole = [r for r in csv.reader(io.StringIO(open(path, encoding="utf-8", newline="").read(), newline="")) if r]
    size = splits.size_of(path)
    for step in (7, 50, 333, 4000, size):
        found = [(min(size, at + step), *splits.scan(path, at, min(size, at + step), "utf-8", ",", 3)) for at in range(0, size, step)]
        parts, n, wide, first = splits.follow(found, lambda at: len(next(splits.records(path, at, at + 1, "utf-8", ","), [])), 3)
        assert n == len(whole) and wide == sum(len(r) > 3 for r in whole)
        assert first == [[i, len(r)] for i, r in enumerate(whole) if len(r) > 3][:20]
        got = []
        for begin, stop, before in parts:
            assert before == len(got)
            got += splits.records(path, begin, stop, "utf-8", ",")
        assert got == whole


def test_unclosed_quote_and_no_quotes(tmp_path):
    for text, n in (('id,text,more\n1,"open\n2,b,c\n3,d', 2), ("id,text,more\n" + "1,b,c\n" * 500, 501), ('id,text,more\n1,"' + "long\n" * 400 + '",x\n2,y,z', 3), ("id,text,more\n\n\n1,2,3\n\n", 2)):
        path = tmp_path / "b.csv"
        path.write_text(text)
        whole = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        size = len(text)
        for step in (5, 64, 1000):
            found = [(min(size, at + step), *splits.scan(str(path), at, min(size, at + step), "utf-8", ",", 3)) for at in range(0, size, step)]
            parts, total, _, _ = splits.follow(found, lambda at: len(next(splits.records(str(path), at, at + 1, "utf-8", ","), [])), 3)
            assert total == n == len(whole)
            assert [r for b, s, _ in parts for r in splits.records(str(path), b, s, "utf-8", ",")] == whole


def test_one_file_in_many_tasks(spark, tmp_path):
    rows = drawn(9, 3000)
    path = written_file(tmp_path / "big.csv", rows)
    whole = [r for r in csv.reader(io.StringIO(open(path, encoding="utf-8", newline="").read(), newline="")) if r][1:]
    got = rowcsv.read_csv(spark, path, range_bytes=4000)
    assert got.df.rdd.getNumPartitions() > 10
    want = [(k + 2, r) for k, r in enumerate(whole) if len(r) <= 3]
    have = got.df.orderBy("__row__").collect()
    assert [r["__row__"] for r in have] == [k for k, _ in want]
    assert [r["id"] for r in have] == [r[0] for _, r in want]
    assert got.records == len(whole) and got.dropped() == len(whole) - len(want)
    first = next(k for k, r in enumerate(whole) if len(r) > 3)
    assert len(got.messages) == min(20, got.dropped()) and got.messages[0] == f"record {first + 2} of big.csv: {len(whole[first])} cells, expected 3"
    alone = rowcsv.read_csv(spark, path, whole=True)
    assert alone.dropped() == got.dropped() and alone.df.exceptAll(got.df).count() == got.df.exceptAll(alone.df).count() == 0


def test_folder_and_encodings(spark, tmp_path):
    for k in range(3):
        written_file(tmp_path / f"p{k}.csv", [[f"{k}-{i}", "é", "x"] for i in range(5)], encoding="cp1252")
    (tmp_path / "_SUCCESS").write_text("")
    got = rowcsv.read_csv(spark, str(tmp_path), range_bytes=20)
    rows = got.df.orderBy("__row__").collect()
    assert [r["__row__"] for r in rows] == list(range(2, 17)) and [r["id"] for r in rows] == [f"{k}-{i}" for k in range(3) for i in range(5)]
    assert got.records == 15 and {r["text"] for r in rows} == {"é"}
    path = written_file(tmp_path / "wide.txt", [["1", "ü\nü", ""]], encoding="utf-16")
    assert [tuple(r) for r in rowcsv.read_csv(spark, path, range_bytes=4).df.collect()] == [(2, "1", "ü\nü", None)]
    mac = tmp_path / "mac.csv"
    mac.write_bytes(b"id,text,more\r1,2,3\r4,5,6\r")
    assert rowcsv.read_csv(spark, str(mac), range_bytes=4).df.count() == 2
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        rowcsv.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match=r"\.csv"):
        rowcsv.read_csv(spark, str(tmp_path / "none.xlsx"))


def test_empty_files_of_a_folder(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("")
    written_file(tmp_path / "part-1.csv", [[str(i), "x", "y"] for i in range(5)])
    (tmp_path / "part-2.csv").write_text("")
    written_file(tmp_path / "part-3.csv", [["5", "x", "y"], ["6", "x", "y", "one too many"]])
    got = rowcsv.read_csv(spark, str(tmp_path), range_bytes=20)
    assert [(r["__row__"], r["id"]) for r in got.df.orderBy("__row__").collect()] == [(k + 2, str(k)) for k in range(6)]
    assert got.records == 7 and got.dropped() == 1
    spark.dataSource.register(rowcsv.RowCsv)
    assert spark.read.format("rowcsv").load(str(tmp_path)).select("id").count() == 6
    whole = rowcsv.read_csv(spark, str(tmp_path), whole=True)
    assert whole.records == 7 and whole.dropped() == 1 and whole.df.columns == got.df.columns
    for k in (1, 3):
        (tmp_path / f"part-{k}.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        rowcsv.read_csv(spark, str(tmp_path))


def test_data_source(spark, tmp_path, monkeypatch):
    path = written_file(tmp_path / "c.csv", [[str(k), ["x", "", "yz"][k % 3], f"m{k}"] for k in range(100)])
    spark.dataSource.register(rowcsv.RowCsv)
    df = spark.read.format("rowcsv").load(path)
    assert df.columns == ["__row__", "id", "text", "more"] and df.count() == 100
    fewer = spark.read.format("rowcsv").schema("text string, id string").load(path)
    assert fewer.columns == ["text", "id"] and fewer.where("id = '4'").first()["text"] is None
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("rowcsv").option("pushdown", "true").load(path).where("text = 'yz' and more like 'm1%' and id is not null and length(id) = 2")
        plan = pushed._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in pushed.collect()) == [str(k) for k in range(10, 20) if k % 3 == 2]
        print(plan)
        assert "length(id" in plan and " = yz" not in plan
        assert spark.read.format("rowcsv").option("pushdown", "true").load(path).where("text is null").count() == 33
        assert spark.read.format("rowcsv").option("pushdown", "true").load(path).where("id in ('1', '2') or id = '3'").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no column"):
        spark.read.format("rowcsv").schema("other string").load(path).collect()


def counting():
    """A second source, added without touching the library (made here so that workers need no test module)."""

    class Counting(DataSource):
        @classmethod
        def name(cls):
            return "counting"

        def schema(self):
            return "__row__ long, word string"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from ((k, f"w{k}") for k in range(5))

            return Reader()

    return Counting


def test_connectors(spark, tmp_path):
    @connectors.connector("counting")
    class Numbers:
        closed = []

        def __init__(self, spark):
            spark.dataSource.register(counting())
            self.spark = spark

        def objects(self):
            return [connectors.SourceObject("n", "Numbers"), connectors.SourceObject("bad", "Bad")]

        def read(self, name):
            if name == "bad":
                raise connectors.SourceError("limit", "try again later")
            return self.spark.read.format("counting").load()

        def close(self, reason):
            self.closed.append(reason)

    try:
        seen = []
        got = dict(connectors.datasets(connectors.connect(spark, "counting"), ["n", "bad", "none"], lambda share, what: seen.append(what)))
        assert got["n"].count() == 5 and got["bad"].code == "limit" and got["none"].code == "unknown_object"
        assert Numbers.closed == ["finished"] and seen[:2] == ["Numbers", "Bad"]
        assert list(connectors.datasets(connectors.connect(spark, "counting"), ["n"], cancelled=lambda: True)) == [] and Numbers.closed[-1] == "cancelled"
        early = connectors.datasets(connectors.connect(spark, "counting"), ["n", "bad"])
        next(early)
        early.close()
        assert Numbers.closed[-1] == "cancelled"
        with pytest.raises(connectors.SourceError, match="at most"):
            list(connectors.datasets(connectors.connect(spark, "counting"), map(str, range(99))))
        with pytest.raises(ValueError, match="exists"):
            connectors.connector("counting")(Numbers)
    finally:
        del connectors.CONNECTORS["counting"]
    with pytest.raises(connectors.SourceError, match="no source"):
        connectors.connect(spark, "counting")
    written_file(tmp_path / "one.csv", [["1", "2", "3"]])
    (tmp_path / "two.csv").write_text("")
    spark.range(3).coalesce(1).withColumn("x", F.lit("y")).toPandas().to_parquet(tmp_path / "three.parquet")
    got = dict(connectors.datasets(connectors.connect(spark, "files", path=str(tmp_path)), ["one", "two", "three"]))
    assert got["one"].count() == 1 and got["three"].count() == 3 and got["two"].code == "unreadable"
