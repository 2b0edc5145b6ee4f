import datetime as dt

from tessel.streaming import debounce

SCHEMA = "ts timestamp, project string, file string, content string"


def at(minute, second=0):
    return dt.datetime(2025, 1, 1, 10, minute, second)


def test_bursts_and_refresh(spark, tmp_path):
    source, cache, mark = (str(tmp_path / n) for n in ("in", "cache", "mark"))
    rows = [(at(0), "p", "b.ts", "x"), (at(0, 1), "p", "a.ts", "import './b'"), (at(0, 1), "p", "a.ts", "import './b'"), (at(5), "p", "c.py", "import os"), (at(0), "q", "d.py", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    stream = debounce.change_stream(spark, source, SCHEMA)
    assert stream.isStreaming
    query = debounce.bursts(stream, "2 seconds", "1 second").writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.project, tuple(r.files)) for r in spark.sql("select * from bursts").collect()} == {("p", ("a.ts", "b.ts")), ("p", ("c.py",)), ("q", ("d.py",))}
    for _ in range(2):  # the second run reads a new file with the same content: nothing is extracted again
        query = debounce.refresh(stream, cache, "1").option("checkpointLocation", mark).start()
        query.processAllAvailable()
        query.stop()
        spark.createDataFrame(rows[:2], SCHEMA).write.mode("append").parquet(source)
    assert sorted(r.file for r in spark.read.parquet(cache).collect()) == ["a.ts", "b.ts", "c.py", "d.py"]
    # a change, the old content again, and a change that is late: the latest one holds
    for second, text in ((10, "import './c'"), (20, "import './b'"), (15, "import './d'")):
        spark.createDataFrame([(at(9, second), "p", "a.ts", text)], SCHEMA).write.mode("append").parquet(source)
        query = debounce.refresh(stream, cache, "1").option("checkpointLocation", mark).start()
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(cache)
    assert rows.filter("file = 'a.ts'").count() == 3
    now = {r.file: [i.source for i in r.imports] for r in debounce.current(rows).collect()}
    assert now == {"a.ts": ["./b"], "b.ts": [], "c.py": ["os"], "d.py": []}
    debounce.compact(spark, cache, cache + "2")
    assert spark.read.parquet(cache + "2").count() == 4


def test_windowed_counts(spark):
    df = spark.createDataFrame([(at(0), "p"), (at(1), "p"), (at(7), "p")], "ts timestamp, project string")
    got = sorted((r.start.minute, r.n) for r in debounce.windowed_counts(df, "10 minutes", "5 minutes", "1 minute", "project").collect())
    assert got == [(0, 3), (5, 1), (55, 2)]
