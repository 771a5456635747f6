import gzip
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from tessella.sources import files, stores
from tessella.streaming import pulses


def test_catalogue_and_patterns(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a_1.txt", "b_2.txt", ".hidden"):
        (tmp_path / "d" / name).write_text(name)
    (tmp_path / "top.txt").write_text("x")
    found = files.catalogue(spark, str(tmp_path), "*.txt", hashes=True)
    assert sorted((r.name, r.size) for r in found.collect()) == [("a_1.txt", 7), ("b_2.txt", 7), ("top.txt", 1)]
    matched = files.matching(found, str(tmp_path) + "/d/{name}_{n}.txt")
    assert matched.count() == 2
    assert found.where(files.visible(F.col("path"), str(tmp_path))).count() == 2


def test_lines_and_archives(spark, tmp_path):
    with gzip.open(tmp_path / "x.txt.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [(r.n, r.text) for r in files.lines(spark, str(tmp_path / "x.txt.gz")).orderBy("n").collect()] == [(0, "one"), (1, "two")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m1", "1")
        z.writestr("m2", "2")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "z.zip", "in/z.zip")
    assert sorted((r.path.rsplit("/", 1)[1], r.n, r.member) for r in files.archive_members(spark, str(tmp_path)).collect()) == [("t.tar.gz", 0, "in/z.zip"), ("z.zip", 0, "m1"), ("z.zip", 1, "m2")]


def test_notebook(spark, tmp_path):
    cells = [{"cell_type": "markdown", "metadata": {}, "source": ["# t"]}, {"cell_type": "code", "metadata": {"kernel": "A"}, "source": ["x = 1\n", "y"]}, {"cell_type": "code", "metadata": {"kernel": "B"}, "source": "z"}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}))
    assert [(r.ord, r.source) for r in files.notebook_cells(spark, str(tmp_path / "n.ipynb")).orderBy("ord").collect()] == [(1, "x = 1\ny"), (2, "z")]
    assert files.notebook_cells(spark, str(tmp_path / "n.ipynb"), "A").count() == 1


def test_pulses_and_fastq(spark, tmp_path):
    (tmp_path / "t1.pulse").write_text("#ts\tcpu\n10.5\t1.5\t100\t2\t0.5\t50\n11.5\t2.5\t200\t2\t0\t0\n")
    assert [(r.task_id, r.cpu, r.mem) for r in files.pulses(spark, str(tmp_path / "t1.pulse")).orderBy("ts").collect()] == [("t1", 1.5, 100), ("t1", 2.5, 200)]
    (tmp_path / "w.pulse").write_text("#12.0\tstatus\trunning\n1\t2\n#bad\n")
    assert [(r.ts, r.key, r.value) for r in files.workflow_events(spark, str(tmp_path / "w.pulse")).collect()] == [(12.0, "status", "running")]
    (tmp_path / "r.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n##\n")
    assert sorted((r.id, r.seq, r.qual) for r in files.fastq(spark, str(tmp_path / "r.fastq")).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "##")]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert files.csv(spark, str(tmp_path / "c.csv")).dtypes == [("a", "int"), ("b", "string")]


def test_store_and_reports(spark, tmp_path):
    store = stores.AppendStore(spark, str(tmp_path / "s"), "k", "v")
    store.append(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"))
    store.append(spark.createDataFrame([(1, 2, "c")], "k int, v int, x string"))
    assert sorted((r.k, r.x) for r in store.current().collect()) == [(1, "c"), (2, "b")]
    assert store.log().count() == 3 and store.get(2).first().x == "b"
    store.purge(spark.createDataFrame([(1,)], "k int"), str(tmp_path / "left"))
    assert spark.read.parquet(str(tmp_path / "left")).count() == 1
    parts = spark.createDataFrame([(2, "two"), (1, "one")], "n int, text string")
    stores.report(parts, str(tmp_path / "r"), ["n"])
    stores.report(parts, str(tmp_path / "r"), ["n"], append=True)
    assert spark.read.text(str(tmp_path / "r")).count() == 4
    assert "<td>&lt;x&gt;</td>" in stores.html_report([{"id": "<x>"}])


def run_stream(spark, tmp_path, batches, schema, make, name):
    source = tmp_path / f"{name}-in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    stream = pulses.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source)))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


SCHEMA = "task_id long, ts timestamp, cpu double, mem long, status string"


def at(s):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_streams(spark, tmp_path):
    rows = [[(1, at(0), 0.5, 10, "pending"), (2, at(1), 9.0, 10, "pending")], [(1, at(100), 0.5, 99, "completed"), (1, at(90), 1.0, 1, "submitted")], [(1, at(500), 0.1, 1, "completed")], [(3, at(900), 0.1, 1, "pending")]]
    found = run_stream(spark, tmp_path, rows, SCHEMA, lambda s: pulses.alarms(s, 5.0, 50), "alarms")
    assert sorted((r[0], r[2], r[3]) for r in found) == [(1, "mem", 99.0), (2, "cpu", 9.0)]
    found = run_stream(spark, tmp_path, rows, SCHEMA, lambda s: pulses.overdue(s, 95), "overdue")
    assert [(r[0], r[2]) for r in found] == [(1, 100.0)]
    found = run_stream(spark, tmp_path, rows, SCHEMA, pulses.transitions, "transitions")
    assert sorted(r[2:] for r in found if r[0] == 1) == [("new", "pending", True), ("pending", "submitted", True), ("submitted", "completed", True)]
    found = run_stream(spark, tmp_path, rows, SCHEMA, lambda s: pulses.silent(s, 60), "silent")
    assert (2, at(1)) in [(r[0], r[1]) for r in found]
    found = run_stream(spark, tmp_path, rows, SCHEMA, lambda s: pulses.windowed(s, "1 minute", ["task_id"]), "windows")
    assert (at(0), 1, 1) in found and (at(60), 1, 2) in found
