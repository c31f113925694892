import os
import time

import pytest
from pyspark.sql import functions as F

from harborline.session import written
from harborline.sources import batches, intake
from registry import catalog
from test_store import files


def test_intake_takes_only_new_and_changed_files(spark, tmp_path):
    folder, corpus = tmp_path / "up", str(tmp_path / "corpus")
    (folder / "deep er").mkdir(parents=True)
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "deep er" / "b ä.md").write_text("# bé")
    (folder / "copy.txt").write_text("one\ntwo")
    (folder / "c.pdf").write_text("no")
    (folder / "empty.md").write_text("")
    (folder / "bad.txt").write_bytes(b"x\xff")
    assert intake.ingest(spark, str(folder), corpus) == 4
    found = {r.content: r.source for r in intake.documents(spark, corpus).collect()}
    assert found == {"one\ntwo": "a.txt", "# bé": "b ä.md", "x�": "bad.txt"}
    before = files(f"{corpus}/documents")
    assert intake.ingest(spark, str(folder), corpus) == 0 and files(f"{corpus}/documents") == before
    (folder / "a.txt").write_text("one\ntwo\nthree")
    (folder / "new.md").write_text("# bé")
    assert intake.ingest(spark, str(folder), corpus) == 2
    found = {r.content: r.source for r in intake.documents(spark, corpus).collect()}
    assert len(found) == 4 and found["one\ntwo\nthree"] == "a.txt" and found["# bé"] == "new.md"


def test_intake_looks_at_no_file_before_its_mark(spark, tmp_path):
    folder, corpus = tmp_path / "up", str(tmp_path / "corpus")
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    os.utime(folder / "a.txt", (1_700_000_000, 1_700_000_000))
    assert intake.ingest(spark, str(folder), corpus) == 1
    for name, at in (("old.txt", 1_700_000_000 - 7200), ("late.txt", 1_700_000_000 - 1800)):
        (folder / name).write_text(name)
        os.utime(folder / name, (at, at))
    assert intake.ingest(spark, str(folder), corpus) == 1
    assert {r.source for r in intake.documents(spark, corpus).collect()} == {"a.txt", "late.txt"}


def test_intake_opens_no_file_that_it_has_taken(spark, tmp_path):
    folder, corpus, then = tmp_path / "up", str(tmp_path / "corpus"), time.time() - 600
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    os.utime(folder / "a.txt", (then, then))
    assert intake.ingest(spark, str(folder), corpus) == 1
    (folder / ".a.txt.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")  # whoever opens a.txt now fails
    assert intake.ingest(spark, str(folder), corpus) == 0
    (folder / "b.txt").write_text("b")
    assert intake.ingest(spark, str(folder), corpus) == 1
    assert {r.content for r in intake.documents(spark, corpus).collect()} == {"a", "b"}


def test_uploads_are_a_file_each_in_few_folders(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, "no id"), (900, None), (901, ""), (902, "one"), (902, "two")]
    catalog._uploaded(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), str(tmp_path / "up"))
    found = list((tmp_path / "up").rglob("*.txt"))
    assert sorted(f.read_text() for f in found) == sorted([f"text {i}\n" for i in range(300)] + ["no id\n", "\n", "\n", "one\ntwo\n"])
    assert len({f.parent for f in found}) <= catalog.SHELVES


def test_uploads_have_no_checksum_files_beside_them(spark, tmp_path):
    catalog._uploaded(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string"), str(tmp_path / "up"))
    assert len(list((tmp_path / "up").rglob("*.txt"))) == 20 and not list((tmp_path / "up").rglob("*.crc"))


def test_names_of_many_files_are_compared_in_few_tasks(spark, tmp_path, monkeypatch):
    folder, corpus, tasks = tmp_path / "up", str(tmp_path / "corpus"), []
    folder.mkdir()
    (folder / "first.txt").write_text("first")
    assert intake.ingest(spark, str(folder), corpus) == 1
    for i in range(40):
        (folder / f"{i}.txt").write_text(f"text {i}")
    monkeypatch.setattr(intake, "NAME_TASKS", 2)
    monkeypatch.setattr(intake, "written", lambda df, name: tasks.append((name, df.rdd.getNumPartitions())) or written(df, name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        assert intake.ingest(spark, str(folder), corpus) == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert dict(tasks)["new-keys"] <= 2 < dict(tasks)["new-files"]


def test_intake_of_an_empty_folder(spark, tmp_path):
    assert intake.ingest(spark, str(tmp_path), str(tmp_path / "corpus")) == 0


def test_ended_job_goes_on_at_the_next_batch(spark, tmp_path):
    staged, out = str(tmp_path / "staged"), str(tmp_path / "out")
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"))
    batches.stage(rows, staged, 8)

    def breaks(part):
        return part.withColumn("text", F.when(F.col("batch") >= 4, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))

    with pytest.raises(Exception, match="lost"):
        batches.run(spark, staged, out, breaks, at_once=2)
    assert batches.finished(spark, out) == {0, 1, 2, 3}
    before = files(f"{out}/rows")
    assert batches.run(spark, staged, out, lambda part: part, at_once=3, most=1) == [4]
    assert batches.run(spark, staged, out, lambda part: part, at_once=3) == [5, 6, 7]
    after = files(f"{out}/rows")
    assert all(after[name] == before[name] for name in (f"batch={n}" for n in range(4)))
    done = spark.read.parquet(f"{out}/rows")
    assert done.count() == 500 and done.select("id").distinct().count() == 500
    assert batches.run(spark, staged, out, breaks) == [] and files(f"{out}/rows") == after


def test_batches_are_staged_without_a_shuffle(spark, tmp_path):
    batches.stage(spark.range(600).repartition(3).select(F.col("id").cast("string").alias("id")), str(tmp_path / "staged"), 2)
    assert {name: len(found) for name, found in files(str(tmp_path / "staged")).items()} == {"batch=0": 3, "batch=1": 3}


def test_a_batch_left_half_written_is_replaced(spark, tmp_path):
    staged, out = str(tmp_path / "staged"), str(tmp_path / "out")
    batches.stage(spark.range(40).select(F.col("id").cast("string").alias("id")), staged, 2)
    spark.read.parquet(staged).where("batch = 1").limit(3).write.partitionBy("batch").parquet(f"{out}/rows")
    assert batches.run(spark, staged, out, lambda part: part) == [0, 1]
    assert spark.read.parquet(f"{out}/rows").count() == 40
