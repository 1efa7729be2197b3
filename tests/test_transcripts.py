from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillstream.sources import transcripts
from quillstream.streaming import windows


@pytest.fixture
def folder(tmp_path):
    for number, (path, text) in enumerate([("a/1.md", b"=== H ===\nhi"), ("a/b/2.jsonl", b'{"role": "user", "content": "yo"}'), ("3.txt", b"=== Human ===\nplain \xff end"), ("4.md", b""), ("a/_tmp/5.md", b"hidden"), (".6.md", b"hidden")]):
        file = tmp_path / "in" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text)
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return tmp_path / "in"


def reader(spark):
    return transcripts.registered(spark).read.format(transcripts.NAME)


def test_files_are_rows(spark, folder):
    rows = {r["path"]: r for r in reader(spark).load(str(folder)).collect()}
    assert set(rows) == {"a/1.md", "a/b/2.jsonl", "3.txt", "4.md"}
    assert rows["3.txt"]["text"] == "=== Human ===\nplain � end" and rows["4.md"]["text"] == "" and rows["a/1.md"]["size"] == 12
    assert rows["a/1.md"]["modified"].timestamp() == 1_700_000_000
    assert {r["path"] for r in reader(spark).option("pathGlob", "*.md").load(f"file://{folder}").collect()} == {"a/1.md", "4.md"}


@pytest.mark.parametrize("size, groups", [(1, 4), (46, 2), (1 << 20, 1)])
def test_a_group_of_files_is_a_partition(spark, folder, size, groups):
    found = reader(spark).option("groupBytes", size).load(str(folder))
    assert found.rdd.getNumPartitions() == groups and found.count() == 4


@pytest.mark.parametrize("count, groups", [(1, 4), (3, 2), (10_000, 1)])
def test_a_group_has_few_files(spark, folder, count, groups):
    found = reader(spark).option("groupFiles", count).load(str(folder))
    assert found.rdd.getNumPartitions() == groups and found.count() == 4


def test_texts_are_handed_on_in_small_batches(folder, monkeypatch):
    """However many bytes a group has, a task holds those of one batch."""
    monkeypatch.setattr(transcripts, "BATCH_BYTES", 20)
    files = transcripts.listed(str(folder), "*")
    found = list(transcripts.BatchReader({"path": str(folder)}).read(transcripts.Group(tuple(files))))
    assert [b.num_rows for b in found] == [2, 1, 1] and [p for b in found for p in b.column("path").to_pylist()] == [f.path for f in files]


def test_segments_of_all_formats(spark, folder):
    found = {(r["path"], r["speaker"], r["content"]) for r in transcripts.segments(reader(spark).load(str(folder))).collect()}
    assert {("a/1.md", "human", "hi"), ("a/b/2.jsonl", "human", "yo"), ("3.txt", "human", "plain � end")} <= found


def test_no_files(spark, tmp_path):
    assert reader(spark).load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path"):
        reader(spark).load().count()


def test_stream_takes_up_where_it_stopped(spark, folder, tmp_path):
    """Files that arrive between runs come once; a changed file comes again; committed ones move to the archive."""
    seen, state = [], str(tmp_path / "state")

    def run(**options):
        stream = transcripts.registered(spark).readStream.format(transcripts.NAME).options(**options).load(str(folder))
        batch = []
        query = stream.select("path").writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: batch.extend(r["path"] for r in df.collect())).start()
        query.awaitTermination()
        seen.append(sorted(batch))

    run()
    run()
    (folder / "7.md").write_text("new")
    (folder / "4.md").write_text("changed")
    run()
    assert seen == [["3.txt", "4.md", "a/1.md", "a/b/2.jsonl"], [], ["4.md", "7.md"]]


def test_stream_archives_what_is_committed(spark, folder, tmp_path):
    stream = transcripts.registered(spark).readStream.format(transcripts.NAME).option("archive", str(tmp_path / "done")).load(str(folder))
    found = windows.drained(stream.select("path", F.length("text").alias("n")), str(tmp_path), "append")
    assert {r["path"] for r in found.collect()} == {"a/1.md", "a/b/2.jsonl", "3.txt", "4.md"}
    (folder / "8.md").write_text("later")
    again = transcripts.registered(spark).readStream.format(transcripts.NAME).load(str(folder))
    assert "8.md" in {r["path"] for r in windows.drained(again.select("path"), str(tmp_path), "append").collect()}
