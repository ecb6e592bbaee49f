"""The poll source and the outbox: stopped and resumed, repeated, failed."""

import os
import time

import pytest

from pulsegrid.sources import polls
from pulsegrid.streaming import outbox


def feed(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t} and some more words to be long enough</title><link>{x}</link></item>" for x, t in items) + "</channel></rss>"


def test_polls_stop_resume_and_leave_out_what_was_seen(spark, tmp_path):
    site, at = tmp_path / "site", str(tmp_path / "job")
    site.mkdir()
    (tmp_path / "list.txt").write_text("".join(f"{n},file://{site}/{n}.xml\n" for n in "abc") + "gone,file:///nowhere/at/all\n")
    seen = spark.createDataFrame([("x1",)], "external_id string")

    def poll():
        time.sleep(0.05)
        polls.poll_job(polls.stream(spark, str(tmp_path / "list.txt"), at, every_ms=10, tasks=3), at, seen).awaitTermination()
        return sorted((r.external_id, r.source_name) for r in polls.taken(spark, at).table().collect())

    (site / "a.xml").write_text(feed(("x1", "old"), ("x2", "new")))
    (site / "b.xml").write_text("<rss><not closed")
    (site / "c.xml").write_text(feed(("x3", "third"), ("x3", "third again")))
    assert poll() == [("x2", "a"), ("x3", "c")]
    (site / "b.xml").write_text(feed(("x2", "new"), ("x4", "fourth")))
    (site / "c.xml").unlink()
    assert poll() == [("x2", "a"), ("x3", "c"), ("x4", "b")]
    assert len(os.listdir(f"{at}/archive")) <= 2


def test_a_poll_read_again_gives_what_it_gave(tmp_path):
    (tmp_path / "a.xml").write_text("first")
    (tmp_path / "list").write_text(f"a,file://{tmp_path}/a.xml\nb,file://{tmp_path}/none.xml\n")
    reader = lambda: polls.PollReader({"sources": str(tmp_path / "list"), "archive": str(tmp_path / "archive"), "tasks": "2", "everyms": "1"})
    read = lambda r, a, b: [row for p in r.partitions({"at": a}, {"at": b}) for row in r.read(p)]
    first = read(reader(), 0, 5)
    assert first[0] == ("a", 5, "first", None) and first[1][2] is None and "none.xml" in first[1][3]
    (tmp_path / "a.xml").write_text("second")
    (tmp_path / "none.xml").write_text("there now")
    assert read(reader(), 0, 5) == first  # another process, the same range
    r = reader()
    assert [x[2] for x in read(r, 5, 9)] == ["second", "there now"] and read(r, 9, 9) == []
    r.commit({"at": 9})
    assert os.listdir(tmp_path / "archive") == ["9"]


SCHEMA = "id long, message string"


def test_an_epoch_counts_once_and_an_aborted_one_not_at_all(spark, tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "box")
    w = outbox.OutboxWriter(path)
    rows = lambda *ids: iter([Row(id=i, message=f"ünï {i}\nline") for i in ids])
    w.commit([w.write(rows(1, 2)), w.write(rows()), None], 0)
    w.commit([w.write(rows(1)), w.write(rows(2))], 0)  # repeated
    w.abort([w.write(rows(3)), None], 1)
    w.write(rows(4))  # its task's answer was lost
    w.commit([w.write(rows(5))], 1)
    got = sorted((r.epoch, r.id, r.message) for r in outbox.sent(spark, path, SCHEMA).collect())
    assert got == [(0, 1, "ünï 1\nline"), (0, 2, "ünï 2\nline"), (1, 5, "ünï 5\nline")]
    assert len(os.listdir(f"{path}/messages")) == 3  # two counted, one lost


def test_a_stream_into_the_outbox(spark, tmp_path):
    src, box, at = (str(tmp_path / x) for x in ("in", "box", "job"))
    for k in range(2):
        spark.createDataFrame([(i, f"m{i}") for i in range(10 * k, 10 * k + 10)], SCHEMA).repartition(3).write.mode("append").parquet(src)
        outbox.send(spark.readStream.schema(SCHEMA).parquet(src), box, at).awaitTermination()
    assert sorted(r.id for r in outbox.sent(spark, box, SCHEMA).collect()) == list(range(20))
    bad = spark.readStream.schema(SCHEMA).parquet(src).selectExpr("id", "if(id = 13, raise_error('no'), message) AS message")
    with pytest.raises(Exception, match="no"):
        outbox.send(bad, str(tmp_path / "other"), str(tmp_path / "job2")).awaitTermination()
    assert not os.path.exists(tmp_path / "other/epochs")


def test_feed_files_of_many_lines(spark, tmp_path):
    from pulsegrid.sources import feeds

    (tmp_path / "f.xml").write_text("<rss>\n<channel>\n<item>\n<title>one\ntwo</title>\n</item>\n</channel></rss>")
    assert [(r.source_name, r.title) for r in feeds.polled(spark.read, str(tmp_path)).collect()] == [("f", "one\ntwo")]


def test_a_source_is_fetched_once_a_poll_and_long_lists_get_more_tasks(tmp_path):
    (tmp_path / "list").write_text("".join(f"s{i},{(tmp_path / 'none').as_uri()}\n" * 3 for i in range(1000)))
    reader = polls.PollReader({"sources": str(tmp_path / "list"), "archive": str(tmp_path / "archive"), "tasks": "2", "everyms": "1"})
    shares = reader.partitions({"at": 0}, {"at": 5})
    got = [[name for name, *_ in reader.read(x)] for x in shares]
    assert sorted(sum(got, [])) == sorted(f"s{i}" for i in range(1000)) and max(map(len, got)) <= polls.SHARE
