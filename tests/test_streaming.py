import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from pulsegrid.operators import vectors
from pulsegrid.streaming import jobs

NOW = datetime(2024, 1, 1)
SCHEMA = "id long, trend_id long, timestamp timestamp_ntz"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Three files, to be taken one at a time."""
    rows = [(i, i % 3, NOW + timedelta(minutes=7 * i)) for i in range(30)] + [(5, 2, NOW + timedelta(minutes=300))]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    df = spark.createDataFrame(rows, SCHEMA)
    return df, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_upsert_equals_batch(arrivals):
    from pulsegrid.plans.scoring import rollup

    df, stream = arrivals
    got = jobs.ingested(stream()).drop("needs_scoring")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rollup(df).collect()))


def test_history_equals_batch(arrivals):
    from pulsegrid.plans.serving import history

    df, stream = arrivals
    want = history(df, "2024-01-01 12:00:00", hours=48).select("trend_id", "bucket", "n", "total")
    assert sorted(map(tuple, jobs.history(stream()).collect())) == sorted(map(tuple, want.collect()))


def test_dedup(arrivals):
    df, stream = arrivals
    got = jobs.deduplicated(stream(), "id", "timestamp")
    assert got.count() == 30 and df.count() == 31


def test_clusters_follow_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 8))
    m[20:] = m[:20] + 0.02 * rng.normal(size=(20, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    schema = "id long, embedding array<float>, ts double, document string"
    rows = [(i, m[i].tolist(), float(i), "d") for i in range(40)]
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r.id: r.cluster_id for r in jobs.clustered(stream, far=0.07).collect()}
    want = {r.id: r.cluster_id for r in vectors.leader_clusters(spark.createDataFrame(rows, schema), far=0.07).collect()}
    assert got == want and all(got[i + 20] == got[i] for i in range(20))


def parts(spark, path, rows):
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_file_stream_reads_files_and_folders_alike(spark, tmp_path):
    rows = [(i, i % 3, NOW + timedelta(minutes=i)) for i in range(30)]
    parts(spark, str(tmp_path / "a/events.parquet"), rows)
    parts(spark, str(tmp_path / "a/other.parquet"), rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "b"))
    next((tmp_path / "b").glob("part-*.parquet")).rename(tmp_path / "b/events.parquet")
    for folder in ("a", "b"):
        stream = jobs.file_stream(spark, str(tmp_path / folder), "events", SCHEMA, files=1)
        assert sorted(map(tuple, jobs.deduplicated(stream, "id", "timestamp").collect())) == rows


def test_a_repeated_batch_counts_once(spark, tmp_path):
    log = jobs.trend_log(spark, str(tmp_path))
    one = spark.createDataFrame([(1, 2, NOW, NOW, True)], jobs.TRENDS)
    for batch_id in (0, 0, 1, 1, 0):
        log.put(one, batch_id)
    assert [r.message_count for r in log.table().collect()] == [4]
    assert [r.message_count for r in log.table(1).collect()] == [2] and log.table(0).count() == 0


def test_folded_batches_are_not_counted_again(spark, tmp_path):
    log = jobs.trend_log(spark, str(tmp_path))
    log.every = 2
    for batch_id in range(5):
        log.put(spark.createDataFrame([(1, 1, NOW, NOW, True), (batch_id, 1, NOW, NOW, True)], jobs.TRENDS), batch_id)
    log.put(spark.createDataFrame([(1, 1, NOW, NOW, True), (3, 1, NOW, NOW, True)], jobs.TRENDS), 3)
    assert {r.trend_id: r.message_count for r in log.table().collect()} == {0: 1, 1: 6, 2: 1, 3: 1, 4: 1}


def test_a_folding_batch_repeated_with_other_rows(spark, tmp_path):
    log = jobs.trend_log(spark, str(tmp_path))
    log.every = 2
    one = lambda n: spark.createDataFrame([(1, n, NOW, NOW, True)], jobs.TRENDS)
    log.put(one(1), 0)
    log.put(one(1), 1)
    log.put(one(5), 1)
    assert [r.message_count for r in log.table().collect()] == [6]


def test_a_log_stays_small(spark, tmp_path):
    log = jobs.trend_log(spark, str(tmp_path))
    log.every = 3
    one = spark.createDataFrame([(1, 1, NOW, NOW, True)], jobs.TRENDS).coalesce(1)
    for batch_id in range(24):
        log.put(one, batch_id)
    assert [r.message_count for r in log.table().collect()] == [24]
    assert len(list((tmp_path / "log/upto").iterdir())) <= 2 and len(list((tmp_path / "log/batch").iterdir())) <= 6


def test_days(spark, tmp_path):
    schema = "id long, at timestamp_ntz"
    days = jobs.Days(spark, str(tmp_path), schema, jobs.F.col("at"))
    row = lambda k, day: (k, NOW + timedelta(days=day) if day is not None else None)
    days.put(spark.createDataFrame([row(1, 0), row(2, 3)], schema), 0)
    days.put(spark.createDataFrame([row(3, 3), row(4, 4), row(5, None)], schema), 1)
    days.put(spark.createDataFrame([row(6, 3), row(5, None)], schema), 1)  # repeated with other rows, none of the fourth day
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(days.table()) == [1, 2, 5, 6] and ids(days.table(1)) == [1, 2] and ids(days.table(0)) == []
    late = days.table(since=(NOW + timedelta(days=2)).date())
    assert ids(late) == [2, 5, 6] and not any("2024-01-01" in f for f in late.inputFiles())
    (tmp_path / "last/1").rename(tmp_path / "last/0")  # as if batch 1 had not come to its end
    assert ids(days.table()) == [1, 2]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(i, i % 3, NOW + timedelta(minutes=7 * i)) for i in range(30)]
    path, at = str(tmp_path / "in"), str(tmp_path / "job")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    for k in range(2):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], SCHEMA).repartition(2).write.mode("append").parquet(path)
        got = {r.trend_id: r.message_count for r in jobs.ingested(stream(), at).collect()}
        assert got == {j: 5 * (k + 1) for j in range(3)}
        buckets = jobs.history(stream(), at + "-history").collect()
        assert sum(r.n for r in buckets) == 15 * (k + 1)


def test_rows_later_than_48_hours_are_left_out(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "job")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    for k, days in enumerate((10, 9, 5)):  # newest first, then one day late, then five
        spark.createDataFrame([(k, 1, NOW + timedelta(days=days))], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        jobs.history(stream(), at)
    assert sorted(r.bucket.day for r in jobs.history(stream(), at).collect()) == [10, 11]


def test_clock_runs_an_action(spark, tmp_path):
    runs = []
    q = jobs.clock(spark, runs.append, str(tmp_path / "clock"), every="1 second")
    for _ in range(100):
        if len(runs) > 1:
            break
        time.sleep(0.2)
    q.stop()
    assert runs[:2] == [0, 1]


ITEMS = "source_type string, source_name string, external_id string, content string, published_at timestamp_ntz"


def test_ingest_as_a_whole(spark, tmp_path):
    story = "the harbour bridge was closed this morning after a lorry hit its northern pillar"
    other = "a small observatory in the hills has found water vapour around a distant planet"
    item = lambda x, text, m: ("rss", "s", x, text, NOW + timedelta(minutes=m))
    batches = [
        [item("a", story, 0), item("b", other, 1), item("a", story, 2), item("c", "too short", 3)],
        [item("a", story, 10), item("d", story + " today", 11), item("e", other, 12)],
    ]
    path, at = str(tmp_path / "in"), str(tmp_path / "job")
    stream = lambda: spark.readStream.schema(ITEMS).parquet(path)
    for rows in batches:
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(path)
        jobs.ingest_job(stream(), at, far=0.6).awaitTermination()
    tables = jobs.Ingest(spark, at)
    state = lambda: {n: sorted((tuple(r) for r in getattr(tables, n).table().collect()), key=repr) for n in ("news", "arrivals", "vectors", "trends")}
    before = state()
    assert [len(before[n]) for n in ("news", "arrivals", "vectors", "trends")] == [4, 4, 4, 2]
    assert sorted(r.message_count for r in tables.trends.table().collect()) == [2, 2]
    titles = {r.title for r in tables.trends.table().collect()}
    assert titles == {story[:70].strip() + "...", other[:70].strip() + "..."}
    # the last batch once more, as after a failure between its writes
    tables.step(spark.createDataFrame(batches[1], ITEMS), 1, far=0.6)
    assert state() == before
