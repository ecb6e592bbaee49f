"""Model calls, the summariser, tables of which a write touches some parts only, served lists, the watch over channels, counters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid import models
from pulsegrid.plans import summaries
from pulsegrid.schema import evolve, struct
from pulsegrid.streaming import snapshots, workers
from pulsegrid.streaming.snapshots import Snapshot, served

NOW = "2024-01-02 00:00:00"


def picky():
    """Fails as a whole where one text says so, so that halves have to be asked again."""

    def run(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    return run


def test_a_failing_item_costs_its_own_answer(spark):
    rows = [(i, None if i == 3 else "" if i == 4 else f"bad {i}" if i % 7 == 0 else f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = {r.id: r.a for r in df.select("id", models.answers(F.col("text"), picky).alias("a")).collect()}
    assert got == {i: None if not t or "bad" in t else t.upper() for i, t in rows}
    assert models.tried(lambda texts: texts[:1], ["a", "b", "c"]) == ["a", "b", "c"]  # too few answers are no answers


@pytest.mark.parametrize("answer, want", [
    ('{"headline": "H", "category": "Spor"}', ("H", None, "Spor", None)), ('[{"headline": "H"}, {"headline": "I"}]', ("H", None, None, None)),
    ('{"is_relevant_to_turkey": false}', (None, None, None, False)), ("{}", None), ("[]", None), ("no json", None), (None, None),
])
def test_answers_are_read(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(summaries.read_answer(F.col("a")).alias("x")).first().x
    assert (got if want is None else tuple(got)[:4]) == want


def one_by_one(new, taken):
    """The first free number for each row in turn, in one order of rows a base."""
    have, out = set(taken), {}
    for id_, base, _ in sorted(new, key=lambda r: r[2]):
        n = 0
        while (s := base if n == 0 else f"{base}-{n}") in have:
            n += 1
        have.add(s)
        out[id_] = s
    return out


def test_free_slugs_fill_gaps(spark):
    taken = ["a", "a-1", "a-3", "a-4", "a-x", "b-1", "b-007", "c-", "d-2", "ab-1", "a-1", "f-9999999999999999999"]
    bases = ["a", "b", "c", "d", "e", "f"]
    new = [(i, bases[i * 7 % 6], 100 - i) for i in range(40)]
    got = summaries.free_slugs(spark.createDataFrame(new, "id long, base string, order long"), spark.createDataFrame([(t,) for t in taken], "slug string"))
    assert {r.id: r.slug for r in got.collect()} == one_by_one(new, taken)


def test_slugs_of_two_bases_that_meet_and_null_bases(spark):
    new = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a-1", 3), (4, None, 4)], "id long, base string, order long")
    got = {r.id: r.slug for r in summaries.free_slugs(new, spark.createDataFrame([], "slug string")).collect()}
    assert got == {1: "a", 2: "a-1", 3: "a-1-3", 4: None}
    assert summaries.free_slugs(new.limit(0), new.select(F.col("base").alias("slug"))).count() == 0


def trends_of(spark, rows):
    return evolve(spark.createDataFrame(rows, "id long, slug string, title string, final_tps double, summary string"), struct("trends")).withColumn("last_updated", F.lit("2024-01-01").cast("timestamp_ntz"))


def talkative():
    by = {"- one": "no json", "- two": json.dumps({"headline": "Yeni Haber", "summary": "S", "category": "Spor", "input_tokens": 8}), "- three": json.dumps({"headline": "X", "is_relevant_to_turkey": False}), "- four": json.dumps([{"summary": "only a summary"}])}
    return lambda texts: [by[t] for t in texts]


def test_summariser(spark):
    """Read answers publish, others close the trend; one without news waits, a weak one and one with a summary aren't asked."""
    t = trends_of(spark, [(1, "s1", "t1", 90.0, None), (2, "s2", "t2", 80.0, ""), (3, "s3", "t3", 70.0, None), (4, "s4", "Eski Ad", 30.0, None), (5, "s5", "t5", 60.0, None), (6, "s6", "t6", 10.0, None), (7, "yeni-haber", "t7", 99.0, "done"), (8, "s8", None, None, None)])
    news = spark.createDataFrame([(1, 1, "one"), (2, 2, "two"), (3, 3, "three"), (4, 4, "four"), (5, 6, "six"), (6, 7, "seven")], "id long, trend_id long, content string")
    got = summaries.summarised(t, news, lambda c: models.answers(c, talkative), NOW, limit=20, base_url="b", publish_at=50)
    rows = {r.id: r for r in got.changes.collect()}
    assert set(rows) == {1, 2, 3, 4} and {i: r.is_active for i, r in rows.items()} == {1: False, 2: True, 3: False, 4: True}
    assert (rows[2].title, rows[2].summary, rows[2].category, rows[2].slug, str(rows[2].last_updated)) == ("Yeni Haber", "S", "Spor", "yeni-haber-1", NOW)
    assert (rows[4].title, rows[4].summary, rows[4].slug) == ("Eski Ad", "only a summary", "eski-ad") and (rows[3].title, rows[3].slug, str(rows[3].last_updated)) == ("t3", "s3", "2024-01-01 00:00:00")
    assert [(r.id, r.url) for r in got.posts.collect()] == [(2, "b/trend/yeni-haber-1")] and sorted(r.id for r in got.notices.collect()) == [2, 4]
    assert {(r.trend_id, r.input_tokens, r.output_tokens, r.cost_usd) for r in got.log.collect()} == {(2, 8, 0, "0.00000060"), (4, 0, 0, "0.00000000")}
    empty = summaries.summarised(t.limit(0), news, lambda c: models.answers(c, talkative), NOW)
    assert empty.changes.count() == empty.posts.count() == empty.log.count() == 0


def test_an_empty_slug_is_not_taken(spark):
    """Headlines without a letter of a slug get the empty one, then -1, whatever trends outside the pass have no slug."""
    t = trends_of(spark, [(1, "", "t1", 90.0, "done"), (2, "s2", "t2", 80.0, None), (3, "s3", "t3", 70.0, None)])
    news = spark.createDataFrame([(1, 2, "Èê Èê"), (2, 3, "Èê Èê")], "id long, trend_id long, content string")
    got = summaries.summarised(t, news, lambda c: models.answers(c, lambda: lambda texts: ['{"headline": "Èê Èê", "is_relevant_to_turkey": true}' for _ in texts]), NOW, limit=None)
    assert {r.id: r.slug for r in got.changes.collect()} == {2: "", 3: "-1"}


SCHEMA = "id long, x string"


def files(top):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{top}/data") for f in fs if f.endswith(".parquet")}


def test_a_write_touches_its_parts_only(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, parts=8)
    assert s.table().count() == 0 and s.done() is None
    s.put(spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], SCHEMA), -1)
    before = files(s.top)
    s.put(spark.createDataFrame([(5, "b"), (1000, "b"), (None, "m")], SCHEMA), 0)
    changed = {f.split("_part=")[1].split("/")[0] for f in files(s.top) - before}
    assert before <= files(s.top) and 1 <= len(changed) <= 3
    want = {i: "b" if i == 5 else "a" for i in range(200)} | {1000: "b", None: "m"}
    rows = s.table().collect()
    assert len(rows) == 202 and {r.id: r.x for r in rows} == want
    assert s.table(0).count() == 201 and {r.x for r in s.table(0).collect()} == {"a", "n"}
    assert [r.x for r in s.of(spark.createDataFrame([(5,), (77777,)], "id long")).collect()] == ["b"]


def test_a_write_that_is_repeated_replaces_its_own(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, parts=4)
    s.put(spark.createDataFrame([(i, "a") for i in range(20)], SCHEMA), -1)
    s.put(spark.createDataFrame([(1, "b"), (2, "b")], SCHEMA), 0)
    s.put(spark.createDataFrame([(2, "c"), (2, "c")], SCHEMA), 0)
    assert {r.id: r.x for r in s.table().collect()} == {i: "c" if i == 2 else "a" for i in range(20)} and s.table().count() == 20
    s.put(spark.createDataFrame([], SCHEMA), 1)
    assert s.done() == 1 and s.table().count() == 20
    for n in range(2, 7):
        s.put(spark.createDataFrame([(1, str(n))], SCHEMA), n)
    assert s.table().filter("id = 1").first().x == "6" and max(len(os.listdir(f"{s.top}/data/{p}")) for p in os.listdir(f"{s.top}/data") if p.startswith("_part")) <= 2


def test_a_write_that_broke_off_isnt_read(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, parts=2)
    s.put(spark.createDataFrame([(1, "a")], SCHEMA), -1)
    spark.createDataFrame([(1, "z")], SCHEMA).withColumns({"_part": s.part, "_at": F.lit(0)}).write.mode("append").partitionBy("_part", "_at").parquet(f"{s.top}/data")
    assert [r.x for r in s.table().collect()] == ["a"]
    s.put(spark.createDataFrame([(1, "b")], SCHEMA), 0)
    assert [r.x for r in s.table().collect()] == ["b"]


@pytest.mark.parametrize("few", [0, 10_000])
def test_a_write_in_place_and_one_by_a_shuffle_agree(spark, tmp_path, monkeypatch, few):
    """Changes are made once, whichever way they go; of equal keys one stays; the session's settings are as before."""
    monkeypatch.setattr(snapshots, "FEW", few)
    monkeypatch.setattr(snapshots, "ROWS", 40)
    s, made = Snapshot(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, parts=4), spark.sparkContext.accumulator(0)
    s.put(spark.createDataFrame([(i, "a") for i in range(500)] + [(None, "n")], SCHEMA), -1)
    was, stored = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"), len(files(s.top))

    def count(rows):
        for r in rows:
            made.add(1)
            yield r

    def change(rows):
        return spark.createDataFrame(spark.createDataFrame(rows, SCHEMA).rdd.mapPartitions(count), SCHEMA)

    s.put(change([(i, None if i == 9 else "b") for i in range(0, 500, 3)] + [(None, "m"), (3, "b")]), 0)
    want = {i: None if i == 9 else "b" if i % 3 == 0 else "a" for i in range(500)} | {None: "m"}
    got = s.table().collect()
    assert made.value == 169 and len(got) == 501 and {r.id: r.x for r in got} == want
    s.put(change([(3, "c"), (3, "d"), (900, "new")]), 1)
    got = {r.id: r.x for r in s.table().collect()}
    assert made.value == 172 and s.table().count() == 502 and got.pop(3) in ("c", "d") and got == {k: v for k, v in want.items() if k != 3} | {900: "new"}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == was
    for n in range(2, 6):
        s.put(spark.createDataFrame([(i, str(n)) for i in range(0, 500, 50)], SCHEMA), n)
    per_part = [len([f for f in files(s.top) if f"/{p}/_at=5/" in f]) for p in os.listdir(f"{s.top}/data") if p.startswith("_part")]
    assert max(per_part) <= max(4, stored) and s.table().count() == 502  # files don't grow in number with every pass


def test_news_are_cut_before_they_are_made(spark, sf):
    from pulsegrid import queries
    from pulsegrid.sources import fixtures as X

    waiting = spark.createDataFrame([(1,), (5,), (10**9,)], "trend_id long")
    got = queries.waiting_news(spark, sf)(waiting)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, X.raw_news(spark, sf).filter("trend_id IN (1, 5)").collect()), key=str)


def test_decay_step_counts_in_one_pass(spark, tmp_path):
    t = Snapshot(spark, str(tmp_path / "t"), struct("trends"), parts=4)
    rows = [(1, "a", "t", 50.0, None), (2, "b", "t", 3.5, None), (3, "c", "t", 1.0, None), (4, "d", "t", None, None)]
    t.put(trends_of(spark, rows), -1)
    seen = workers.decay_step(t, 0, NOW, factors={"Gündem": 0.9}, other=0.5)
    got = {r.id: r for r in t.table().collect()}
    assert seen == {"decayed": 2, "archived": 1} and got[1].final_tps == pytest.approx(50 * 0.9**24) == got[1].score and not got[2].is_active
    assert got[3].final_tps == 1.0 and got[3].is_active and got[4].final_tps is None
    assert workers.decay_step(t, 1, "2024-01-01 00:30:00") == {"decayed": 0, "archived": 0}


def test_served_lists_expire(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made), None)], "n int, x string")

    got = [served(spark, str(tmp_path / "s"), make, 120, now=t).first().value for t in (1000, 1119.9, 1120, 1200, 1500)]
    assert [json.loads(g) for g in got] == [{"n": n, "x": None} for n in (1, 1, 2, 2, 3)] and len(os.listdir(tmp_path / "s")) == 2


def test_channels_are_watched(spark, tmp_path):
    """A list that changes between batches, one channel that can't be joined at first, one that leaves the list, and a batch that runs again."""
    path = tmp_path / "list.txt"
    c = workers.Channels(spark, str(path), str(tmp_path / "job"))
    assert c.watch(0).count() == 0  # no list yet
    path.write_text("# a comment\n@one\n\n two@ \nbroken\n")
    names = lambda df: sorted(r.channel for r in df.collect())
    assert names(c.watch(1, lambda new: new.filter("channel <> 'broken'"))) == ["one", "two"]
    path.write_text("two\nbroken\nthree\n")
    asked = []
    assert names(c.watch(2, lambda new: asked.append(names(new)) or new)) == ["broken", "one", "three", "two"] == names(c.watch(2))
    assert asked == [["broken", "three"]] and names(c.watch(3)) == ["broken", "one", "three", "two"]


def test_streams_count_by_progress_events(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(30)], "id long").repartition(3).write.parquet(str(tmp_path / "in"))
    counters = workers.Counters()
    spark.streams.addListener(counters)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("polled", F.count(F.lit(1)).alias("items"), F.count_if(F.col("id") >= 20).alias("late"))
        q = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if counters.totals.get(("polled", "items")) == 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals == {("polled", "items"): 30, ("polled", "late"): 10}


def test_one_clock_runs_all_steps(spark, tmp_path):
    """Scoring at each tick, summaries at each second, decay at each third; numbers rise by one from step to step."""
    import time

    t = Snapshot(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, parts=2)
    ran = []
    step = lambda name: lambda n: (ran.append((name, n)), t.put(spark.createDataFrame([(1, name)], SCHEMA), n))
    q = workers.worker(t, step("score"), step("decay"), str(tmp_path / "job"), step("summary"), every=1, decay_every=3, summary_every=2)
    try:
        for _ in range(600):
            if "decay" in [n for n, _ in ran]:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert [n for n, _ in ran[:5]] == ["score", "score", "summary", "score", "decay"] and [i for _, i in ran[:5]] == list(range(5))


def test_the_outbox_gets_scores_as_printf_writes_them(spark, tmp_path):
    from pulsegrid.plans.serving import alerts
    from pulsegrid.streaming import outbox

    rows = [(1, "a", 99.25, 0.0, "up"), (2, "b", 99.75, 1.0, "up"), (3, "c", 35.15, None, "down"), (4, "d", 20.05, 2.0, "steady"), (5, "e", 99.25, 30.0, "up")]
    found = alerts(spark.createDataFrame(rows, "id long, title string, final_tps double, previous_tps double, trajectory string")).select("id", "message")
    found.write.parquet(str(tmp_path / "in"))
    outbox.send(spark.readStream.schema(found.schema).parquet(str(tmp_path / "in")), str(tmp_path / "box"), str(tmp_path / "job")).awaitTermination()
    got = dict(map(tuple, outbox.sent(spark, str(tmp_path / "box"), "id long, message string").drop("epoch").collect()))
    assert got == {i: f"{'⏫' if c == 'up' else '🔥'} {t} | {v:.1f} TPS | {c.upper()}" for i, t, v, _, c in rows[:4]}
