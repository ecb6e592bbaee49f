import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import udfs
from pulsegrid.config import Config
from pulsegrid.operators import relational as R
from pulsegrid.operators import search, vectors
from pulsegrid.plans import ingest, scoring, serving
from pulsegrid.schema import evolve, reset, struct
from pulsegrid.sources import feeds, lists

NOW = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_accelerations_by_hand(spark):
    def course(gaps):
        """Arrivals so many minutes before now."""
        return [(i, NOW - timedelta(minutes=m)) for i, m in enumerate(gaps)]

    cases = {1: course([0, 1, 2, 3]), 2: course([0, 1, 2, 30, 60]), 3: course([0, 20, 30, 40, 50]), 4: course([0] * 5), 5: course(range(16)), 6: course([0, 0, 0] + [100] * 12 + [9000])}
    df = spark.createDataFrame([(100 * k + i, k, t) for k, v in cases.items() for i, t in v], "id long, trend_id long, timestamp timestamp_ntz")
    got = dict(rows(R.accelerations(df)))
    # four are too few; a sixteenth arrival is not looked at
    assert got == {1: "steady", 2: "up", 3: "steady", 4: "steady", 5: "steady", 6: "up"}


def test_confidences_count_a_null_source(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "a", 3), (1, "a", 3), (2, "b", 1)], "trend_id long, source_name string, source_tier int")
    assert {r.trend_id: (r.sources, r.best_tier) for r in R.confidences(df).collect()} == {1: (2, 3), 2: (1, 1)}


def test_unseen(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)], "k string, n int")
    old = spark.createDataFrame([("a",), (None,)], "k string")
    got = rows(R.unseen(new, old, "k"))
    assert len(got) == 3 and {r[0] for r in got} == {"b", None}


def test_upsert_and_settings(spark):
    old, new = spark.createDataFrame([(1, 2, "x"), (2, 1, "y")], "k int, n int, t string"), spark.createDataFrame([(2, 5), (3, 1)], "k int, n int")
    merge = {"n": F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0)), "k": F.coalesce("n.k", "o.k")}
    assert rows(R.upsert(old, new, "k", merge)) == [(1, 2, "x"), (2, 6, "y"), (3, 1, None)]
    s = spark.createDataFrame([(1, "a", "1.5", NOW), (2, "b", "zz", NOW)], "id long, key string, value string, updated_at timestamp_ntz")
    later = spark.createDataFrame([(3, "a", "2.5", NOW + timedelta(days=1))], s.schema)
    put = R.put_settings(s, later)
    assert [R.setting(put, k, 35.0).first()[0] for k in ("a", "b", "c")] == [2.5, 35.0, 35.0]


def test_unique_slugs_second_pass(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-1"), (4, "y")], "id long, slug string")
    got = {r.id: r.unique_slug for r in R.unique_slugs(df, "slug", "id").collect()}
    assert got[1] == "x" and got[3] == "x-1" and got[4] == "y" and len(set(got.values())) == 4


def test_history_and_padding(spark):
    df = spark.createDataFrame([(i, t, NOW - timedelta(minutes=m)) for i, (t, m) in enumerate([(1, 1), (1, 2), (1, 11), (2, 3), (3, 3000)])], "id long, trend_id long, timestamp timestamp_ntz")
    h = serving.history(df, "2024-01-01 00:00:00")
    assert rows(h.select("trend_id", "label", "n", "total")) == [(1, "23:45", 1, 1), (1, "23:55", 2, 3), (2, "23:55", 1, 1)]
    assert (2, "", 0) in rows(serving.zero_padded(h))


TRENDS = "id long, title string, summary string, category string, final_tps double, score double, message_count int, slug string, cluster_id string, last_updated timestamp_ntz, first_seen timestamp_ntz, is_active boolean, needs_scoring boolean"


def trend(i, title="t", tps=50.0, hours=1.0, active=True, **more):
    at = NOW - timedelta(hours=hours)
    own = {"summary": None, "category": "Spor", "score": 1.0, "message_count": 0, "slug": None, "cluster_id": f"c{i}", "needs_scoring": False} | more
    return (i, title, own["summary"], own["category"], tps, own["score"], own["message_count"], own["slug"], own["cluster_id"], at, at, active, own["needs_scoring"])


def test_hot_edges(spark):
    t = spark.createDataFrame([trend(1), trend(2, None), trend(3, "günlük BURÇ"), trend(4, tps=None), trend(5, hours=24), trend(6, hours=24.01), trend(7, active=False), trend(8, tps=0.0)], TRENDS)
    news = spark.createDataFrame([(1, 1, "a", NOW), (2, 1, "b", NOW + timedelta(1)), (3, 6, "z", NOW)], "id long, trend_id long, source_name string, published_at timestamp_ntz")
    got = serving.hot(t, news, "2024-01-01 00:00:00").collect()
    # a null score comes first; no title, a hidden word, age or closure keep a trend out
    assert {r.id for r in got} == {1, 4, 5, 8} and {r.id: r.source for r in got} == {1: "b", 4: "Bilinmiyor", 5: "Bilinmiyor", 8: "Bilinmiyor"}
    assert {r.id: r.score for r in got}[8] == 1.0 and {r.message_count for r in got} == {1}
    first = serving.timeline(t, news).collect()
    assert 2 in {r.id for r in first} and len(serving.timeline(t, news, date="no date").collect()) == len(first) and serving.timeline(t, news, date="2024-1-2").count() == 0


def test_decay_edges(spark):
    t = spark.createDataFrame([trend(1, tps=10.0, hours=2), trend(2, tps=10.0, hours=59 / 60), trend(3, tps=3.0, hours=100), trend(4, tps=3.1, hours=1, category="Spor"), trend(5, tps=3.1, hours=10), trend(6, tps=10.0, hours=2, active=False)], TRENDS)
    from pulsegrid.functions import lexicons as L

    got = {r.id: (round(r.new_tps, 4), r.is_active) for r in scoring.decay(t, "2024-01-01 00:00:00", L.DECAY, L.DECAY_OTHER).collect()}
    assert got == {1: (7.225, True), 2: (10.0, True), 3: (3.0, True), 4: (2.635, True), 5: (round(3.1 * 0.85**10, 4), False), 6: (10.0, False)}


def test_queues_and_resolution(spark):
    t = spark.createDataFrame([trend(1, needs_scoring=True), trend(2, tps=19.9), trend(3, summary=""), trend(4, summary="done"), trend(5, slug="7"), trend(6, slug="c1")], TRENDS)
    assert [r.id for r in serving.scoring_queue(t).collect()] == [1]
    assert {r.id for r in serving.summary_queue(t).collect()} == {1, 3, 5, 6}
    i = spark.createDataFrame([("1-old",), ("3",), ("7",), ("c6",), ("c1",), ("99-c2",)], "identifier string")
    assert dict(rows(serving.resolved(i, t))) == {"1-old": 1, "3": 3, "7": None, "c6": 6, "c1": 1, "99-c2": None}


def test_model_scores(spark):
    df = spark.createDataFrame([(1, '{"entity_score": 70, "is_opinion": true}'), (2, "broken"), (3, None)], "trend_id long, response string")
    assert rows(scoring.model_scores(df)) == [(1, 70.0, 30.0, True), (2, 30.0, 30.0, False), (3, 30.0, 30.0, False)]


def test_lists(spark, tmp_path):
    p = tmp_path / "sources.txt"
    p.write_text("Format: source_name,url\n\n# no\n a , http://x?a,b \nb,1\nb,2\nnothing\n@chan\n")
    assert rows(lists.source_list(lists.lines(spark, str(p)))) == [("Format: source_name", "url"), ("a", "http://x?a,b"), ("b", "2")]
    q = tmp_path / "channels.txt"
    q.write_text("@one\none\n two \n#x\n@\n")
    assert rows(lists.channel_list(lists.lines(spark, str(q)))) == [("one",), ("two",)]
    log = spark.createDataFrame([("2024", 1, "m", 1000, 100, 0.5, "Spor", "Success", None)], struct("log"))
    lists.write_log(log, str(tmp_path / "log"))
    assert lists.monitor_log(spark, str(tmp_path / "log")).first().cost_usd == "0.00010500" and lists.monitor_log(spark, str(tmp_path / "none")).count() == 0
    names = spark.createDataFrame([(1, "models/gemini-pro"), (2, "g-1.5-flash"), (3, "g-2-flash-lite"), (4, "flash-image-lite")], "place int, name string")
    assert lists.best_model(names, "x").first()[0] == "g-2-flash-lite" and lists.best_model(names.filter("place = 1"), "x").first()[0] == "x"


def test_feeds(spark):
    spark.dataSource.register(feeds.FeedSource)
    rss = "<rss><channel><item><title>a title of some length here</title><description>and more</description><link>u</link></item><item><title>short</title></item></channel></rss>"
    got = feeds.items(spark.read.format("feed").option("feed.x", rss).load()).collect()
    assert [tuple(r) for r in got] == [("x", "a title of some length here. and more", "u")]


def test_schema(spark):
    df = spark.createDataFrame([(1, "x", 5)], "id long, title string, gone int")
    out = evolve(df, struct("trends"))
    assert out.schema.names == struct("trends").names and out.first().trajectory == "steady" and out.first().message_count == 1
    assert reset(out).first().title is None
    assert Config.read({"TRENDS_ALERT_AT": "5"}) == Config(alert_at=5.0)


def unit(rng, n, d=8):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_nearest_blocks_and_sql_agree(spark):
    m = unit(np.random.default_rng(0), 60)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>").repartition(3)
    want = {i: [int(j) for j in np.argsort(1 - m @ m[i]) if j != i][:4] for i in range(60)}
    for found in (vectors.nearest(df, df, 4), vectors.nearest(df, df, 4, block=17), vectors.nearest_sql(df, df, 4)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert vectors.nearest(df.limit(0), df, 4).count() == 0


def test_indexed_recall(spark):
    from pulsegrid import queries
    from pulsegrid.sources import fixtures

    sf = "/root/testdata/sf0.01"
    v = fixtures.vectors(spark, sf)
    exact = {(r.query_id, r.id) for r in vectors.nearest(v, v, 5).collect()}
    rows = queries.knn_indexed(spark, sf).collect()
    assert len(exact & {(r.query_id, r.id) for r in rows}) / len(exact) >= 0.9
    assert {r.query_id for r in rows} == {r.id for r in v.collect()} and max(r.rank for r in rows) == 5


def test_indexed_equal_vectors_share_a_cell(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vectors.indexed_nearest(df, df, 2, cells=2, probes=2, block=7).collect()
    assert sorted((r.id for r in got if r.query_id == 50)) == [0, 1] and len(got) == 126
    assert vectors.indexed_nearest(df.limit(0), df.limit(0), 2, cells=2, probes=1).count() == 0


def replay(items, auto, far, hours=48, k=5):
    """Leader clustering one item at a time, as the definition says."""
    seen, out, reference = [], [], {}
    for i, v, t, text in sorted(items, key=lambda x: (x[2], x[0])):
        near = sorted(((float(1 - np.dot(w, v)), c) for _, w, s, c in seen if s >= t - hours * 3600), key=lambda x: x)[:k]
        chosen, looked = None, set()
        for d, c in near:
            if c in looked or d > far:
                continue
            looked.add(c)
            if d < auto or vectors.shared_words(reference[c], text):
                chosen = c
                break
        if chosen is None:
            chosen = i
            reference[i] = text
        seen.append((i, v, t, chosen))
        out.append((i, chosen, chosen != i))
    return sorted(out)


def test_leader_clusters_equal_a_replay(spark):
    rng = np.random.default_rng(5)
    centres = unit(rng, 6)
    m = centres[rng.integers(0, 6, 120)] + 0.25 * rng.normal(size=(120, 8))
    m = np.float32(m / np.linalg.norm(m, axis=1, keepdims=True))
    items = [(i, m[i].astype(float), float(rng.integers(0, 200) * 3600), rng.choice(["a b c", "a b d", "x y z"])) for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist(), t, str(d)) for i, v, t, d in items], "id long, embedding array<float>, ts double, document string")
    want = sorted(replay(items, 0.07, 0.42), key=repr)
    for batches in (1, 3):
        assert rows(vectors.leader_clusters(df, batches=batches)) == want
    assert any(dup for *_, dup in want) and len({c for _, c, _ in want}) > 6


def test_resolve_of_a_large_batch(spark):
    """With copies, and more live rows than one could look at one by one for each item."""
    rng = np.random.default_rng(6)
    m = np.float32(unit(rng, 8000)).astype(float)
    m[4000:] = m[rng.integers(0, 400, 4000)]
    items = [(i, m[i], float(i * 30), "a b" if i % 2 else "c d") for i in range(8000)]
    frame = lambda own: pd.DataFrame([(i, v, t, d, None) for i, v, t, d in own], columns=["id", "embedding", "ts", "document", "near"])
    small = vectors.resolve(frame(items[3900:4400]), vectors.shared_words, 0.05, 0.3, 2, 5)
    assert sorted(small.itertuples(index=False, name=None)) == replay(items[3900:4400], 0.05, 0.3, hours=2)
    start = time.perf_counter()
    got = vectors.resolve(frame(items), vectors.shared_words, 0.05, 0.3, 48, 5)
    assert time.perf_counter() - start < 20 and len(got) == 8000 and got["is_duplicate"].any()


def test_search(spark):
    df = spark.createDataFrame([("Evlerimizden haberler ve spor",), ("ev",), (None,)], "t string")
    assert [r[0] for r in df.select(search.matches(F.col("t"), "spor ve Haberler")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(search.matches_stemmed(F.col("t"), "haber")).collect()] == [True, False, False]
    assert search.stem("haberlerden") == "haber" and search.stem("ev") == "ev"


def test_udfs_and_ingest(spark):
    docs = spark.createDataFrame([(1, "u1", "a first report of the same event here. More."), (2, "u2", "a first report of the same event here"), (3, "u1", "seen before, long enough to count as text"), (4, "", "<b>tiny</b>")], "id long, external_id string, content string")
    got = ingest.prepared(docs, spark.createDataFrame([("u2",)], "external_id string"))
    assert got.count() == 1 and got.first().external_id == "u1"
    assert udfs.embed_one("") == [0.0] * 64 and abs(np.linalg.norm(udfs.embed_one("a b c")) - 1) < 1e-9
    e = docs.select(udfs.summary("content").alias("s"), udfs.same_event("content", "content").alias("m")).collect()
    assert e[0].s == "a first report of the same event here." and all(r.m for r in e)
    state = spark.createDataFrame([], vectors.STATE)
    out = ingest.clustered(docs.filter("id < 3").select("id", F.col("content").alias("document"), F.lit(0.0).alias("ts")), state)
    assert {r.cluster_id for r in out.collect()} == {1}


def test_feed_files_in_batch_and_as_a_stream(spark, tmp_path):
    from pulsegrid.streaming import jobs

    rss = "<rss><channel>{}</channel></rss>"
    item = "<item><title>title &amp; more of feed {0} number {1}</title><description>a description</description><link>x/{0}{1}</link></item>"
    for name in "ab":
        (tmp_path / f"{name}.xml").write_text(rss.format("".join(item.format(name, i) for i in range(3))))
    (tmp_path / "broken.xml").write_text("<rss><channel><item>")
    (tmp_path / "empty.xml").write_text("")
    want = sorted((n, f"title & more of feed {n} number {i}. a description", f"x/{n}{i}") for n in "ab" for i in range(3))
    assert sorted(map(tuple, feeds.items(feeds.polled(spark.read, str(tmp_path))).collect())) == want
    at = str(tmp_path / "job")
    jobs.start(feeds.items(feeds.polled(spark.readStream, str(tmp_path))), at).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{at}/table").collect())) == want


def test_detail_page_has_related_active_trends(spark):
    from datetime import datetime

    from pulsegrid.plans import serving, upkeep

    t = spark.createDataFrame([(i, f"c{i}", f"s{i}", f"t{i}", i != 3) for i in range(1, 5)], "id long, cluster_id string, slug string, title string, is_active boolean")
    news = spark.createDataFrame([(1, 1, "n", "<p>text</p>", "x", datetime(2024, 1, 1))], "id long, trend_id long, source_name string, content string, external_id string, published_at timestamp_ntz")
    found = spark.createDataFrame([(1, "c2", 2), (1, "c3", 1), (1, "c4", 3), (1, "c1", 4)], "query_id long, cluster_id string, rank int")
    got = {r.id: r for r in serving.detail_page(news, found, t).collect()}
    assert [r.title for r in got[1].related] == ["t2", "t4"] and got[1].news_list[0].content == "text" and got[2].related is None and len(got) == 4
    ids = spark.createDataFrame([(1,), (1,), (3,), (9,)], "id long")
    assert {r.id: r.is_active for r in upkeep.toggled(t, ids).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r.id: r.is_active for r in upkeep.deactivated(t, ids).collect()} == {1: False, 2: True, 3: False, 4: True}
    empty, counts = upkeep.deleted(trends=t, news=news)
    assert empty["trends"].count() == 0 and empty["news"].schema == news.schema and {r.name: r.deleted for r in counts.collect()} == {"trends": 4, "news": 1}


def test_sitemap_document_in_order(spark, sf):
    from pulsegrid.functions import lexicons as L
    from pulsegrid.plans import serving
    from pulsegrid.sources import fixtures

    lines = [r.line for r in serving.sitemap_document(fixtures.trends(spark, sf), "https://x.org", limit=20).orderBy("place").collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</urlset>" and len(lines) == 24 + len(L.CATEGORIES)
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring("\n".join(lines).encode())) == 21 + len(L.CATEGORIES)
    own = [r.line for r in serving.sitemap(fixtures.trends(spark, sf), "https://x.org", limit=20).collect()]
    assert lines[3 + len(L.CATEGORIES) : -1] == own


def test_numbered_counts_within_hot_groups(spark):
    from pulsegrid.tables import numbered

    rows = [("hot" if i % 3 else None, i) for i in range(500)] + [(f"x{i}", i) for i in range(50)]
    got = numbered(spark.createDataFrame(rows, "g string, id long"), "g", "id", "n", "test").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.id):
        by.setdefault(r.g, []).append(r.n)
    assert all(v == list(range(len(v))) for v in by.values()) and len(got) == 550


def test_published_stems():
    """Worked examples of the published description of the algorithm, and words that its rules leave alone."""
    from pulsegrid.functions.turkish import stem

    for word, want in {"kedileriyle": "kedi", "çocuğuymuşumcasına": "çocuk", "doktoruymuşsunuz": "doktor", "çocuklarımmış": "çocuk", "kitabımızdı": "kitap", "kalelerimizdekilerden": "kale", "ağacı": "ağaç", "ağaç": "ağaç", "haberlerden": "haber",
                       "kitapları": "kitap", "evlerinde": "ev", "okulda": "okul", "ev": "ev", "ad": "ad", "soyad": "soyad"}.items():
        got = stem(word)
        assert got == want, (word, got)


def test_index_against_the_stems_of_each_text(spark, tmp_path):
    import random

    from pulsegrid.operators import index
    from pulsegrid.plans import serving

    rng = random.Random(2)
    words = "kitap kitaplar kitabı kitapta Okul okulda OKULLAR İstanbul ISPARTA ev evler ve bu çocuk çocuğu x1 été".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(300)] + [(300, None), (301, ""), (302, "kitap " * 2000), (None, "kitap okul")]
    docs = spark.createDataFrame(rows, "id long, Term string")
    made = index.build(docs, "id", "Term", str(tmp_path / "stems"), buckets=7)
    for q in ("kitaplarda okullar", "İstanbul", "bu ve", "", "çocuğun evi kitap", "yok kitap", "ISPARTA"):
        wanted = set(search.stems_of(q))
        want = sorted((k for k, t in rows if wanted and wanted <= set(search.stems_of(t))), key=lambda k: (k is None, k or 0))
        got = sorted((r.key for r in index.find(spark, made, q).collect()), key=lambda k: (k is None, k or 0))
        assert got == want, q
    assert len(index.find(spark, made, "kitaplar").collect()) > 50
    # only the buckets and terms asked for are read
    scan = index.find(spark, made, "kitap okul")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PushedFilters: [In(term" in scan
    asked = spark.createDataFrame([(1, "kitaplarda okullar"), (2, "bu"), (3, "evin")], "q long, t string")
    got = {(r.query_id, r.key) for r in index.find_all(made, asked, "q", "t").collect()}
    assert got == {(q, k) for q, t in ((1, "kitaplarda okullar"), (3, "evin")) for k in (r.key for r in index.find(spark, made, t).collect())}
    trends = docs.selectExpr("id", "Term as title", "true as is_active", "timestamp_ntz'2024-01-01' as last_updated").filter("id IS NOT NULL")
    by_index, by_text = ({r.id for r in serving.listed(trends, query="okulda kitap", index=i).collect()} for i in (made, None))
    assert by_index == by_text and len(by_index) > 10


def test_which_duplicate_stays_and_names_that_clash(spark):
    rows = spark.createDataFrame([("k", f"v{i}", i) for i in range(8)], "key string, _at string, _n int")
    none = spark.createDataFrame([], "key string")
    kept = [R.unseen(rows.repartition(n, "_n"), none, "key").collect() for n in (1, 3, 8)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1
    got = R.unique_slugs(rows.withColumn("_Taken", F.lit("t")), "key", "_n")
    assert sorted((r._n, r["_at"], r["_Taken"], r.unique_slug) for r in got.collect()) == [(i, f"v{i}", "t", "k" if not i else f"k-{i}") for i in range(8)]


def test_blocks_follow_the_values_of_vectors(spark, monkeypatch):
    """An index is written once, with the cells beside each vector, and a cell that fits one block isn't cut for the cores that other cells keep busy."""
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(unit(rng, 2400, 8))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    written, keep = [], vectors.new_path
    monkeypatch.setattr(vectors, "new_path", lambda s, n: written.append(keep(s, n)) or written[-1])
    monkeypatch.setattr(vectors, "kept", lambda *_: pytest.fail("the same vectors are written twice"))
    found = {}
    for name, values in (("one block", 1 << 22), ("blocks of 90", 8 * 90)):
        monkeypatch.setattr(vectors, "VALUES", values)
        got = vectors.indexed_nearest(df, df, 3, cells=4, probes=3)
        found[name] = sorted((r.query_id, r.rank, r.id) for r in got.collect())
    stored = spark.read.parquet(written[0])
    assert stored.count() == 2400 and {len(r.cells) for r in stored.collect()} == {3}
    assert found["one block"] == found["blocks of 90"] and len(found["one block"]) == 7200
    m = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    cells = {r.id: list(r.cells) for r in stored.collect()}
    own = np.array([cells[i][0] for i in range(2400)])
    for i in range(0, 2400, 97):
        d = 1 - m @ m[i]
        d[~np.isin(own, cells[i])] = d[i] = np.inf
        assert [x for q, _, x in found["one block"] if q == i] == np.lexsort((np.arange(2400), d))[:3].tolist()
