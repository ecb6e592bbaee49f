"""The engine's queries over the fixture's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import display as D
from .functions import lexicons as L
from .functions import scores as S
from .functions import text as T
from .operators import relational as R
from .operators import index, search, vectors
from .plans import scoring, serving, upkeep
from .schema import evolve, reset, struct
from .sources import fixtures as X
from .sources.lists import channel_list, source_list
from .streaming import jobs, state
from .tables import kept, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRENDS = f"WITH trends AS ({X.TRENDS_SQL})"
NEWS = f"""WITH news AS (SELECT *, CASE WHEN contains(lower(source_name), 'src0') OR contains(lower(source_name), 'src2') THEN 1
  WHEN contains(lower(source_name), 'src3') OR contains(lower(source_name), 'src4') THEN 2 ELSE 3 END AS source_tier FROM ({X.NEWS_SQL}))"""
ARRIVALS = "arrivals AS (SELECT event_id AS id, user_id AS trend_id, ts AS timestamp FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


FOLDED = "lower(translate(coalesce({}, ''), 'İI', 'iı'))"
TRENDS_AND_NEWS = f"{TRENDS}, {NEWS[5:]}"
SHOWN = """SELECT t.id, coalesce(t.id || '-' || nullif(t.slug, ''), t.cluster_id) AS link, coalesce(t.title, '') AS title, coalesce(t.summary, '') AS summary, coalesce(t.category, 'Gündem') AS category,
  round(coalesce(nullif(t.final_tps, 0), t.score), 1) AS score, coalesce(nullif(t.message_count, 0), 1)::INT AS message_count, strftime(t.last_updated, '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
  strftime(t.first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, coalesce((SELECT n.source_name FROM news n WHERE n.trend_id = t.id ORDER BY n.published_at DESC, n.id DESC LIMIT 1), 'Bilinmiyor') AS source FROM x t"""


@query(f"{TRENDS_AND_NEWS}, x AS (SELECT * FROM trends WHERE is_active AND last_updated >= TIMESTAMP '2001-07-03 00:00:00' AND NOT title ILIKE '%furn%' AND NOT title ILIKE '%burç%' ORDER BY final_tps DESC NULLS FIRST, last_updated DESC NULLS FIRST, id LIMIT 8) {SHOWN}")
def hot_trends(spark, sf):
    return serving.hot(X.trends(spark, sf), X.raw_news(spark, sf), X.ORDERS_NOW, hours=30 * 24, hide=["furn", "burç"])


@query(f"{TRENDS_AND_NEWS}, x AS (SELECT * FROM trends WHERE is_active AND category = '1-URGENT' ORDER BY first_seen DESC NULLS FIRST, id LIMIT 32 OFFSET 32) {SHOWN}")
def timeline_page(spark, sf):
    return serving.timeline(X.trends(spark, sf), X.raw_news(spark, sf), offset=32, category="1-URGENT")


@query(f"{TRENDS_AND_NEWS}, x AS (SELECT * FROM trends WHERE is_active AND first_seen >= TIMESTAMP '2001-01-05 00:00:00' ORDER BY first_seen DESC NULLS FIRST, id LIMIT 500) {SHOWN}")
def timeline_date_filter(spark, sf):
    return serving.timeline(X.trends(spark, sf), X.raw_news(spark, sf), limit=500, date="2001-1-5")


@query(f"{NEWS} SELECT trend_id, id, source_name, published_at FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC, id DESC) AS rn FROM news) WHERE rn = 1")
def latest_news_per_trend(spark, sf):
    return R.latest(X.raw_news(spark, sf), "trend_id", ["published_at", "id"], ["id", "source_name", "published_at"])


@query(f"{NEWS} SELECT trend_id, id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC NULLS FIRST, id DESC) AS rn FROM news) WHERE rn <= 20")
def top20_news_per_trend(spark, sf):
    return R.top_of_each(X.raw_news(spark, sf), "trend_id", [F.col("published_at").desc_nulls_first(), F.col("id").desc()], 20).select("trend_id", "id", "rn")


@query(f"{NEWS} SELECT trend_id, string_agg('- ' || left(content, 1000), chr(10) ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY id) AS rn FROM news) WHERE rn <= 15 GROUP BY trend_id")
def news_context_agg(spark, sf):
    return serving.context(X.raw_news(spark, sf))


@query(f"WITH {ARRIVALS} SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS bucket, count(*) AS n FROM arrivals GROUP BY 1")
def history_buckets(spark, sf):
    return R.buckets(X.arrivals(spark, sf))


HISTORY = f"""WITH {ARRIVALS}, h AS (SELECT trend_id, time_bucket(INTERVAL 5 MINUTES, timestamp) AS bucket, count(*) AS n FROM arrivals WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOURS GROUP BY 1, 2),
c AS (SELECT trend_id, bucket, strftime(bucket, '%H:%M') AS label, n, sum(n) OVER (PARTITION BY trend_id ORDER BY bucket)::BIGINT AS total FROM h)"""


@query(f"{HISTORY} SELECT * FROM c")
def history_cumulative(spark, sf):
    return serving.history(X.arrivals(spark, sf), X.EVENTS_NOW, hours=240)


@query(f"{HISTORY.replace('240 HOURS', '20 HOURS')} SELECT trend_id, label, total FROM c UNION ALL SELECT trend_id, '', 0::BIGINT FROM c GROUP BY trend_id HAVING count(*) = 1")
def history_zero_pad(spark, sf):
    return serving.zero_padded(serving.history(X.arrivals(spark, sf), X.EVENTS_NOW, hours=20))


@query(f"{TRENDS_AND_NEWS} SELECT count(*) AS total_news, count(*) FILTER (published_at >= TIMESTAMP '2024-01-30') AS day_news, (SELECT count(*) FILTER (is_active) FROM trends) AS active_trends FROM news")
def stats_counts(spark, sf):
    return serving.stats(X.raw_news(spark, sf), X.trends(spark, sf), X.EVENTS_NOW)


@query("SELECT max(ts) AS last_update, CASE WHEN date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 1e6 < 600 THEN 'Active' ELSE 'Idle/Offline' END AS worker_status FROM events")
def worker_status(spark, sf):
    return serving.worker_status(X.arrivals(spark, sf).select(F.col("timestamp").alias("last_updated")), X.EVENTS_NOW)


SPEEDS = """speeds AS (SELECT trend_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 15.0 ELSE least(100.0, 35 * log2(1 + count(*) / greatest(1.0, date_diff('microsecond', min(timestamp), max(timestamp)) / 6e7))) END AS velocity FROM arrivals GROUP BY trend_id)"""
ACCELERATIONS = """last AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY timestamp DESC, id DESC) AS rn FROM arrivals),
gaps AS (SELECT trend_id, count(*) AS n, max(timestamp) FILTER (rn = 1) AS t1, max(timestamp) FILTER (rn = 3) AS t3, min(timestamp) AS tn FROM last WHERE rn <= 15 GROUP BY trend_id),
accelerations AS (SELECT trend_id, CASE WHEN n >= 5 AND date_diff('microsecond', t3, t1) / 6e7 < 0.4 * (date_diff('microsecond', tn, t1) / 6e7 / n) THEN 'up' ELSE 'steady' END AS acceleration FROM gaps)"""
CONFIDENCES = """confidences AS (SELECT trend_id, min(source_tier) AS best_tier, count(DISTINCT source_name) AS sources,
least(1.0, CASE min(source_tier) WHEN 1 THEN 1.25 WHEN 2 THEN 1.0 ELSE 0.75 END * CASE WHEN count(DISTINCT source_name) >= 5 THEN 1.35 WHEN count(DISTINCT source_name) >= 3 THEN 1.25 WHEN count(DISTINCT source_name) >= 2 THEN 1.15 ELSE 1.0 END)::DOUBLE AS confidence
FROM news GROUP BY trend_id)"""


@query(f"WITH {ARRIVALS}, {SPEEDS} SELECT trend_id, n, round(velocity, 6) AS velocity FROM speeds")
def velocity(spark, sf):
    return R.speeds(X.arrivals(spark, sf)).select("trend_id", "n", F.round("velocity", 6).alias("velocity"))


@query(f"WITH {ARRIVALS}, {ACCELERATIONS} SELECT * FROM accelerations")
def acceleration(spark, sf):
    return R.accelerations(X.arrivals(spark, sf))


@query(f"{NEWS}, {CONFIDENCES} SELECT trend_id, best_tier, sources, round(confidence, 6) AS confidence FROM confidences")
def confidence(spark, sf):
    return R.confidences(X.raw_news(spark, sf)).select("trend_id", "best_tier", "sources", F.round("confidence", 6).alias("confidence"))


@query(f"{NEWS} SELECT source_name, source_tier, count(*) AS n FROM news GROUP BY ALL")
def source_tier(spark, sf):
    return X.raw_news(spark, sf).groupBy("source_name", "source_tier").agg(F.count(F.lit(1)).alias("n"))


HIGH, MEDIUM = ["idiot", "clown"], ["the", "les"]
TWICE = "lower(translate(lower(translate(coalesce({}, ''), 'İ', 'i')), 'İI', 'iı'))"


@query(f"""SELECT doc_id, CASE WHEN {any_sql(TWICE.format('text'), L.CRITICAL_HIGH)} THEN 1.6 WHEN {any_sql(TWICE.format('text'), L.CRITICAL_MEDIUM)} THEN 1.25 ELSE 1.0 END::DOUBLE AS boost,
CASE WHEN {any_sql(FOLDED.format('text'), HIGH)} THEN 1.6 WHEN {any_sql(FOLDED.format('text'), MEDIUM)} THEN 1.25 ELSE 1.0 END::DOUBLE AS own_boost FROM documents""")
def criticality_boost(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.boost(F.col("text")).alias("boost"), S.boost(F.col("text"), HIGH, MEDIUM, turkish_case=True).alias("own_boost"))


def similarities(spark, sf):
    """The nearest other vector's similarity, for trends whose number is a vector's."""
    v = X.vectors(spark, sf)
    return vectors.nearest(v, v, 1).select(F.col("query_id").alias("trend_id"), (1 - F.col("distance")).alias("similarity"))


def models(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("trend_id"), F.col("event_id"), F.col("value"))
    newest = R.latest(e, "trend_id", ["event_id"], ["value"])
    odd = F.col("trend_id") % 4
    return newest.select("trend_id", F.when(odd == 0, "not json").when(odd == 1, F.format_string('{"entity_score": %.2f}', "value")).otherwise(F.format_string('{"entity_score": %.2f, "criticality_score": 60, "is_opinion": %s}', F.col("value"), F.when(odd == 2, "true").otherwise("false"))).alias("response"))


FINAL = f"""{TRENDS_AND_NEWS}, {ARRIVALS}, {SPEEDS}, {ACCELERATIONS}, {CONFIDENCES},
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), sim AS (SELECT a.id AS trend_id, max(list_inner_product(a.e, b.e)) AS similarity FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id),
m AS (SELECT user_id AS trend_id, CASE WHEN user_id % 4 = 0 THEN 30 ELSE round(arg_max(value, event_id), 2) END AS entity, CASE WHEN user_id % 4 IN (0, 1) THEN 30 ELSE 60 END AS criticality, user_id % 4 = 2 AS opinion FROM events GROUP BY user_id),
ref AS (SELECT trend_id, arg_min(content, id) AS reference FROM news GROUP BY trend_id),
j AS (SELECT t.id, t.title, t.final_tps AS old, coalesce(velocity, 0) AS velocity, acceleration, coalesce(confidence, 0.5) AS confidence, CASE WHEN similarity IS NULL THEN 100 WHEN similarity > 0.88 THEN 0 ELSE 100 * (1 - similarity) END AS novelty,
  CASE WHEN {any_sql(FOLDED.format('reference'), HIGH)} THEN 1.6 WHEN {any_sql(FOLDED.format('reference'), MEDIUM)} THEN 1.25 ELSE 1.0 END::DOUBLE AS boost, coalesce(entity, 30) AS entity, coalesce(criticality, 30) AS criticality, coalesce(opinion, false) AS opinion,
  {any_sql(FOLDED.format("coalesce(nullif(t.title, ''), left(reference, 100))"), L.JUNK)} AS junk
  FROM trends t JOIN ref ON ref.trend_id = t.id LEFT JOIN speeds ON speeds.trend_id = t.id LEFT JOIN accelerations a ON a.trend_id = t.id LEFT JOIN confidences c ON c.trend_id = t.id LEFT JOIN sim ON sim.trend_id = t.id LEFT JOIN m ON m.trend_id = t.id),
k AS (SELECT *, (0.35::DOUBLE * velocity + 0.25::DOUBLE * entity + 0.25::DOUBLE * criticality + 0.15::DOUBLE * novelty) * boost AS signal FROM j),
f AS (SELECT *, CASE WHEN junk THEN least(least(100.0::DOUBLE, signal * confidence), 12) ELSE least(100.0::DOUBLE, signal * confidence) END * CASE WHEN opinion THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS final FROM k)
SELECT id AS trend_id, round(velocity, 4) AS velocity, round(novelty, 4) AS novelty, boost, round(confidence, 4) AS confidence, round(signal, 4) AS tps_signal, round(final, 4) AS final_tps,
CASE WHEN acceleration = 'up' THEN 'up' WHEN coalesce(old, 0) <= 0 THEN 'up' WHEN (final - old) / old > 0.06 THEN 'up' WHEN (final - old) / old < -0.06 THEN 'down' ELSE 'steady' END AS trajectory FROM f"""


@query(FINAL)
def signal_final_tps(spark, sf):
    out = scoring.scored(X.trends(spark, sf), X.arrivals(spark, sf), X.raw_news(spark, sf), similarities(spark, sf), scoring.model_scores(models(spark, sf)), high=HIGH, medium=MEDIUM, turkish_case=True)
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("trend_id", r("velocity"), r("novelty"), "boost", r("confidence"), r("tps_signal"), r("final_tps"), "trajectory")


def with_previous(spark, sf):
    w = Window.partitionBy("custkey").orderBy("last_updated", "id")
    return X.trends(spark, sf).withColumn("previous_tps", F.lag("final_tps").over(w))


PREVIOUS = f"{TRENDS}, p AS (SELECT *, lag(final_tps) OVER (PARTITION BY custkey ORDER BY last_updated, id) AS previous_tps FROM trends)"
COURSE = "CASE WHEN coalesce(previous_tps, 0) <= 0 THEN 'up' WHEN (final_tps - previous_tps) / previous_tps > 0.06 THEN 'up' WHEN (final_tps - previous_tps) / previous_tps < -0.06 THEN 'down' ELSE 'steady' END"


@query(f"{PREVIOUS} SELECT id, {COURSE} AS trajectory, CASE {COURSE} WHEN 'up' THEN '▲' WHEN 'down' THEN '▼' ELSE '' END AS arrow FROM p")
def trajectory(spark, sf):
    t = with_previous(spark, sf).withColumn("trajectory", S.trajectory(F.col("final_tps"), F.col("previous_tps")))
    return t.select("id", "trajectory", D.arrow(F.col("trajectory")).alias("arrow"))


@query(f"{TRENDS} SELECT id, CASE WHEN final_tps > 40 AND date_diff('microsecond', last_updated, TIMESTAMP '2001-08-01 00:10:00') / 6e7 < 20 THEN 'hot' WHEN date_diff('microsecond', last_updated, TIMESTAMP '2001-08-01 00:10:00') / 6e7 > 180 THEN 'cooling' ELSE 'steady' END AS course FROM trends")
def ui_trajectory(spark, sf):
    return X.trends(spark, sf).select("id", S.shown_course(F.col("final_tps"), F.col("last_updated"), serving.at("2001-08-01 00:10:00")).alias("course"))


@query(f"{TRENDS} SELECT id, CASE WHEN coalesce(tps_signal, 0) < 20 THEN 'Düşük' WHEN coalesce(tps_signal, 0) <= 40 THEN 'Orta' ELSE 'Yüksek' END AS band, round(least(100, tps_signal), 8) AS width, trunc(score / 50 * 100)::INT AS percent FROM trends")
def signal_band(spark, sf):
    return X.trends(spark, sf).select("id", S.band(F.col("tps_signal")).alias("band"), F.round(F.least(F.lit(100.0), "tps_signal"), 8).alias("width"), (F.col("score") / 50 * 100).cast("int").alias("percent"))


FACTORS = {"1-URGENT": 0.98, "2-HIGH": 0.97, "3-MEDIUM": 0.94, "5-LOW": 0.85}
DECAYED = f"""{TRENDS}, h AS (SELECT *, date_diff('microsecond', last_updated, TIMESTAMP '2001-08-02') / 3.6e9 AS hours FROM trends),
d AS (SELECT *, is_active AND final_tps > 3 AND hours >= 1 AS decayed FROM h),
n AS (SELECT *, CASE WHEN decayed THEN final_tps * pow(CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FACTORS.items())} ELSE 0.93 END, hours) ELSE final_tps END AS new_tps FROM d),
s AS (SELECT id, decayed, round(new_tps, 6) AS new_tps, is_active AND NOT (decayed AND new_tps < 2) AS is_active, is_active AND decayed AND new_tps < 2 AS closed FROM n)"""


def faded(spark, sf):
    return scoring.decay(X.trends(spark, sf).withColumn("was_active", F.col("is_active")), X.ORDERS_NOW, FACTORS, L.DECAY_OTHER)


@query(f"{DECAYED} SELECT id, decayed, new_tps, is_active FROM s")
def gravity_decay(spark, sf):
    return faded(spark, sf).select("id", "decayed", F.round("new_tps", 6).alias("new_tps"), "is_active")


@query(f"{DECAYED} SELECT count(*) FILTER (decayed) AS decayed, count(*) FILTER (closed) AS archived FROM s")
def decay_summary(spark, sf):
    return faded(spark, sf).agg(F.count_if("decayed").alias("decayed"), F.count_if(F.col("was_active") & ~F.col("is_active")).alias("archived"))


@query(f"""{PREVIOUS} SELECT id, round(final_tps, 6) AS final_tps, final_tps >= 35 AS publish, final_tps >= 25 AS index_it,
CASE {COURSE} WHEN 'up' THEN '⏫' ELSE '🔥' END || ' ' || coalesce(nullif(title, ''), '?') || ' | ' || printf('%.1f', final_tps) || ' TPS | ' || upper({COURSE}) AS message FROM p WHERE final_tps >= 20 AND coalesce(previous_tps, 0) < 20""")
def threshold_crossing_alerts(spark, sf):
    t = with_previous(spark, sf).withColumn("trajectory", S.trajectory(F.col("final_tps"), F.col("previous_tps")))
    return serving.alerts(t).select("id", F.round("final_tps", 6).alias("final_tps"), (F.col("final_tps") >= L.PUBLISH_AT).alias("publish"), (F.col("final_tps") >= L.INDEX_AT).alias("index_it"), "message")


@query(f"""{TRENDS}, a AS (SELECT id FROM trends WHERE needs_scoring AND is_active ORDER BY id LIMIT 50), b AS (SELECT id FROM trends WHERE is_active AND final_tps >= 20 AND (summary IS NULL OR summary = '') ORDER BY final_tps DESC NULLS FIRST, id LIMIT 5)
SELECT 'score' AS queue, id FROM a UNION ALL SELECT 'summary', id FROM b""")
def work_queues(spark, sf):
    t = X.trends(spark, sf)
    return serving.scoring_queue(t).select(F.lit("score").alias("queue"), "id").unionByName(serving.summary_queue(t).select(F.lit("summary").alias("queue"), "id"))


@query(f"{TRENDS} SELECT id, coalesce(nullif(title, ''), '...') AS title, round(coalesce(final_tps, 0), 1) AS tps, strftime(last_updated, '%H:%M') AS time, is_active, final_tps > 30 AS strong FROM trends ORDER BY last_updated DESC NULLS FIRST, id LIMIT 100")
def admin_list(spark, sf):
    return serving.admin_list(X.trends(spark, sf))


def re_sql(column: str, steps: list[tuple[str, str]]) -> str:
    return reduce(lambda c, s: "regexp_replace({}, '{}', '{}', 'g')".format(c, s[0].replace("'", "''"), s[1]), steps, column)


CLEAN = re_sql("coalesce({}, '')", [(r'(?s)<section[^>]*class="[^"]*mceNonEditable[^"]*"[^>]*>.*?</section>', " "), (r"<[^>]+>", " "), (r"http\S+|www\.\S+", ""), (r"@[\p{{L}}\p{{N}}_]+", ""), (r"#[\p{{L}}\p{{N}}_]+", ""), (r"[^\p{{L}}\p{{N}}_\s,.?!-]", " "), (r"\s+", " ")])


@query(f"SELECT doc_id, trim({CLEAN.format('text')}) AS cleaned, length(trim({CLEAN.format('text')})) >= 25 AS kept FROM documents")
def clean_text(spark, sf):
    c = T.clean(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", c.alias("cleaned"), (F.length(c) >= 25).alias("kept"))


#: An own wording of what a page shows: the page is cut at its tags, and what isn't text is left out of the pieces.
_BARE = "list_aggregate(regexp_extract_all(regexp_replace(coalesce({}, ''), '<script\\b[^>]*>[\\s\\S]*?</script\\s*>|<style\\b[^>]*>[\\s\\S]*?</style\\s*>|<!--[\\s\\S]*?-->', '', 'gi') || '<x>', '([^<]*|<[^>]*$)(?:<[^>]+>|$)', 1), 'string_agg', '')"
PAGE_TEXT = "trim(array_to_string(regexp_split_to_array(" + reduce(lambda c, e: "array_to_string(string_split({}, '{}'), '{}')".format(c, *(x.replace("'", "''") for x in e)), T.ENTITIES, _BARE) + ", '\\s+'), ' '))"


@query(f"SELECT page_id, {PAGE_TEXT.format('html')} AS shown FROM pages")
def html_to_text(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("shown"))


SLUG = f"trim(regexp_replace(regexp_replace(translate({FOLDED}, 'şğüöç', 'sguoc'), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-')"
FIRST_SLUG = SLUG.format("array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:7], ' ')")


@query(f"SELECT doc_id, {FOLDED.format('text')} AS folded, {SLUG.format('text')} AS slug, coalesce(nullif({FIRST_SLUG}, ''), 'haber-detayi') AS first_slug FROM documents")
def normalize_slug(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.folded(F.col("text")).alias("folded"), T.slug(F.col("text")).alias("slug"), T.first_slug(F.col("text"), empty="haber-detayi").alias("first_slug"))


@query(f"""WITH s AS (SELECT doc_id, coalesce(nullif({FIRST_SLUG}, ''), 'haber-detayi') AS slug FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1 AS n FROM s),
u AS (SELECT *, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS x FROM r) SELECT doc_id, slug, CASE WHEN n > 0 AND x IN (SELECT slug FROM s) THEN x || '-' || doc_id ELSE x END AS unique_slug FROM u""")
def unique_slugs(spark, sf):
    s = X.table(spark, sf, "documents").select("doc_id", T.first_slug(F.col("text"), empty="haber-detayi").alias("slug"))
    return R.unique_slugs(s, "slug", "doc_id").select("doc_id", "slug", "unique_slug")


@query(f"""SELECT doc_id, coalesce(text, '') = '' OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 15 OR {any_sql(FOLDED.format('text'), L.SPAM)} AS spam, {any_sql(FOLDED.format('left(text, 100)'), L.JUNK + ['ea '])} AS junk FROM documents""")
def spam_junk_filter(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.is_spam(F.col("text")).alias("spam"), T.is_junk(F.lit(""), F.col("text"), [*L.JUNK, "ea "]).alias("junk"))


def score_sql(levels: dict, column: str) -> str:
    return " + ".join("CASE WHEN contains({}, '{}') THEN {} ELSE 0 END".format(column, w.replace("'", "''"), L.LEVEL_WEIGHTS[k]) for k, words in levels.items() for w in words)


NAMES = {"Spor": "sports", "Ekonomi": "economy", "Teknoloji": "technology", "Siyaset": "politics", "Sanat": "art", "Gündem": "general"}
OWN = {"Spor": {"high": ["the"], "medium": ["ation"], "low": ["ou"]}, "Ekonomi": {"high": ["les"], "medium": ["eau"], "low": ["ch"]}, "Siyaset": {"high": ["der", "que"], "medium": ["sch"], "low": ["ung", "ción"]}}
OWN_RULES = [(["license", "mail"], [(-60, ["Siyaset"])]), (["ich"], [(-40, ["Spor", "Siyaset"]), (-15, ["Ekonomi"])])]
SCORED = f"t AS (SELECT doc_id, lang, {FOLDED.format('text')} AS x FROM documents)"


@query(f"WITH {SCORED} SELECT doc_id, {', '.join(f'({score_sql(L.LEXICON[c], chr(120))})::INT AS {n}' for c, n in NAMES.items())} FROM t")
def keyword_scores(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", T.folded(F.col("text")).alias("x"))
    return d.select("doc_id", *(s.alias(NAMES[c]) for c, s in T.category_scores(F.col("x"), is_folded=True).items()))


def penalty_sql() -> str:
    out, step = f"s0 AS (SELECT *, {', '.join(f'({score_sql(v, chr(120))})::INT AS {NAMES[c]}' for c, v in OWN.items())} FROM t)", 0
    for words, effects in OWN_RULES:
        for penalty, categories in effects:
            value = {c: f"greatest(0, {NAMES[c]} + {penalty})" if c in categories else NAMES[c] for c in OWN}
            out += f", s{step + 1} AS (SELECT doc_id, lang, x, {', '.join(f'CASE WHEN {any_sql(chr(120), words)} THEN {v} ELSE {NAMES[c]} END AS {NAMES[c]}' for c, v in value.items())} FROM s{step})"
            step += 1
    return out + f", z AS (SELECT *, CASE WHEN sports >= economy AND sports >= politics THEN 'Spor' WHEN economy >= politics THEN 'Ekonomi' ELSE 'Siyaset' END AS best, greatest(sports, economy, politics) AS top, CASE lang WHEN 'en' THEN 'Siyaset' WHEN 'de' THEN 'Spor' ELSE 'Sanat' END AS given FROM s{step})"


@query(f"""WITH {SCORED}, {penalty_sql()}, w AS (SELECT *, CASE given WHEN 'Siyaset' THEN politics WHEN 'Spor' THEN sports ELSE 0 END AS own FROM z)
SELECT doc_id, given, CASE WHEN own < 15 AND top > 65 THEN best ELSE given END AS category, own < 15 AND top > 65 AS overridden FROM w""")
def category_decision(spark, sf):
    given = F.when(F.col("lang") == "en", "Siyaset").when(F.col("lang") == "de", "Spor").otherwise("Sanat")
    scores = T.penalised(T.category_scores(F.col("text"), OWN), F.col("text"), OWN_RULES)
    name, swapped = T.final_category(given, scores)
    return X.table(spark, sf, "documents").select("doc_id", given.alias("given"), name.alias("category"), swapped.alias("overridden"))


@query("SELECT text_key, count(*) AS n FROM (SELECT DISTINCT md5(text) AS text_key FROM documents WHERE doc_id % 3 <> 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)) GROUP BY 1")
def ingest_dedup(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("text_key", F.md5("text"))
    return R.unseen(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0"), "text_key").groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id <> 28")
def monitored_semi_join(spark, sf):
    d, watched = X.table(spark, sf, "documents"), X.table(spark, sf, "labels").filter("toxic = 1")
    return d.join(watched, "doc_id", "left_semi").filter("doc_id <> 28").select("doc_id", "source")


@query("SELECT DISTINCT source AS channel FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id < 7)")
def new_channels_except(spark, sf):
    d = X.table(spark, sf, "documents")
    given = channel_list(d.select(F.concat(F.lit("@"), "source").alias("line")))
    return given.subtract(d.filter("doc_id < 7").select(F.col("source").alias("channel")))


@query("SELECT 'rss' AS source_type, source AS source_name, doc_id AS external, text AS content FROM documents WHERE length(text) >= 30 UNION ALL SELECT 'telegram', role, conv_id * 1000 + turn, text FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20")
def union_ingest(spark, sf):
    a = X.table(spark, sf, "documents").filter(F.length("text") >= 30).select(F.lit("rss").alias("source_type"), F.col("source").alias("source_name"), F.col("doc_id").alias("external"), F.col("text").alias("content"))
    b = X.table(spark, sf, "conversations").filter(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= 20)
    return a.unionByName(b.select(F.lit("telegram").alias("source_type"), F.col("role").alias("source_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("external"), F.col("text").alias("content")))


V = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS c FROM embeddings), d AS (SELECT a.id AS query_id, b.id, a.c AS own, b.c AS c, 1 - list_inner_product(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)"


@query(f"{V} SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_top5(spark, sf):
    v = X.vectors(spark, sf)
    return vectors.nearest(v, v, 5).withColumn("distance", F.round("distance", 6))


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, epoch(ts) AS t FROM embeddings JOIN events ON vec_id = event_id), d AS (SELECT a.id AS query_id, b.id, 1 - list_inner_product(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id AND b.t >= a.t - 172800), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_time_bounded(spark, sf):
    t = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    v = X.vectors(spark, sf).join(t, "id")
    return vectors.nearest(v, v, 5, hours=48).withColumn("distance", F.round("distance", 6))


@query(f"{V} SELECT query_id, round(CASE WHEN 1 - distance > 0.88 THEN 0 ELSE 100 * distance END, 4) AS novelty FROM r WHERE rank = 1")
def novelty(spark, sf):
    v = X.vectors(spark, sf)
    return vectors.nearest(v, v, 1).select("query_id", F.round(S.novelty(1 - F.col("distance")), 4).alias("novelty"))


@query(f"{V}, b AS (SELECT query_id, c AS cluster_id, min(distance) AS distance FROM r WHERE rank <= 14 AND c <> own GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cluster_id) AS rank FROM b) SELECT query_id, cluster_id, round(distance, 6) AS distance, rank::INT AS rank FROM x WHERE rank <= 4")
def related_trends(spark, sf):
    v = X.vectors(spark, sf)
    return vectors.related(vectors.nearest(v, v, 14), v, 4).withColumn("distance", F.round("distance", 6))


@query()
def knn_indexed(spark, sf):
    v = X.vectors(spark, sf)
    return vectors.indexed_nearest(v, v, 5, cells=32, probes=20)


def timed_items(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return X.vectors(spark, sf).drop("cluster_id").join(e, "id").join(d, "id", "left")


@query()
def leader_clustering(spark, sf):
    return vectors.leader_clusters(timed_items(spark, sf), auto=0.55, far=0.71)


WANTED = "the and attion"


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^\p{L}\p{N}]+') AS ws FROM documents) SELECT doc_id FROM w WHERE list_has_all(ws, ['the', 'and', 'attion'])""")
def fulltext_words(spark, sf):
    return X.table(spark, sf, "documents").filter(search.matches(F.col("text"), WANTED)).select("doc_id")


@query()
def fulltext_search(spark, sf):
    """By an index of stems; a test holds it to the stems of each text."""
    made = index.build(X.table(spark, sf, "documents"), "doc_id", "text", new_path(spark, "stems"))
    return index.find(spark, made, WANTED).withColumnRenamed("key", "doc_id")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term FROM documents),
q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1:2])) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
SELECT q.item_id, w.doc_id FROM q JOIN w USING (term) JOIN n USING (item_id) GROUP BY q.item_id, w.doc_id, n.n HAVING count(*) = n.n""")
def fulltext_index(spark, sf):
    """The first two words of each item as a query, all queries at once, over an index of plain words."""
    made = index.build(X.table(spark, sf, "documents"), "doc_id", "text", new_path(spark, "words"), stems=False, stop=frozenset())
    asked = X.table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.filter(F.split(T.folded(F.col("text")), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, 2), " ").alias("asked"))
    return index.find_all(made, asked, "item_id", "asked").select(F.col("query_id").alias("item_id"), F.col("key").alias("doc_id"))


@query(f"{TRENDS_AND_NEWS}, x AS (SELECT * FROM trends WHERE is_active AND list_has_all(regexp_split_to_array(lower(translate(title, 'İI', 'iı')), '[^a-zı0-9]+'), ['household', 'urgent']) ORDER BY first_seen DESC NULLS FIRST, id LIMIT 32) {SHOWN}")
def timeline_search(spark, sf):
    """The timeline's search box, over an index of titles; no stem of a word in these titles meets another's."""
    t = X.trends(spark, sf)
    titles = index.build(t.select("id", "title"), "id", "title", new_path(spark, "titles"))
    return serving.timeline(t, X.raw_news(spark, sf), query="Household URGENT", index=titles)


@query(f"""{TRENDS}, i AS (SELECT CASE id % 4 WHEN 0 THEN id || '-' || 'old-slug' WHEN 1 THEN id::VARCHAR WHEN 2 THEN cluster_id ELSE coalesce(slug, 'none-' || id) END AS identifier FROM trends)
SELECT identifier, coalesce((SELECT min(t.id) FROM trends t WHERE t.id = try_cast(coalesce(nullif(regexp_extract(identifier, '^(\\d+)-', 1), ''), nullif(regexp_extract(identifier, '^(\\d+)$', 1), '')) AS BIGINT)),
CASE WHEN NOT regexp_matches(identifier, '^\\d+$') THEN least((SELECT min(t.id) FROM trends t WHERE t.slug = identifier), (SELECT min(t.id) FROM trends t WHERE t.cluster_id = identifier)) END) AS id FROM i""")
def identifier_resolve(spark, sf):
    t, k = X.trends(spark, sf), F.col("id") % 4
    x = F.when(k == 0, F.concat("id", F.lit("-old-slug"))).when(k == 1, F.col("id").cast("string")).when(k == 2, F.col("cluster_id")).otherwise(F.coalesce("slug", F.concat(F.lit("none-"), "id")))
    return serving.resolved(t.select(x.alias("identifier")), t)


@query("""SELECT count(*) AS processed, round(100.0 * count(*) FILTER (l_returnflag = 'N') / count(*), 1) AS success_rate, floor(avg(trunc(l_quantity * 2)) + avg(floor(l_extendedprice / 100)))::BIGINT AS avg_tokens,
round(sum(CASE WHEN l_returnflag <> 'R' THEN l_tax END), 4) AS total_cost FROM lineitem""")
def log_dashboard(spark, sf):
    return serving.log_summary(X.log(spark, sf))


@query("SELECT 'Spor' AS category, count(*) AS n FROM lineitem WHERE l_linestatus = 'O'")
def log_categories(spark, sf):
    return serving.log_categories(X.log(spark, sf))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS timestamp, l_orderkey AS trend_id, l_linenumber AS line, printf('%.8f', trunc(l_quantity * 2) * 7.5e-8 + floor(l_extendedprice / 100) * 3e-7) AS cost FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 20")
def log_recent(spark, sf):
    t = X.log(spark, sf).orderBy(F.col("timestamp").desc(), "trend_id", "line").limit(20)
    return t.select("timestamp", "trend_id", "line", D.fixed(S.cost(F.col("input_tokens"), F.col("output_tokens")), 8).alias("cost"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 30 ELSE coalesce(json_extract_string(props, '$.k')::DOUBLE, 30) END::DOUBLE AS entity, 30::DOUBLE AS criticality, false AS opinion FROM events""")
def json_defaults(spark, sf):
    e = X.table(spark, sf, "events")
    response = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"entity_score"')))
    return scoring.model_scores(e.select("event_id", response.alias("response")), key="event_id")


@query(f"""{TRENDS}, t AS (SELECT * FROM trends WHERE is_active AND last_updated IS NOT NULL ORDER BY last_updated DESC, id LIMIT 3000)
SELECT id, '  <url><loc>' || replace(replace(replace('https://example.com/?a&b/trend/' || coalesce(id || '-' || nullif(slug, ''), cluster_id), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc><lastmod>' || strftime(last_updated, '%Y-%m-%d') || '</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url>' AS line FROM t""")
def sitemap_lines(spark, sf):
    return serving.sitemap(X.trends(spark, sf), "https://example.com/?a&b")


@query(f"""{NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC NULLS FIRST, id DESC) AS rn FROM news)
SELECT trend_id, rn::INT AS rn, source_name AS source, CASE WHEN date_part('microsecond', published_at) % 1000000 = 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time, CASE WHEN external_id <> '' AND NOT starts_with(external_id, 'http') THEN 'https://' || external_id ELSE external_id END AS link, {PAGE_TEXT.format('content')} AS content FROM r WHERE rn <= 20""")
def detail_nested(spark, sf):
    return serving.detail(X.raw_news(spark, sf)).select("trend_id", F.inline("news_list")).select("trend_id", "rn", "source", "time", "link", "content")


@query(f"WITH {ARRIVALS} SELECT trend_id, count(*) AS message_count, min(timestamp) AS first_seen, max(timestamp) AS last_updated FROM arrivals GROUP BY trend_id")
def trend_rollup(spark, sf):
    return scoring.rollup(X.arrivals(spark, sf))


@query(f"{TRENDS} SELECT id, final_tps >= 40.5 AS publish, final_tps >= 35 AS by_default FROM trends")
def setting_lookup(spark, sf):
    when = F.lit("2024-01-01").cast("timestamp_ntz")
    old = spark.createDataFrame([(1, "auto_publish_threshold", "38.0"), (2, "other", "x")], "id long, key string, value string").withColumn("updated_at", when)
    new = spark.createDataFrame([(3, "auto_publish_threshold", "40.5")], "id long, key string, value string").withColumn("updated_at", when + F.expr("INTERVAL 1 DAY"))
    now = R.put_settings(old, new)
    own, default = R.setting(now, "auto_publish_threshold", 35.0), R.setting(now, "missing", 35.0).withColumnRenamed("value", "fallback")
    t = X.trends(spark, sf).crossJoin(F.broadcast(own)).crossJoin(F.broadcast(default))  # one row each
    return t.select("id", (F.col("final_tps") >= F.col("value")).alias("publish"), (F.col("final_tps") >= F.col("fallback")).alias("by_default"))


def event_stream(spark, sf):
    e = X.table(spark, sf, "events")
    return jobs.file_stream(spark, sf, "events", e.schema).select(F.col("event_id").alias("id"), F.col("user_id").alias("trend_id"), F.col("ts").alias("timestamp"))


@query(f"WITH {ARRIVALS}, h AS (SELECT trend_id, time_bucket(INTERVAL 5 MINUTES, timestamp) AS bucket, count(*) AS n FROM arrivals GROUP BY 1, 2) SELECT *, sum(n) OVER (PARTITION BY trend_id ORDER BY bucket)::BIGINT AS total FROM h")
def stream_history(spark, sf):
    return jobs.history(event_stream(spark, sf))


@query(f"WITH {ARRIVALS} SELECT * FROM arrivals")
def stream_dedup(spark, sf):
    return jobs.deduplicated(event_stream(spark, sf), "id", "timestamp")


@query(f"WITH {ARRIVALS} SELECT trend_id, count(*) AS message_count, min(timestamp) AS first_seen, max(timestamp) AS last_updated, true AS needs_scoring FROM arrivals GROUP BY trend_id")
def stream_upsert(spark, sf):
    return jobs.ingested(event_stream(spark, sf))


@query()
def stream_clusters(spark, sf):
    """Items as they arrive: in files by time, of which the four of a trigger hold about a batch."""
    items, top = kept(timed_items(spark, sf), "items"), new_path(spark, "arriving")
    items.repartitionByRange(max(4, -(-items.count() * 4 // vectors.BATCH)), "ts").write.parquet(top)
    return jobs.clustered(spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 4).parquet(top), auto=0.55, far=0.71)


@query(f"{TRENDS} SELECT id, final_tps, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS category, 0.0::DOUBLE AS score, 'steady' AS trajectory, 0.0::DOUBLE AS tps_confidence FROM trends")
def schema_evolve_reset(spark, sf):
    return reset(evolve(X.trends(spark, sf), struct("trends"))).select("id", "final_tps", "summary", "title", "category", "score", "trajectory", "tps_confidence")


@query("SELECT source AS name, max_by('https://x/' || doc_id || ',1', doc_id) AS url FROM documents GROUP BY source")
def source_list_scan(spark, sf):
    d = X.table(spark, sf, "documents").select(F.concat("source", F.lit(" , https://x/"), "doc_id", F.lit(",1")).alias("line"), F.col("doc_id").alias("place"))
    return source_list(d)


@query(f"""{TRENDS} SELECT id, upper(left(coalesce(category, 'Gündem'), 1)) || lower(substr(coalesce(category, 'Gündem'), 2)) AS capitalised, CASE WHEN category IS NULL THEN '📢 ' ELSE '🔹 ' END || upper(coalesce(category, 'Gündem')) || ' | ' || coalesce(title, '') || chr(10) || chr(10) || CASE WHEN length(summary) > 18 THEN left(summary, 18) || '...' ELSE coalesce(summary, '') END AS post FROM trends""")
def post_messages(spark, sf):
    t = X.trends(spark, sf).fillna({"title": "", "summary": "", "category": "Gündem"})
    return t.select("id", D.capitalised(F.col("category")).alias("capitalised"), D.post(F.col("category"), F.col("title"), D.cut(F.col("summary"), 18)).alias("post"))


@query(f"""{TRENDS} SELECT id, 'https://example.com/trend/' || coalesce(nullif(slug, ''), cluster_id) AS link, coalesce(title, '') AS headline, left(coalesce(summary, ''), 200) AS description, coalesce(summary, '') AS body, strftime(first_seen, '%Y-%m-%dT%H:%M:%S+00:00') AS published, strftime(last_updated, '%Y-%m-%dT%H:%M:%S+00:00') AS modified FROM trends""")
def structured_documents(spark, sf):
    t = X.trends(spark, sf).fillna({"title": ""})
    x = D.document(F.coalesce(D.full(F.col("slug")), F.col("cluster_id")), F.col("title"), F.col("summary"), F.col("first_seen"), F.col("last_updated"), "https://example.com")
    get = lambda k: F.get_json_object(x, f"$.{k}")
    return t.select("id", get("id").alias("link"), get("headline").alias("headline"), get("description").alias("description"), get("articleBody").alias("body"), get("datePublished").alias("published"), get("dateModified").alias("modified"))


@query("""SELECT user_id, event_type || '_' || user_id AS data, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS number, event_type AS action, count(*) AS n FROM events GROUP BY ALL""")
def callback_parse(spark, sf):
    e = X.table(spark, sf, "events").select("user_id", F.concat("event_type", F.lit("_"), "user_id").alias("data"), "event_type")
    action, number = D.callback(F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("data")))
    return e.select("user_id", "data", number.alias("number"), action.alias("action")).groupBy("user_id", "data", "number", "action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Spor' WHEN 1 THEN 'Sanat' END AS category, CASE p_size % 3 WHEN 0 THEN 'Sports' WHEN 1 THEN 'Sanat Haberleri' END AS title, CASE p_size % 3 WHEN 0 THEN 'All of sports' WHEN 1 THEN 'News' END AS description FROM part")
def category_pages(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, "sPOR").when(F.col("p_size") % 3 == 1, "sanat").otherwise("none")
    category, title = D.page(name, {"Spor": "Sports"})
    return X.table(spark, sf, "part").select("p_partkey", category.alias("category"), title.alias("title"), D.page_description(name, {"Spor": "All of sports"}, "News").alias("description"))


@query("SELECT doc_id // 40 AS feed, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents WHERE length(coalesce(text, '')) + 2 + doc_id % 40 >= 30 GROUP BY 1")
def feed_poll(spark, sf):
    from .sources import feeds

    got = feeds.items(feeds.parsed(X.feed_bodies(spark, sf)))
    chars = F.length("content") - 2 - F.length(F.regexp_extract("content", r"\. (x*)$", 1))
    return got.groupBy(F.substring("source_name", 2, 18).cast("long").alias("feed")).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).cast("long").alias("chars"))


@query(f"""{NEWS}, a AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY id % 2, published_at, id) AS k FROM news),
f AS (SELECT trend_id, content AS text FROM a WHERE k = 1), g AS (SELECT trend_id, max(id) AS newest_id, count(*)::BIGINT AS message_count, coalesce(min(published_at) FILTER (id % 2 = 0), min(published_at)) AS first_seen, max(published_at) AS last_updated FROM news GROUP BY trend_id)
SELECT trend_id, newest_id, message_count, first_seen, last_updated, trim(left(text, 70)) || '...' AS title, coalesce(nullif({FIRST_SLUG}, ''), 'haber-detayi') AS slug FROM g JOIN f USING (trend_id)""")
def ingest_upsert(spark, sf):
    """Two batches of news into one snapshot of trends."""
    from .plans import ingest

    news = X.raw_news(spark, sf).withColumn("cluster_id", F.col("trend_id"))
    schema = "trend_id long, title string, slug string, message_count long, first_seen timestamp_ntz, last_updated timestamp_ntz, needs_scoring boolean"
    first = ingest.trends_after(spark.createDataFrame([], schema), news.filter("id % 2 = 0"))
    both = ingest.trends_after(kept(first, "trends"), news.filter("id % 2 = 1"))
    newest = news.groupBy("trend_id").agg(F.max("id").alias("newest_id"))
    return both.join(newest, "trend_id").select("trend_id", "newest_id", "message_count", "first_seen", "last_updated", "title", "slug")


@query(f"{NEWS}, r AS (SELECT trend_id, arg_min(content, id) AS reference FROM news GROUP BY trend_id) SELECT trend_id, reference FROM r")
def reference_texts(spark, sf):
    return scoring.reference_texts(X.raw_news(spark, sf))


@query(f"{TRENDS} SELECT id, CASE WHEN id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN NOT is_active ELSE is_active END AS is_active, NOT (id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) AND is_active AS left_active FROM trends")
def toggle_active(spark, sf):
    t = X.trends(spark, sf)
    ids = X.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return upkeep.toggled(t, ids).select("id", "is_active").join(upkeep.deactivated(t, ids).select("id", F.col("is_active").alias("left_active")), "id")


@query("SELECT 'news' AS name, count(*) AS deleted, 0::BIGINT AS rows_left FROM documents JOIN events ON doc_id = event_id UNION ALL SELECT 'arrivals', count(*), 0 FROM events")
def delete_all(spark, sf):
    empty, counts = upkeep.deleted(news=X.raw_news(spark, sf), arrivals=X.arrivals(spark, sf))
    left = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows_left")) for n, t in empty.items()]
    return counts.join(left[0].unionByName(left[1]), "name")


QUEUED = f"""{TRENDS}, s AS (SELECT * FROM ({FINAL}) WHERE trend_id IN (SELECT id FROM trends WHERE needs_scoring AND is_active ORDER BY id LIMIT 50)),
heads AS (SELECT user_id AS trend_id, left(arg_min(text, doc_id), 60) AS head FROM documents JOIN events ON doc_id = event_id GROUP BY user_id)"""


def waiting_news(spark, sf):
    """The news of waiting trends: events are cut first, so that documents needn't be shuffled to meet all of them."""
    of = lambda waiting: X.table(spark, sf, "events").join(F.broadcast(waiting), F.col("user_id") == F.col("trend_id"), "left_semi")  # noqa: E731  # at most 50 rows
    return lambda waiting: X.raw_news(spark, sf, kept(of(waiting), "waiting-events"))


def after_pass(spark, sf):
    v = X.vectors(spark, sf)
    near = lambda waiting: vectors.nearest(v.join(F.broadcast(waiting), v["id"] == waiting["trend_id"], "left_semi"), v, 1).select(F.col("query_id").alias("trend_id"), (1 - F.col("distance")).alias("similarity"))  # noqa: E731  # at most 50 rows
    return upkeep.scoring_pass(X.trends(spark, sf), X.arrivals(spark, sf), waiting_news(spark, sf), near, scoring.model_scores(models(spark, sf)), X.ORDERS_NOW, high=HIGH, medium=MEDIUM, turkish_case=True)


@query(f"""{QUEUED} SELECT id, coalesce(round(s.final_tps, 4), t.final_tps) AS final_tps, coalesce(round(s.final_tps, 4), t.score) AS score, CASE WHEN s.trend_id IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE t.last_updated END AS last_updated,
CASE WHEN s.trend_id IS NOT NULL THEN coalesce(t.final_tps, 0) END AS previous_tps, s.trajectory, s.trend_id IS NULL AND needs_scoring AS needs_scoring FROM trends t LEFT JOIN s ON s.trend_id = t.id""")
def scoring_worker(spark, sf):
    new = lambda c: F.when(F.col("trajectory").isNotNull(), F.round(c, 4)).otherwise(F.col(c)).alias(c)
    return after_pass(spark, sf)[0].select("id", new("final_tps"), new("score"), "last_updated", "previous_tps", "trajectory", "needs_scoring")


@query(f"""{QUEUED} SELECT id, round(s.final_tps, 4) AS final_tps, CASE s.trajectory WHEN 'up' THEN '⏫' ELSE '🔥' END || ' ' || coalesce(nullif(t.title, ''), head) || ' | ' || printf('%.1f', s.final_tps) || ' TPS | ' || upper(s.trajectory) AS message
FROM trends t JOIN s ON s.trend_id = t.id JOIN heads h ON h.trend_id = t.id WHERE s.final_tps >= 20""")
def scoring_alerts(spark, sf):
    """No trend has a previous score yet, so all that come to the threshold are announced."""
    return after_pass(spark, sf)[1].select("id", F.round("final_tps", 4).alias("final_tps"), "message")


@query(f"""WITH a AS (SELECT user_id AS trend_id, event_id AS id, ts, date_diff('day', TIMESTAMP '2024-01-01', ts) // 10 AS cycle, text, source, value, event_type = 'view' AS opinion,
  CASE WHEN contains(lower(source), 'src0') OR contains(lower(source), 'src2') THEN 1 WHEN contains(lower(source), 'src3') OR contains(lower(source), 'src4') THEN 2 ELSE 3 END AS tier FROM events LEFT JOIN documents ON event_id = doc_id),
u AS (SELECT c.cycle AS cycle_at, a.*, row_number() OVER (PARTITION BY a.trend_id, c.cycle ORDER BY a.ts DESC, a.id DESC) AS rn FROM (SELECT DISTINCT trend_id, cycle FROM a) c JOIN a ON a.trend_id = c.trend_id AND a.cycle <= c.cycle),
g AS (SELECT trend_id, cycle_at, count(*) AS n, min(ts) AS first, max(ts) AS last, count(*) FILTER (rn <= 15) AS m, max(ts) FILTER (rn = 3) AS t3, min(ts) FILTER (rn <= 15) AS tn, min(tier) AS tier, count(DISTINCT coalesce(source, '?')) AS sources,
  arg_min(text, id) FILTER (text IS NOT NULL) AS reference, arg_max(value, id) AS entity, arg_max(opinion, id) AS opinion FROM u GROUP BY trend_id, cycle_at),
s AS (SELECT *, CASE WHEN n = 1 THEN 15.0 ELSE least(100.0, 35 * log2(1 + n / greatest(1.0, date_diff('microsecond', first, last) / 6e7))) END AS velocity,
  least(1.0, CASE tier WHEN 1 THEN 1.25 WHEN 2 THEN 1.0 ELSE 0.75 END * CASE WHEN sources >= 5 THEN 1.35 WHEN sources >= 3 THEN 1.25 WHEN sources >= 2 THEN 1.15 ELSE 1.0 END)::DOUBLE AS confidence,
  m >= 5 AND date_diff('microsecond', t3, last) < 0.4 * date_diff('microsecond', tn, last) / m AS faster,
  CASE WHEN {any_sql(FOLDED.format('reference'), HIGH)} THEN 1.6 WHEN {any_sql(FOLDED.format('reference'), MEDIUM)} THEN 1.25 ELSE 1.0 END::DOUBLE AS boost, {any_sql(FOLDED.format('left(reference, 100)'), L.JUNK)} AS junk FROM g WHERE reference IS NOT NULL),
k AS (SELECT *, (0.35::DOUBLE * velocity + 0.25::DOUBLE * entity + 0.25::DOUBLE * 30 + 0.15::DOUBLE * 100) * boost AS signal FROM s),
f AS (SELECT *, CASE WHEN junk THEN least(12, least(100.0::DOUBLE, signal * confidence)) ELSE least(100.0::DOUBLE, signal * confidence) END * CASE WHEN opinion THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS final FROM k),
h AS (SELECT *, row_number() OVER w AS version, coalesce(lag(final) OVER w, 0) AS before, coalesce(lag(final, 2) OVER w, 0) AS older FROM f WINDOW w AS (PARTITION BY trend_id ORDER BY cycle_at))
SELECT trend_id, version, round(signal, 4) AS tps_signal, round(final, 4) AS final_tps, round(before, 4) AS previous_tps, last AS last_updated, final >= 20 AND older < 20 AS alerted,
CASE WHEN faster OR before <= 0 OR (final - before) / before > 0.06 THEN 'up' WHEN (final - before) / before < -0.06 THEN 'down' ELSE 'steady' END AS trajectory FROM h""")
def scoring_state(spark, sf):
    """All events in three batches of ten days, each a run of the job that goes on where the one before ended; every cycle of every trend."""
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("source_name"))
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("trend_id"), "ts", F.col("value").alias("entity"), (F.col("event_type") == "view").alias("opinion"))
    none = {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("category", "string"), ("similarity", "double"), ("criticality", "double"))}
    items = e.join(d, "id", "left").withColumns(none | {"source_tier": S.tier(F.col("source_name"), X.TIER_1, X.TIER_2), "cycle": F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 10)})
    at = new_path(spark, "scoring")
    for cycle in range(3):
        state.items_of(items.filter(F.col("cycle") == cycle), high=HIGH, medium=MEDIUM, turkish_case=True).write.mode("append").parquet(f"{at}/items")
        state.scoring_job(spark.readStream.schema(state.ITEM).parquet(f"{at}/items"), f"{at}/job").awaitTermination()
    r = lambda c: F.round(c, 4).alias(c)
    return state.changes(spark, f"{at}/job").select("trend_id", "version", r("tps_signal"), r("final_tps"), r("previous_tps"), "last_updated", "alerted", "trajectory")


@query(f"{V.replace('label AS c', 'vec_id // 5 AS c')}, t AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT query_id, c AS cluster_id, min(distance) AS distance FROM r WHERE rank <= 14 AND c <> own GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cluster_id) AS rank FROM b) SELECT query_id, rank::INT AS rank, t.id FROM x JOIN t ON t.id = cluster_id WHERE rank <= 4 AND t.id <> query_id")
def related_active(spark, sf):
    """Here a vector's cluster is that of its trend, which is named by a number."""
    v = X.vectors(spark, sf).withColumn("cluster_id", F.floor(F.col("id") / 5))
    found = vectors.related(vectors.nearest(v, v, 14), v, 4)
    return serving.related_trends(found, X.trends(spark, sf).withColumn("cluster_id", F.col("id"))).select("query_id", "rank", "id")


@query(f"{TRENDS} SELECT id, strftime(last_updated, '%d.%m.%Y') AS day, strftime(last_updated, '%d %B %Y, %H:%M') AS long_form FROM trends")
def date_formats(spark, sf):
    return X.trends(spark, sf).select("id", D.day(F.col("last_updated")).alias("day"), D.long_form(F.col("last_updated")).alias("long_form"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 30 ELSE coalesce(json_extract_string(props, '$.k')::DOUBLE, 30) END::DOUBLE AS entity FROM events")
def json_lists(spark, sf):
    """Answers that come as a list count by their first element; an empty list has none."""
    k = F.get_json_object("props", "$.k")
    answer = F.when(F.col("event_id") % 3 == 0, "[]").when(F.col("event_id") % 3 == 1, F.concat(F.lit('[{"entity_score": '), k, F.lit('}, {"entity_score": 1}]'))).otherwise(F.concat(F.lit('{"entity_score": '), k, F.lit("}")))
    return scoring.model_scores(X.table(spark, sf, "events").select("event_id", answer.alias("response")), key="event_id").select("event_id", "entity")


@query(f"{TRENDS}, m AS (SELECT id, last_updated FROM trends WHERE is_active AND last_updated IS NOT NULL ORDER BY last_updated DESC, id LIMIT 3000) SELECT 4 + {len(L.CATEGORIES)} + (SELECT count(*) FROM m) AS lines, {len(L.CATEGORIES)}::BIGINT AS categories, (SELECT count(*) FROM m) AS trends")
def sitemap_document(spark, sf):
    """The whole document: header, home page, categories, trends, end."""
    d = serving.sitemap_document(X.trends(spark, sf), "https://example.com")
    return d.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").contains("/category/")).alias("categories"), F.count_if(F.col("line").contains("/trend/")).alias("trends"))


@query("SELECT DISTINCT 'https://example.com/' || (doc_id // 2) AS external_id FROM documents WHERE length(coalesce(text, '')) + 2 + doc_id % 40 >= 30")
def feed_stream(spark, sf):
    """All documents as feeds on a site, polled by a job that is stopped and resumed: a third of the sources, then two thirds, then all."""
    from .sources import polls

    at = new_path(spark, "polls")
    X.feed_bodies(spark, sf).write.partitionBy("source_name").text(f"{at}/site")
    urls = spark.read.format("binaryFile").load(f"{at}/site").select("source_name", F.col("_metadata.file_path").alias("url"))  # one row a file, which isn't opened
    lines = [f"{r.source_name},{r.url}\n" for r in urls.orderBy("source_name").collect()]  # the list of sources: a setting, one line each
    for k in (1, 2, 3):
        polls.put(f"{at}/sources-{k}", "".join(lines[: -(-len(lines) * k // 3)]))
        polls.poll_job(polls.stream(spark, f"{at}/sources-{k}", f"{at}/job", every_ms=1), f"{at}/job").awaitTermination()
    return polls.taken(spark, f"{at}/job").table().select("external_id")


@query(ORACLES["threshold_crossing_alerts"])
def alert_outbox(spark, sf):
    """The alerts as a stream into the outbox, read back: each once."""
    from .streaming import outbox

    found = kept(threshold_crossing_alerts(spark, sf), "alerts")
    at = new_path(spark, "outbox")
    rows = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 4).parquet(found.inputFiles()[0].rpartition("/")[0])
    outbox.send(rows, f"{at}/box", f"{at}/job").awaitTermination()
    return outbox.sent(spark, f"{at}/box", found.schema.simpleString()[7:-1].replace(":", " ")).drop("epoch")


CONTEXTS = f"""{TRENDS_AND_NEWS}, q AS (SELECT * FROM trends WHERE is_active AND final_tps >= 20 AND (summary IS NULL OR summary = '')),
i AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY id) AS rn FROM news WHERE trend_id IN (SELECT id FROM q)),
c AS (SELECT trend_id, string_agg('- ' || left(content, 1000), chr(10) ORDER BY rn) AS context FROM i WHERE rn <= 15 GROUP BY trend_id),
t AS (SELECT trend_id AS doc_id, ['en', 'de', 'fr'][1 + length(context) % 3] AS lang, {FOLDED.format('context')} AS x, context FROM c WHERE context <> '')"""
ANSWERED = f"""{CONTEXTS}, {penalty_sql().replace('SELECT doc_id, lang, x,', 'SELECT doc_id, lang, x, context,')}, w AS (SELECT *, CASE given WHEN 'Siyaset' THEN politics WHEN 'Spor' THEN sports ELSE 0 END AS own FROM z),
a AS (SELECT doc_id AS id, context, length(context) % 7 <> 0 AS ok, CASE WHEN own < 15 AND top > 65 THEN best ELSE given END AS category, substr(context, 3, 40) AS headline, substr(context, 3, 300) AS summary FROM w),
b AS (SELECT a.*, q.final_tps, CASE WHEN headline <> '' THEN {SLUG.format('headline')} END AS base FROM a JOIN q USING (id) WHERE ok),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY final_tps DESC, id) - 1 AS rank FROM b),
u AS (SELECT *, CASE WHEN rank = 0 THEN base ELSE base || '-' || rank END AS given_slug FROM r),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY given_slug ORDER BY id) > 1 THEN given_slug || '-' || id ELSE given_slug END AS slug FROM u)"""


def summaries_of(spark, sf):
    """All waiting trends, whatever a pass would take."""
    from . import models as M
    from .plans.summaries import summarised

    trends = X.trends(spark, sf)
    return summarised(trends, X.raw_news(spark, sf), lambda text: M.answers(text, M.editor), X.ORDERS_NOW, limit=None, base_url="https://example.com", lexicon=OWN, rules=OWN_RULES)


@query(f"""{ANSWERED} SELECT q.id, coalesce(s.headline, q.title) AS title, CASE WHEN s.id IS NULL THEN q.summary ELSE s.summary END AS summary, CASE WHEN s.id IS NULL THEN q.category ELSE s.category END AS category,
CASE WHEN s.id IS NULL THEN q.slug ELSE s.slug END AS slug, s.id IS NOT NULL AS is_active, CASE WHEN s.id IS NULL THEN q.last_updated ELSE TIMESTAMP '2001-08-02' END AS last_updated FROM q JOIN a USING (id) LEFT JOIN s ON s.id = q.id""")
def summary_pass(spark, sf):
    """Every waiting trend that has news, as the summariser leaves it."""
    return summaries_of(spark, sf).changes.select("id", "title", "summary", "category", "slug", "is_active", "last_updated")


@query(f"""{ANSWERED}, m AS (SELECT id, final_tps, 'https://example.com/trend/' || coalesce(slug, '') AS url, context, summary, category, CASE category WHEN 'Spor' THEN '{L.CATEGORY_ICONS.get('Spor', '🔹')}' WHEN 'Siyaset' THEN '{L.CATEGORY_ICONS.get('Siyaset', '🔹')}' WHEN 'Sanat' THEN '{L.CATEGORY_ICONS.get('Sanat', '🔹')}' ELSE '{L.CATEGORY_ICONS.get('Ekonomi', '🔹')}' END
  || ' ' || upper(category) || ' | ' || headline || chr(10) || chr(10) || summary AS message FROM s)
SELECT 'post' AS kind, id, url, message FROM m WHERE final_tps >= 35 UNION ALL SELECT 'notice', id, url, NULL FROM m WHERE final_tps >= 25 UNION ALL SELECT 'cost', id, NULL, (length(context) // 4) || ' + ' || (length(summary) // 4) FROM m""")
def summary_messages(spark, sf):
    """What goes out from the summaries: posts to the channel, notices to search engines, and the tokens that each took, as the log of costs has them."""
    got, none = summaries_of(spark, sf), F.lit(None).cast("string")
    posts = got.posts.select(F.lit("post").alias("kind"), "id", "url", "message")
    notices = got.notices.select(F.lit("notice").alias("kind"), "id", "url", none.alias("message"))
    return posts.unionByName(notices).unionByName(got.log.select(F.lit("cost").alias("kind"), F.col("trend_id").alias("id"), none.alias("url"), F.concat("input_tokens", F.lit(" + "), "output_tokens").alias("message")))


def stored_trends(spark, sf):
    """All trends as a table on storage."""
    from .schema import TRENDS as COLUMNS
    from .streaming.snapshots import Snapshot

    table = Snapshot(spark, new_path(spark, "stored-trends"), struct("trends"), parts=16)
    none = {c: F.lit(None).cast("double") for c in ("tps_confidence", "previous_tps")}
    table.put(X.trends(spark, sf).withColumns(none | {"trajectory": F.lit(None).cast("string")}).selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in COLUMNS.split(", "))), -1)
    return table


@query(f"""{QUEUED}, p AS (SELECT t.id, coalesce(s.final_tps, t.final_tps) AS final_tps, CASE WHEN s.trend_id IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE t.last_updated END AS last_updated, s.trend_id IS NULL AND needs_scoring AS needs_scoring, is_active, category FROM trends t LEFT JOIN s ON s.trend_id = t.id),
h AS (SELECT *, date_diff('microsecond', last_updated, TIMESTAMP '2001-08-02 00:30:00') / 3.6e9 AS hours FROM p), d AS (SELECT *, coalesce(is_active AND final_tps > 3 AND hours >= 1, false) AS decayed FROM h),
n AS (SELECT *, CASE WHEN decayed THEN final_tps * pow(CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FACTORS.items())} ELSE 0.93 END, hours) ELSE final_tps END AS new_tps FROM d)
SELECT id, round(new_tps, 6) AS final_tps, needs_scoring, is_active AND NOT (decayed AND new_tps < 2) AS is_active, (SELECT count(*) FILTER (decayed) FROM n) AS decayed, (SELECT count(*) FILTER (decayed AND new_tps < 2) FROM n) AS archived FROM n""")
def worker_passes(spark, sf):
    """A scoring pass and, half an hour later, one of decay, over trends on storage; the table that they leave, and what the second counted."""
    from .streaming import workers

    v, table = X.vectors(spark, sf), stored_trends(spark, sf)
    near = lambda waiting: vectors.nearest(v.join(F.broadcast(waiting), v["id"] == waiting["trend_id"], "left_semi"), v, 1).select(F.col("query_id").alias("trend_id"), (1 - F.col("distance")).alias("similarity"))  # noqa: E731  # at most 50 rows
    workers.scoring_step(table, 0, X.arrivals(spark, sf), waiting_news(spark, sf), near, scoring.model_scores(models(spark, sf)), X.ORDERS_NOW, high=HIGH, medium=MEDIUM, turkish_case=True)
    seen = workers.decay_step(table, 1, "2001-08-02 00:30:00", factors=FACTORS, other=L.DECAY_OTHER)
    tps = F.when(F.col("trajectory").isNotNull(), F.round("final_tps", 4)).otherwise(F.round("final_tps", 6))
    return table.table().select("id", tps.alias("final_tps"), "needs_scoring", "is_active", F.lit(seen["decayed"]).alias("decayed"), F.lit(seen["archived"]).alias("archived"))


@query("""WITH n AS (SELECT doc_id, source AS channel, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS run FROM documents), j AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING avg(n_chars) > (SELECT avg(n_chars) FROM documents))
SELECT doc_id, channel, run FROM n WHERE run = 1 AND channel IS NOT NULL OR channel IN (SELECT source FROM j)""")
def channel_watch(spark, sf):
    """Documents as messages of their sources, in two runs of a job: the list names the sources whose documents are longer than the mean first, and all sources then."""
    from .sources import polls
    from .streaming import workers

    d, at = X.table(spark, sf, "documents"), new_path(spark, "channels")
    means = d.groupBy("source").agg(F.avg("n_chars").alias("mean"))
    lists = [means.join(F.broadcast(d.agg(F.avg("n_chars").alias("all"))), F.col("mean") > F.col("all")), means]  # the right side is one row
    schema = "doc_id long, channel string, run int"
    for run, own in enumerate(lists):
        names = own.filter("source IS NOT NULL").select("source").distinct().orderBy("source").collect()  # the list of channels: a setting, one line each
        polls.put(f"{at}/list.txt", "# channels\n\n" + "".join(f"@{r.source}\n" for r in names))
        d.filter(F.col("doc_id") % 2 == run).select("doc_id", F.col("source").alias("channel"), F.lit(run).alias("run")).write.mode("append").parquet(f"{at}/in")
        channels = workers.Channels(spark, f"{at}/list.txt", f"{at}/job")
        workers.channel_job(spark.readStream.schema(schema).parquet(f"{at}/in"), channels, f"{at}/job").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/job/messages").select("doc_id", "channel", "run")


@query(f"""{TRENDS_AND_NEWS}, x AS (SELECT * FROM trends WHERE is_active AND last_updated >= TIMESTAMP '2001-07-03 00:00:00' AND NOT title ILIKE '%furn%' AND NOT title ILIKE '%burç%' ORDER BY final_tps DESC NULLS FIRST, last_updated DESC NULLS FIRST, id LIMIT 8),
y AS (SELECT * FROM trends WHERE is_active AND id NOT IN (SELECT id FROM x) AND last_updated >= TIMESTAMP '2001-07-03 00:00:00' AND NOT title ILIKE '%furn%' AND NOT title ILIKE '%burç%' ORDER BY final_tps DESC NULLS FIRST, last_updated DESC NULLS FIRST, id LIMIT 8)
SELECT s AS second, CASE WHEN s < 120 THEN x.id ELSE NULL END AS id, CASE WHEN s < 120 THEN coalesce(x.title, '') END AS title FROM x, (VALUES (0), (119)) v(s) UNION ALL SELECT 120, y.id, coalesce(y.title, '') FROM y""")
def served_list(spark, sf):
    """The hot list as it is served at three times, with all its trends switched off after the first: the stored list goes on until it is 120 seconds old."""
    from .streaming.snapshots import served

    trends, news, at = X.trends(spark, sf), X.raw_news(spark, sf), new_path(spark, "served")
    out = []
    for second in (0, 119, 120):
        left = trends if second == 0 else upkeep.deactivated(trends, first)
        made = served(spark, at, lambda t=left: serving.hot(t, news, X.ORDERS_NOW, hours=30 * 24, hide=["furn", "burç"]), 120, now=1e9 + second)
        out.append(made.select(F.lit(second).alias("second"), F.from_json("value", "id long, title string").alias("x")).select("second", "x.id", "x.title"))
        if second == 0:
            first = kept(out[0].select("id"), "served-ids")
    return reduce(DataFrame.unionByName, out)


TAGGED = """v AS (SELECT user_id AS trend_id, text AS document, epoch_us(ts) / 1e6 AS timestamp, label % 3 = 0 AS is_reference, label AS cluster_id FROM embeddings JOIN events ON vec_id = event_id JOIN documents ON vec_id = doc_id WHERE text IS NOT NULL)"""


def tagged_vectors(spark, sf):
    """Vectors with the metadata of their document: one in three labels marks references."""
    e, ev, d = X.table(spark, sf, "embeddings"), X.table(spark, sf, "events"), X.table(spark, sf, "documents").filter("text IS NOT NULL")
    rows = e.join(ev, F.col("vec_id") == F.col("event_id")).join(d, F.col("vec_id") == F.col("doc_id"))
    return rows.select(F.col("user_id").alias("trend_id"), F.col("text").alias("document"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), (F.col("label") % 3 == 0).alias("is_reference"), F.col("label").alias("cluster_id"))


@query(f"""{NEWS}, {TAGGED}, r AS (SELECT trend_id, arg_min(content, id) AS first_text FROM news GROUP BY trend_id), k AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY is_reference DESC, timestamp, document DESC) AS rn FROM v)
SELECT coalesce(k.trend_id, r.trend_id) AS trend_id, coalesce(document, first_text) AS reference, document IS NOT NULL AND is_reference AS tagged FROM (SELECT * FROM k WHERE rn = 1) k FULL JOIN r ON k.trend_id = r.trend_id""")
def reference_documents(spark, sf):
    """The reference text of each trend: its tagged vector's document, else another of its vectors', else its first item."""
    v = tagged_vectors(spark, sf)
    tagged = v.filter("is_reference").select("trend_id").distinct().withColumn("tagged", F.lit(True))
    return scoring.reference_texts(X.raw_news(spark, sf), v).join(tagged, "trend_id", "left").fillna({"tagged": False})


@query(f"WITH {TAGGED}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, document DESC) AS rn FROM v WHERE is_reference AND cluster_id > 0) SELECT cluster_id, document FROM k WHERE rn = 1")
def vector_lookup(spark, sf):
    """The first reference of each cluster, found by its metadata alone."""
    return vectors.first_where(tagged_vectors(spark, sf), "cluster_id", F.col("is_reference"), F.col("cluster_id") > 0)


@query(f"{TRENDS}, x AS (SELECT count(*) AS n FROM trends WHERE is_active) SELECT o::INT AS \"offset\", least(32, greatest(0, n - o)) AS listed, n - o >= 32 AS more FROM x, (VALUES (0), (640), (1000000)) t(o)")
def timeline_more(spark, sf):
    """Whether the timeline offers another page, at its start, further down and beyond its end."""
    t, news = X.trends(spark, sf), X.raw_news(spark, sf)
    pages = [serving.more(serving.timeline(t, news, offset=o)).select(F.lit(o).alias("offset"), "*") for o in (0, 640, 1_000_000)]
    return reduce(DataFrame.unionByName, pages)


@query(f"{TRENDS}, x AS (SELECT *, row_number() OVER (ORDER BY final_tps DESC NULLS FIRST, id) AS place FROM trends WHERE is_active) SELECT place::INT AS place, id, place || '. <code>' || printf('%.1f', coalesce(final_tps, 0)) || '</code> | ' || coalesce(nullif(title, ''), '...') AS line FROM x WHERE place <= 5")
def bot_top(spark, sf):
    return serving.bot_top(X.trends(spark, sf))


@query("""WITH k AS (SELECT DISTINCT p_brand AS key FROM part), s AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM k), d(key, value) AS (VALUES ('auto_publish_threshold', '35.0'), ('hidden_words', ''), ((SELECT min(key) FROM k), 'lost')),
n AS (SELECT key, value, row_number() OVER (ORDER BY key) AS i FROM d) SELECT id, key, 'set' AS value, TIMESTAMP '2024-01-01' AS updated_at FROM s UNION ALL SELECT i + (SELECT max(id) FROM s), key, value, TIMESTAMP '2024-01-02' FROM n WHERE key NOT IN (SELECT key FROM k)""")
def seeded_settings(spark, sf):
    """Settings named after all brands, and the defaults that are added where their key is missing."""
    from .schema import seeded

    brands = X.table(spark, sf, "part").select(F.col("p_brand").alias("key")).distinct()
    old = brands.select(F.row_number().over(Window.orderBy("key")).cast("long").alias("id"), "key", F.lit("set").alias("value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))  # a few brands
    least = brands.agg(F.min("key")).first()[0]
    return seeded(old, {"auto_publish_threshold": "35.0", "hidden_words": "", least: "lost"}, "2024-01-02")
