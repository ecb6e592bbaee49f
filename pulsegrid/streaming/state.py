"""Scoring, alerts and decay as keyed state: what a trend's next score needs stands with its key, in the state store, and nothing is read again.

A batch that brings items of a trend is one scoring cycle of that trend: the items go into its counts, its last arrivals, its sources and its
reference, and a row with the new scores comes out. State a key is bounded: 15 arrival times, 5 source names, one text's head. Where an
interval is given, a timer a trend lets its score fade by category on event time; a trend that fades below the limit is closed and holds no timer.

The order of a cycle is the original's: the course compares with the score before, the alert with the stored previous score, which is
two cycles old; then the scores move on. A trend without any text so far stays dirty and gives no row. Items may repeat only if the source repeats them:
a batch that runs twice after a failure starts from the state before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import lexicons as L
from ..functions import scores as S
from ..functions.display import alert, full
from ..functions.text import is_junk
from ..operators.relational import latest
from ..plans.scoring import DEAD_TPS, MIN_TPS
from .jobs import LATE, start

#: Arrivals that acceleration looks at, and sources beyond which confidence grows no more.
RECENT, SOURCES = 15, 5

ITEM = "trend_id long, id long, ts timestamp, at_s double, title string, category string, source_name string, source_tier int, boost double, junk boolean, head string, similarity double, entity double, criticality double, opinion boolean"
STATE = (
    "n long, first_s double, last_s double, recent array<double>, recent_ids array<long>, tier int, sources array<string>, reference long, head string, boost double, junk boolean, "
    "similarity double, entity double, criticality double, opinion boolean, model long, title string, category string, final_tps double, previous_tps double, updated_s double, active boolean, dirty boolean, version long"
)
CHANGE = "trend_id long, version long, kind string, title string, tps_signal double, tps_confidence double, final_tps double, previous_tps double, trajectory string, updated_s double, is_active boolean, alerted boolean"
#: What the state takes from items: all but the key, and the time that the watermark is of.
WANTED = tuple(c for c in (f.split()[0] for f in ITEM.split(", ")) if c not in ("trend_id", "ts"))
#: Rows of a trend that are looked at together.
CHUNK = 10_000
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_COLUMNS = [f.split()[0] for f in CHANGE.split(", ")]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def blank() -> dict:
    return dict.fromkeys(_FIELDS) | {"n": 0, "recent": [], "recent_ids": [], "sources": [], "final_tps": 0.0, "previous_tps": 0.0, "active": True, "dirty": False, "version": 0, "opinion": False}


def met(t: dict, items: pd.DataFrame | Sequence[tuple]) -> dict:
    """The state of a trend after items (as ITEM, or rows of WANTED) of its own."""
    if isinstance(items, pd.DataFrame):
        own = items[list(WANTED)].astype(object)
        items = list(own.where(own.notna(), None).itertuples(index=False, name=None))
    column = dict(zip(WANTED, zip(*items, strict=True), strict=True))
    seconds, ids = [math.nan if x is None else float(x) for x in column["at_s"]], [int(x) for x in column["id"]]
    first, last = min(seconds), max(seconds)
    t = t | {"n": t["n"] + len(ids), "first_s": first if t["first_s"] is None else min(first, t["first_s"]), "last_s": last if t["last_s"] is None else max(last, t["last_s"]), "dirty": True}
    arrivals = sorted([*zip(t["recent"], t["recent_ids"], strict=True), *zip(seconds, ids, strict=True)], reverse=True)[:RECENT]
    t["recent"], t["recent_ids"] = [a for a, _ in arrivals], [b for _, b in arrivals]
    tiers = [x for x in column["source_tier"] if x is not None]
    if tiers:
        t["tier"] = int(min(*tiers, 9 if t["tier"] is None else t["tier"]))
    t["sources"] = list(dict.fromkeys([*t["sources"], *column["source_name"]]))[:SOURCES]
    texts = [k for k, x in enumerate(column["head"]) if x is not None]
    if texts:
        k = min(texts, key=ids.__getitem__)
        if t["reference"] is None or ids[k] < t["reference"]:
            t |= {"reference": ids[k], "head": column["head"][k], "boost": float(column["boost"][k]), "junk": bool(column["junk"][k])}
    k = max(range(len(ids)), key=ids.__getitem__)
    if t["model"] is None or ids[k] > t["model"]:
        number = lambda c: None if column[c][k] is None else float(column[c][k])
        word = lambda c: t[c] if column[c][k] is None else column[c][k]
        t |= {"model": ids[k], "entity": number("entity"), "criticality": number("criticality"), "similarity": number("similarity"), "opinion": bool(column["opinion"][k])}
        t |= {"title": word("title"), "category": word("category")}
    return t


def scored(t: dict) -> tuple[dict, dict] | None:
    """The state after a cycle and what the cycle found, or None where there is no text yet."""
    if t["reference"] is None:
        return None
    speed = 15.0 if t["n"] == 1 else min(100.0, 35 * math.log2(1 + t["n"] / max(1.0, (t["last_s"] - t["first_s"]) / 60)))
    recent, n = t["recent"], len(t["recent"])
    faster = n >= 5 and (recent[0] - recent[2]) < 0.4 * (recent[0] - recent[-1]) / n
    many = len(t["sources"])
    bonus = 1.35 if many >= 5 else 1.25 if many >= 3 else 1.15 if many >= 2 else 1.0
    confidence = 0.5 if t["tier"] is None else min(1.0, L.TIER_WEIGHTS.get(t["tier"], 0.75) * bonus)
    novelty = 100.0 if t["similarity"] is None else 0.0 if t["similarity"] > 0.88 else 100 * (1 - t["similarity"])
    model = lambda c: 30.0 if t[c] is None else t[c]
    signal = (0.35 * speed + 0.25 * model("entity") + 0.25 * model("criticality") + 0.15 * novelty) * t["boost"]
    final = min(100.0, signal * confidence)
    if t["junk"]:
        final = min(12.0, final)
    if t["opinion"]:
        final *= 0.55
    before = t["final_tps"]
    ratio = (final - before) / before if before > 0 else 1.0
    course = "up" if faster or ratio > 0.06 else "down" if ratio < -0.06 else "steady"
    found = {"tps_signal": signal, "tps_confidence": confidence, "trajectory": course, "alerted": final >= L.ALERT_AT > t["previous_tps"]}
    return t | {"previous_tps": before, "final_tps": final, "updated_s": t["last_s"], "dirty": False, "version": t["version"] + 1}, found


def faded(t: dict, now_s: float, factors: dict[str, float], other: float) -> dict | None:
    """The state after one step of gravity, or None where the trend isn't due."""
    hours = (now_s - t["updated_s"]) / 3600 if t["updated_s"] is not None else 0.0
    if not t["active"] or t["final_tps"] <= MIN_TPS or hours < 1:
        return None
    final = t["final_tps"] * factors.get(t["category"], other) ** hours
    return t | {"final_tps": final, "active": final >= DEAD_TPS, "version": t["version"] + 1}


class Trends(StatefulProcessor):
    def __init__(self, every: float | None, factors: dict[str, float], other: float) -> None:
        self.every, self.factors, self.other = every, factors, other

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.trend = handle, handle.getValueState("trend", STATE)

    def _row(self, key: tuple, t: dict, kind: str, **found) -> Row:
        values = {"trend_id": key[0], "kind": kind, "title": t["title"] or t["head"], "is_active": t["active"], "alerted": False, "tps_signal": None, "tps_confidence": None, "trajectory": None}
        values |= {c: t[c] for c in ("version", "final_tps", "previous_tps", "updated_s")} | found
        return Row(**{c: values[c] for c in _COLUMNS})

    def _wait(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        t = dict(zip(_FIELDS, self.trend.get(), strict=True)) if self.trend.exists() else blank()
        take = None
        while items := list(islice(rows, CHUNK)):
            take = take or itemgetter(*map(items[0].__fields__.index, WANTED))
            t = met(t, [take(tuple(r)) for r in items])  # a Row looks its fields up by name first
        done = scored(t)
        if done is not None:
            t, found = done
            if self.every is not None and t["active"] and t["final_tps"] > MIN_TPS:
                self._wait(int((t["updated_s"] + max(self.every, 3600)) * 1000))
        self.trend.update(tuple(t[c] for c in _FIELDS))
        if done is not None:
            yield self._row(key, t, "score", **found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        t = faded(dict(zip(_FIELDS, self.trend.get(), strict=True)), now / 1000, self.factors, self.other)
        if t is None:
            return
        self.trend.update(tuple(t[c] for c in _FIELDS))
        if t["active"] and t["final_tps"] > MIN_TPS:
            self.handle.registerTimer(int(now + self.every * 1000))
        yield self._row(key, t, "decay")

    def close(self) -> None:
        pass


def items_of(news: DataFrame, **lists) -> DataFrame:
    """ITEM from news (trend_id, id, ts, title, category, source_name, source_tier, content, similarity, entity, criticality, opinion): text is looked at here, on the JVM."""
    text, ts = F.col("content"), F.col("ts").cast("timestamp")
    own = news.withColumns({"ts": ts, "at_s": F.unix_micros(ts) / 1e6, "boost": S.boost(text, **lists), "junk": is_junk(F.col("title"), text), "head": F.left(text, F.lit(60))})
    return own.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in ITEM.split(", ")))


def scoring_job(items: DataFrame, at: str, every: str | None = None, decay_s: float | None = None, late: str = LATE, factors: dict[str, float] = L.DECAY, other: float = L.DECAY_OTHER) -> StreamingQuery:
    """Score trends by a stream of items (as ITEM): changes go to a table below ``at``. decay_s: seconds between two steps of decay, in event time."""
    spark, key = items.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)  # a query keeps what holds when it starts
    try:
        keyed = (items.withWatermark("ts", late) if decay_s is not None else items.drop("ts")).groupBy("trend_id")
        changes = keyed.transformWithState(statefulProcessor=Trends(decay_s, factors, other), outputStructType=CHANGE, outputMode="Append", timeMode="None" if decay_s is None else "EventTime")
        return start(changes, at, every=every)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def changes(spark: SparkSession, at: str) -> DataFrame:
    """Every change so far, a version each."""
    own = spark.read.schema(CHANGE).parquet(f"{at}/table")
    return own.withColumn("last_updated", F.timestamp_micros(F.round(F.col("updated_s") * 1e6).cast("long")).cast("timestamp_ntz")).drop("updated_s")


def current(spark: SparkSession, at: str) -> DataFrame:
    """The trends as they are: of each the last version."""
    own = changes(spark, at)
    return latest(own, "trend_id", ["version"], [c for c in own.columns if c != "trend_id"])


def alerts(spark: SparkSession, at: str) -> DataFrame:
    message = alert(F.coalesce(full(F.col("title")), F.lit("?")), F.col("final_tps"), F.col("trajectory"))
    return changes(spark, at).filter("alerted").select("trend_id", "version", "final_tps", message.alias("message"))
