"""The workers behind the site, each a step that a clock runs: scoring, decay, summaries, and the watch over a list of channels.

Trends stand in a Snapshot, so a step writes the parts that it changes. Steps of one table share one rising number, the one after the last that came to its end: a step
that is repeated after a failure has the same number and starts from the same rows. One clock runs all steps of a table, so no two write it at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import lexicons as L
from ..plans import scoring, summaries, upkeep
from ..sources.lists import channel_list, lines
from ..tables import kept
from .jobs import Log, clock, start
from .snapshots import Snapshot

#: Seconds between runs.
SCORING_EVERY, DECAY_EVERY, SUMMARY_EVERY = 5, 1800, 15


def scoring_step(trends: Snapshot, number: int, arrivals: DataFrame, news: DataFrame, similarity, models: DataFrame, now: str, alerts_at: str | None = None, **how) -> DataFrame:
    """Score the trends that wait and write them; gives the alerts, which also go to a folder by number, where one is named."""
    changes, alerts = upkeep.scoring_pass(trends.table(number), arrivals, news, similarity, models, now, changed_only=True, **how)
    alerts = kept(alerts, "alerts")
    trends.put(changes, number)
    if alerts_at:
        alerts.write.mode("overwrite").parquet(f"{alerts_at}/{number}")
    return alerts


def fading(trends: DataFrame, now: str, factors: dict[str, float] = L.DECAY, other: float = L.DECAY_OTHER) -> tuple[DataFrame, Observation]:
    """The trends that fade, as they then are, and an observation that counts them on the way: decayed, archived. It is filled by the action that writes them."""
    seen = Observation("decay")
    was = scoring.decay(trends.withColumn("_was", F.col("is_active")), now, factors, other).filter("decayed")
    was = was.observe(seen, F.count(F.lit(1)).alias("decayed"), F.count_if(F.col("_was") & ~F.col("is_active")).alias("archived"))
    return was.withColumns({"final_tps": F.col("new_tps"), "score": F.col("new_tps")}).select(*trends.columns), seen


def decay_step(trends: Snapshot, number: int, now: str, **how) -> dict[str, int]:
    """Let the scores fade and write the trends that did; how many decayed and how many were archived, counted in that one pass."""
    rows, seen = fading(trends.table(number), now, **how)
    trends.put(rows, number)
    return seen.get


def summary_step(trends: Snapshot, number: int, news: DataFrame, model, now: str, out: str | None = None, **how) -> summaries.Summaries:
    """Summarise what waits and write it; posts, notices and the log of costs go to folders by number below ``out``, where it is named."""
    done = summaries.summarised(trends.table(number), news, model, now, **how)
    trends.put(done.changes, number)
    if out:
        for name in ("posts", "notices", "log"):
            getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}/{number}")
    return done


def worker(trends: Snapshot, score: Callable[[int], object], decay: Callable[[int], object], at: str, summarise: Callable[[int], object] | None = None, every: int = SCORING_EVERY, decay_every: int = DECAY_EVERY, summary_every: int = SUMMARY_EVERY) -> StreamingQuery:
    """Scoring at every tick of a clock (seconds), and after it summaries and decay at the ticks that end their longer intervals. Each is called with its number."""
    steps = [(score, every), (summarise, summary_every), (decay, decay_every)]

    def tick(i: int) -> None:
        for step, seconds in steps:
            each = max(1, seconds // every)
            if step is not None and i % each == each - 1:
                step(0 if (last := trends.done()) is None else last + 1)

    return clock(trends.spark, tick, at, f"{every} seconds")


# --- Channels ----------------------------------------------------------------------------------------------------------


class Channels:
    """The channels that are listened to. Their list is a file that is read anew at each batch; what was joined stands in a log and isn't joined again."""

    def __init__(self, spark: SparkSession, listed: str, at: str) -> None:
        self.spark, self.listed = spark, listed
        self.joined = Log(spark, f"{at}/joined", "channel string", lambda rows: rows.distinct())

    def watch(self, batch_id: int, join: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Join the channels that are new in the list, and give all that are joined. join gives those of the new ones that it could join; the others are tried again.

        A list that isn't there changes nothing. A channel that leaves the list stays joined.
        """
        before = self.joined.table(batch_id)
        try:
            named = channel_list(lines(self.spark, self.listed))
            new = kept(named.join(before, "channel", "left_anti"), "channels")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
                raise
            new = before.limit(0)
        got = kept((join(new) if join else new).select("channel").distinct(), "joined")
        self.joined.put(got, batch_id)
        return before.unionByName(got)


def channel_job(messages: DataFrame, channels: Channels, at: str, join: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Keep the messages (channel, ...) of joined channels: one folder a batch below at/messages. The list is read anew for each batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        own = channels.watch(batch_id, join)
        batch.join(own.distinct(), "channel", "left_semi").select(*messages.columns).write.mode("overwrite").parquet(f"{at}/messages/batch={batch_id}")

    return start(messages, at, step, every)


# --- Counters ----------------------------------------------------------------------------------------------------------


class Counters(StreamingQueryListener):
    """Sums what streams observe, by the name of the observation and of the metric, from their progress events: no second scan."""

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str], int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                self.totals[name, metric] = self.totals.get((name, metric), 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
