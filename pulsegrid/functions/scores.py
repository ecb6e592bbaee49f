"""Signals of a trend: speed, acceleration, novelty, criticality, confidence, their sum, its course and its decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import any_word, folded, generic_first


def lookup(key: Column, values: dict, other=None) -> Column:
    """A dictionary's value for a key, as a literal map."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)
    return found if other is None else F.coalesce(found, F.lit(other))


def minutes(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(6e7)


def velocity(n: Column, first: Column, last: Column) -> Column:
    """0 without arrivals, 15 for one, else 35 log2(1 + n a minute), 100 at most."""
    speed = F.least(F.lit(100.0), 35.0 * F.log2(1 + n / F.greatest(F.lit(1.0), minutes(first, last))))
    return F.when(n == 0, 0.0).when(n == 1, 15.0).otherwise(speed)


def accelerates(n: Column, newest: Column, third: Column, oldest: Column) -> Column:
    """'up' if the last two gaps together are under 0.4 of a mean gap; n and oldest are of the last 15 arrivals."""
    gap, mean = minutes(third, newest), minutes(oldest, newest) / n
    return F.when((n >= 5) & (gap < 0.4 * mean), "up").otherwise("steady")


def tier(name: Column, first: list[str] = L.TIER_1, second: list[str] = L.TIER_2) -> Column:
    """1, 2 or 3 by substrings of the source's name, case ignored."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(any_word(low, [w.lower() for w in first]), 1).when(any_word(low, [w.lower() for w in second]), 2).otherwise(3)


def confidence(best_tier: Column, sources: Column) -> Column:
    """The best tier's weight times a bonus for diverse sources, 1 at most; 0.5 without any news."""
    bonus = F.when(sources >= 5, 1.35).when(sources >= 3, 1.25).when(sources >= 2, 1.15).otherwise(1.0)
    return F.when(best_tier.isNull(), 0.5).otherwise(F.least(F.lit(1.0), lookup(best_tier, L.TIER_WEIGHTS, 0.75) * bonus))


def novelty(similarity: Column) -> Column:
    """100 for what nothing resembles, 0 above a similarity of 0.88."""
    return F.when(similarity.isNull(), 100.0).when(similarity > 0.88, 0.0).otherwise(100.0 * (1 - similarity))


def boost(t: Column, high: list[str] = L.CRITICAL_HIGH, medium: list[str] = L.CRITICAL_MEDIUM, turkish_case: bool = False) -> Column:
    x = folded(t) if turkish_case else generic_first(t)
    return F.when(any_word(x, high), 1.6).when(any_word(x, medium), 1.25).otherwise(1.0)


def signal(v: Column, e: Column, s: Column, n: Column, factor: Column) -> Column:
    return (0.35 * v + 0.25 * e + 0.25 * s + 0.15 * n) * factor


def final(signal_: Column, confidence_: Column, junk: Column, opinion: Column) -> Column:
    """100 at most; junk 12 at most; opinion then counts 0.55."""
    x = F.least(F.lit(100.0), signal_ * confidence_)
    x = F.when(junk, F.least(x, F.lit(12.0))).otherwise(x)
    return F.when(opinion, x * 0.55).otherwise(x)


def trajectory(now: Column, before: Column, acceleration: Column | None = None) -> Column:
    """up or down beyond 6 per cent; up from nothing, or where arrivals accelerate."""
    ratio = (now - before) / before
    course = F.when(F.coalesce(before, F.lit(0.0)) <= 0, "up").when(ratio > 0.06, "up").when(ratio < -0.06, "down").otherwise("steady")
    return course if acceleration is None else F.when(acceleration == "up", "up").otherwise(course)


def shown_course(score: Column, updated: Column, now: Column) -> Column:
    age = minutes(updated, now)
    return F.when((score > 40) & (age < 20), "hot").when(age > 180, "cooling").otherwise("steady")


def band(tps: Column) -> Column:
    x = F.coalesce(tps, F.lit(0.0))
    return F.when(x < 20, "Düşük").when(x <= 40, "Orta").otherwise("Yüksek")


def decayed(tps: Column, category: Column, hours: Column, factors: dict[str, float] = L.DECAY, other: float = L.DECAY_OTHER) -> Column:
    return tps * F.pow(lookup(category, factors, other), hours)


def crosses(now: Column, before: Column, at: float = L.ALERT_AT) -> Column:
    return (now >= at) & (F.coalesce(before, F.lit(0.0)) < at)


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * 7.5e-8 + tokens_out * 3e-7


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, summed in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

