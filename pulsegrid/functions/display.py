"""Values as they are shown: dates, links, titles, escapes, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .scores import lookup


def full(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def link(external_id: Column) -> Column:
    x = F.coalesce(external_id, F.lit(""))
    return F.when((x != "") & ~x.startswith("http"), F.concat(F.lit("https://"), x)).otherwise(x)


def canonical(id_: Column, slug: Column, cluster_id: Column) -> Column:
    return F.coalesce(F.concat(id_.cast("string"), F.lit("-"), full(slug)), cluster_id)


def iso(ts: Column, zone: str = "Z") -> Column:
    """ISO 8601; microseconds only where there are some."""
    plain, precise = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(precise.endswith(".000000"), plain).otherwise(precise), F.lit(zone))


def day(t: Column) -> Column:
    return F.date_format(t, "dd.MM.yyyy")


def long_form(t: Column) -> Column:
    return F.date_format(t, "dd MMMM yyyy, HH:mm")


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cut(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def capitalised(c: Column) -> Column:
    """First letter up, all others down: not word by word."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def fixed(x: Column, n: int) -> Column:
    """x with n decimals as printf writes it: rounded from the exact binary value, halves to even. Java's formatter rounds halves up.

    p + e is x times 10^n without any loss (Dekker's product), so the comparison with a half is exact. Beyond 2^52 there is nothing to round.
    """
    ten, split = float(10**n), float((1 << 27) + 1)
    high = split * ten - (split * ten - ten)
    size = F.abs(x)
    p, c = size * ten, size * split
    upper = c - (c - size)
    lower = size - upper
    e = ((upper * high - p) + upper * (ten - high) + lower * high) + lower * (ten - high)
    down = F.floor(p)
    over = (p - down - 0.5) + e
    whole = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    rest = whole % 10**n
    text = F.concat(F.when(x < 0, "-").otherwise(""), ((whole - rest) / ten).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), n, "0"))
    return F.when(x.isNotNull(), F.when(p < float(1 << 52), text).otherwise(F.format_string(f"%.{n}f", x)))


def alert(title: Column, tps: Column, course: Column) -> Column:
    icon = F.when(course == "up", "⏫").otherwise("🔥")
    return F.concat(icon, F.lit(" "), title, F.lit(" | "), fixed(tps, 1), F.lit(" TPS | "), F.upper(course))


def post(category: Column, title: Column, summary: Column) -> Column:
    return F.concat(lookup(category, L.CATEGORY_ICONS, "🔹"), F.lit(" "), F.upper(category), F.lit(" | "), title, F.lit("\n\n"), cut(summary))


def arrow(course: Column) -> Column:
    return F.when(course == "up", "▲").when(course == "down", "▼").otherwise("")


def document(id_slug: Column, title: Column, summary: Column, published: Column, modified: Column, base_url: str) -> Column:
    """The structured-data document of a detail page, as JSON; quotes in texts are escaped by the writer."""
    date = lambda c: F.coalesce(iso(c, "+00:00"), F.lit(""))
    return F.to_json(F.struct(
        F.concat(F.lit(f"{base_url}/trend/"), id_slug).alias("id"), title.alias("headline"), F.left(F.coalesce(summary, F.lit("")), F.lit(200)).alias("description"), F.coalesce(summary, F.lit("")).alias("articleBody"),
        date(published).alias("datePublished"), F.coalesce(F.nullif(date(modified), F.lit("")), date(published)).alias("dateModified"),
    ))


def base_url(protocol: Column, forwarded: Column, host: Column) -> Column:
    """Where the site is reached: forwarded values first, no slash at the end."""
    return F.rtrim(F.concat(F.coalesce(full(protocol), F.lit("https")), F.lit("://"), F.coalesce(full(forwarded), host)), F.lit("/"))


def callback(data: Column) -> tuple[Column, Column]:
    """Action and number of 'action_number'; the number is null where there is none."""
    parts = F.split(data, "_", 2)
    return parts[0], F.try_element_at(parts, F.lit(2)).try_cast("long")


def page(name: Column, titles: dict[str, str], other: str = " Haberleri") -> tuple[Column, Column]:
    """A category's name and page title; null for names that are no category."""
    category = capitalised(name)
    known = F.when(category.isin(L.CATEGORIES), category)
    return known, F.coalesce(lookup(known, titles), F.concat(known, F.lit(other)))


def page_description(name: Column, descriptions: dict[str, str], other: str) -> Column:
    """What a category's page says of itself, or ``other``; null for names that are no category."""
    known, _ = page(name, {name: "" for name in L.CATEGORIES})
    return F.when(known.isNotNull(), lookup(known, descriptions, other) if descriptions else F.lit(other))
