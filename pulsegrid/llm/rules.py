"""Quality rules with adaptive thresholds.

Fixed cut-offs fit one corpus. Here each language and source has its own, read off quantile sketches of its documents'
rates. A sketch is a histogram over buckets of bounded relative width (five significant bits of an integer rate), so
sketches merge by adding counts: in any order, on any executor, with the same result on each run. A source with few
documents borrows its language's merged sketch, or that of the whole corpus. The thresholds, one row to a language and
source, are then joined back, and documents beyond any of them are rejected.

Defined results: null text has no words, and fails the base rule as other texts of under 50 words do; null language or
source is a value of its own; equal rows get equal verdicts; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, same, stash, table

SYMBOLS = b"#*$%&|<>"
#: Blanks for str.split() that are not blanks for WORD.
OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
FIND_WORDS = re.compile(WORD).findall
BLANKS = " \t\n\v\f\r"

#: Rates out of 10,000, and how far above the group's median each may always lie.
ROOM = {"symbol_rate": 500, "dup_line_rate": 4000, "repeat_rate": 3500, "upper_rate": 3000}
#: A fence stands so many interquartile ranges above the upper quartile; a group needs so many documents for its own.
SPREAD, ENOUGH = 3, 200
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def split_words(text: str) -> list[str]:
    return FIND_WORDS(text) if OTHER_BLANK.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three that the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n, covered = 0, 0  # covered: words before this place are counted or passed
    for i, x in enumerate(windows):
        if seen[x] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def count(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = split_words(text)
    chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), int(chars[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines), int(chars[65:91].sum())


def _measured(batches):
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        rows = [count(x.as_py()) for x in batch.column("text")]
        found = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + found, [*names, *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, source, text) with their counts in place of the text."""
    keep = ["doc_id", "lang", "source"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", {c} long" for c in COUNTS)
    return docs.select(*keep, "text").mapInArrow(_measured, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    part = lambda a, b: F.floor(F.lit(10000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbol_rate": part("n_symbols", "word_chars"), "dup_line_rate": part("n_dup_lines", "n_lines"), "repeat_rate": part("n_repeat_words", "n_words"), "upper_rate": part("n_upper", "word_chars")}


def bucket(x: Column) -> Column:
    """The least integer with x's five leading bits."""
    drop = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the quantile sketch of each metric over the documents with words."""
    rows = measured.filter("n_words > 0").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(r).alias("bucket")) for m, r in rates().items()))).alias("x"))
    return rows.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: bucket counts add up."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """For each group and metric the documents behind it, and the fence that its quartiles set."""
    whole = Window.partitionBy(*by, "metric")
    ranks = sketch.withColumns({"_all": F.sum("n").over(whole), "_to": F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * q), F.col("bucket")))
    q = ranks.groupBy(*by, "metric").agg(F.max("_all").alias("docs"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    room = F.element_at(F.create_map(*(F.lit(x) for m in ROOM.items() for x in m)), F.col("metric"))
    return q.select(*by, "metric", "docs", F.greatest(F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")), F.col("q2") + room).alias("fence"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence for each metric: from the group's own sketch, or else the least merger with enough documents."""
    own, lang, every = (quartiles(merged(sketch, by), by) for by in (["lang", "source"], ["lang"], []))
    lang, every = lang.withColumnsRenamed({"docs": "lang_docs", "fence": "lang_fence", "metric": "m", "lang": "l"}), every.withColumnsRenamed({"docs": "all_docs", "fence": "all_fence", "metric": "k"})
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(every, F.col("metric") == F.col("k"))
    pick = F.when(F.col("docs") >= ENOUGH, F.col("fence")).when(F.col("lang_docs") >= ENOUGH, F.col("lang_fence")).otherwise(F.col("all_fence"))
    return t.withColumn("pick", pick).groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("pick"))).alias(f"{m}_most") for m in ROOM))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed and kept. Groups without limits have no document with words."""
    rows = measured.withColumns(rates() | {"base_failed": base_failed()})
    joined = rows.join(limits, same(rows, limits, ["lang", "source"]), "left").drop(limits["lang"], limits["source"])
    inside = F.lit(True)
    for m in ROOM:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_most"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def apply_rules(docs: DataFrame) -> DataFrame:
    measured = stash(measure(docs), "rule-counts")
    return judged(measured, stash(fences(stash(sketches(measured), "rule-sketches")), "rule-fences"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2])) AS g FROM w),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper
      FROM w JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)),
r AS (SELECT *, 10000 * n_symbols // greatest(word_chars, 1) AS r1, 10000 * n_dup_lines // greatest(n_lines, 1) AS r2,
      10000 * n_repeat_words // greatest(n_words, 1) AS r3, 10000 * n_upper // greatest(word_chars, 1) AS r4 FROM m),
u AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS metric, unnest([r1, r2, r3, r4]) AS v, unnest([500, 4000, 3500, 3000]) AS room FROM r WHERE n_words > 0),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS k FROM u),
q AS (SELECT lang, source, metric, any_value(room) AS room, grouping(lang, source) AS g, count(*) AS docs, quantile_disc(k, [0.25, 0.5, 0.75]) AS q
      FROM b GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
f AS (SELECT *, greatest(q[3] + 3 * (q[3] - q[1]), q[2] + room) AS fence FROM q),
p AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.docs >= 200 THEN o.fence WHEN n.docs >= 200 THEN n.fence ELSE e.fence END AS fence
      FROM f o JOIN f n ON o.g = 0 AND n.g = 1 AND o.lang IS NOT DISTINCT FROM n.lang AND o.metric = n.metric JOIN f e ON e.g = 3 AND o.metric = e.metric),
h AS (SELECT lang, source, max(fence) FILTER (metric = 1) AS f1, max(fence) FILTER (metric = 2) AS f2, max(fence) FILTER (metric = 3) AS f3, max(fence) FILTER (metric = 4) AS f4 FROM p GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(r1 <= f1 AND r2 <= f2 AND r3 <= f3 AND r4 <= f4, false)) AS kept
FROM r LEFT JOIN h ON r.lang IS NOT DISTINCT FROM h.lang AND r.source IS NOT DISTINCT FROM h.source
"""
