"""Text: case folding, cleaning, slugs, HTML, keyword predicates and category scores. Built-in expressions, but for the word lists of categories (patterns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .patterns import sums


def folded(t: Column) -> Column:
    """Turkish lower case. The dotted and dotless capitals are mapped first: generic lower() gets both wrong."""
    return F.lower(F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def generic_first(t: Column) -> Column:
    """Lower case before Turkish folding, which loses capital dotless i: what the critical-word test does by default."""
    return F.lower(F.replace(F.coalesce(t, F.lit("")), F.lit("İ"), F.lit("i")))


def any_word(t: Column, words: list[str]) -> Column:
    """Whether t contains one of some strings; a chain of short-circuit tests inside generated code."""
    return reduce(lambda a, b: a | b, (t.contains(w) for w in words))


def clean(t: Column) -> Column:
    """Tags, links, mentions, hashtags and unusual characters out; blanks collapsed."""
    steps = [
        (r'(?s)<section[^>]*class="[^"]*mceNonEditable[^"]*"[^>]*>.*?</section>', " "), (r"<[^>]+>", " "), (r"http\S+|www\.\S+", ""),
        (r"@[\p{L}\p{N}_]+", ""), (r"#[\p{L}\p{N}_]+", ""), (r"[^\p{L}\p{N}_\s,.?!-]", " "), (r"\s+", " "),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.coalesce(t, F.lit(""))))


def slug(t: Column) -> Column:
    """ASCII words joined by dashes. Dotless i has no stand-in and is dropped."""
    s = F.translate(folded(t), "şğüöç", "sguoc")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s-]", ""), r"\s+", "-")
    return F.btrim(s, F.lit("-"))


def first_slug(t: Column, words: int = 7, empty: str | None = None) -> Column:
    """The slug of a text's first words, or ``empty`` where nothing is left."""
    s = slug(F.array_join(F.slice(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), 1, words), " "))
    return s if empty is None else F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


#: Scripts, styles and comments go before tags: their bodies may hold what looks like one.
HTML_STEPS = [(r"(?is)<script[^>]*>.*?</script\s*>", ""), (r"(?is)<style[^>]*>.*?</style\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", "")]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(h: Column) -> Column:
    """What a page shows, blanks collapsed."""
    t = reduce(lambda c, s: F.regexp_replace(c, *s), HTML_STEPS, F.coalesce(h, F.lit("")))
    t = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def is_spam(t: Column, words: list[str] = L.SPAM, least: int = 15) -> Column:
    """Empty, short, or with an advertiser's word."""
    return F.coalesce(t, F.lit("")).eqNullSafe("") | (F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"^\s+|\s+$", "")) < least) | any_word(folded(t), words)


def is_junk(title: Column, reference: Column, words: list[str] = L.JUNK) -> Column:
    """Tested on the title or, without one, the first 100 characters of the reference text."""
    return any_word(folded(F.coalesce(F.nullif(title, F.lit("")), F.left(reference, F.lit(100)))), words)


def _weights(levels: dict) -> dict[str, int]:
    out: dict[str, int] = {}
    for level, words in levels.items():
        for w in words:
            out[w] = out.get(w, 0) + L.LEVEL_WEIGHTS[level]
    return out


def keyword_score(t: Column, levels: dict[str, list[str]]) -> Column:
    """The weights of the words that t contains, each word once. No join, no shuffle."""
    return sums(t, [_weights(levels)])[0]


def category_scores(t: Column, lexicon: dict | None = None, is_folded: bool = False) -> dict[str, Column]:
    """Scores of all categories from one pass over t."""
    own = lexicon or L.LEXICON
    found = sums(t if is_folded else folded(t), [_weights(levels) for levels in own.values()])
    return {c: found[i] for i, c in enumerate(own)}


def penalised(scores: dict[str, Column], t: Column, rules: list | None = None) -> dict[str, Column]:
    """Rules in order; each that finds one of its words lowers its categories' scores, never below 0. All rules' words are found in one pass."""
    out, own = dict(scores), L.PENALTIES if rules is None else rules
    found = sums(folded(t), [dict.fromkeys(words, 1) for words, _ in own])
    for i, (_, effects) in enumerate(own):
        for penalty, categories in effects:
            for c in categories:
                if c in out:
                    out[c] = F.when(found[i] > 0, F.greatest(F.lit(0), out[c] + penalty)).otherwise(out[c])
    return out


def best_category(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Name and score of the highest; of equal ones the first."""
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, (c, s) in enumerate(scores.items()))))
    return best["name"], best["score"]


def final_category(given: Column, scores: dict[str, Column], weak: int = 15, strong: int = 65) -> tuple[Column, Column]:
    """The given category, unless its own score is weak and another's is strong; and whether it was overridden."""
    name, score = best_category(scores)
    own = reduce(lambda a, b: F.when(given == b[0], b[1]).otherwise(a), scores.items(), F.lit(0))
    swap = F.coalesce((own < weak) & (score > strong), F.lit(False))
    return F.when(swap, name).otherwise(given), swap
