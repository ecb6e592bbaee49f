import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import display as D
from pulsegrid.functions import scores as S
from pulsegrid.functions import text as T

NOW = datetime(2024, 1, 1)


def ask(spark, column, **values):
    """The value of a column over one row."""
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", datetime: "timestamp_ntz", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "one int")
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,want", [("İSTANBUL IRMAK", "istanbul ırmak"), (None, ""), ("ĞÜŞÖÇ", "ğüşöç")])
def test_folded(spark, text, want):
    assert ask(spark, T.folded(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Türkiye'de Ekonomi", "turkiyede-ekonomi"), ("ışık", "sk"), ("  -a  b- ", "a-b"), ("", "")])
def test_slug(spark, text, want):
    assert ask(spark, T.slug(F.col("t")), t=text) == want


def test_first_slug(spark):
    assert ask(spark, T.first_slug(F.col("t")), t="one two three four five six seven eight") == "one-two-three-four-five-six-seven"
    assert ask(spark, T.first_slug(F.col("t"), empty="x"), t="!!!") == "x"


def test_clean(spark):
    given = 'a<b>c</b> http://x.y/z www.q @me #tag <section class="mceNonEditable">gone</section> é; ok?'
    assert ask(spark, T.clean(F.col("t")), t=given) == "a c é ok?"
    assert ask(spark, T.clean(F.col("t")), t=None) == ""


def test_html_text(spark):
    assert ask(spark, T.html_text(F.col("t")), t="<p>a&amp;b</p><script>var x='</p>';</script><!-- no --><style>p{}</style> c&nbsp;d") == "a&b c d"


@pytest.mark.parametrize("text,want", [(None, True), ("", True), ("short", True), ("a long enough message", False), ("CASINO in a long message", False), ("casino in a long message", True)])
def test_spam(spark, text, want):
    # capital I folds to dotless i, so CASINO is no casino
    assert ask(spark, T.is_spam(F.col("t")), t=text) == want


def test_boost_loses_dotless_capital_unless_told(spark):
    assert ask(spark, S.boost(F.col("t")), t="SALDIRI") == 1.0
    assert ask(spark, S.boost(F.col("t"), turkish_case=True), t="SALDIRI") == 1.6
    assert ask(spark, S.boost(F.col("t")), t="son dakika") == 1.25
    assert ask(spark, S.boost(F.col("t")), t=None) == 1.0


@pytest.mark.parametrize("n,seconds,want", [(0, 0, 0), (1, 0, 15), (2, 0, 35 * math.log2(3)), (60, 60, 100), (3, 600, 35 * math.log2(1.3))])
def test_velocity(spark, n, seconds, want):
    got = ask(spark, S.velocity(F.col("n"), F.col("a"), F.col("b")), n=n, a=NOW, b=NOW + timedelta(seconds=seconds))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tier,sources,want", [(1, 1, 1.0), (3, 1, 0.75), (3, 3, 0.9375), (3, 2, 0.8625), (3, 5, 1.0), (2, 1, 1.0)])
def test_confidence(spark, tier, sources, want):
    assert ask(spark, S.confidence(F.col("t"), F.col("n")), t=tier, n=sources) == pytest.approx(want)
    assert ask(spark, S.confidence(F.lit(None).cast("int"), F.lit(0))) == 0.5


@pytest.mark.parametrize("name,want", [("AA haber", 1), ("hürriyet", 2), ("hurriyet", 3), (None, 3), ("haaa", 1)])
def test_tier(spark, name, want):
    assert ask(spark, S.tier(F.col("n")), n=name) == want


@pytest.mark.parametrize("similarity,want", [(0.9, 0), (0.88, 12), (0.5, 50), (-0.5, 150)])
def test_novelty(spark, similarity, want):
    assert ask(spark, S.novelty(F.col("s")), s=similarity) == pytest.approx(want)
    assert ask(spark, S.novelty(F.lit(None).cast("double"))) == 100


def test_final(spark):
    f = lambda s, c, j, o: ask(spark, S.final(F.lit(s), F.lit(c), F.lit(j), F.lit(o)))
    assert f(150.0, 1.0, False, False) == 100 and f(50.0, 0.5, False, False) == 25
    assert f(50.0, 1.0, True, False) == 12 and f(50.0, 1.0, True, True) == pytest.approx(6.6) and f(5.0, 1.0, True, False) == 5
    assert ask(spark, S.signal(*(F.lit(float(x)) for x in (100, 60, 60, 40)), F.lit(1.6))) == pytest.approx((35 + 15 + 15 + 6) * 1.6)


@pytest.mark.parametrize("now,before,want", [(5.0, 0.0, "up"), (107.0, 100.0, "up"), (105.0, 100.0, "steady"), (95.0, 100.0, "steady"), (93.0, 100.0, "down")])
def test_trajectory(spark, now, before, want):
    assert ask(spark, S.trajectory(F.col("n"), F.col("b")), n=now, b=before) == want
    assert ask(spark, S.trajectory(F.col("n"), F.col("b"), F.lit("up")), n=now, b=before) == "up"


def test_decay_and_bands(spark):
    assert ask(spark, S.decayed(F.lit(10.0), F.lit("Spor"), F.lit(2.0))) == pytest.approx(7.225)
    assert ask(spark, S.decayed(F.lit(10.0), F.lit(None).cast("string"), F.lit(1.0))) == pytest.approx(9.3)
    assert [ask(spark, S.band(F.col("x")), x=x) for x in (19.9, 20.0, 40.0, 40.1)] == ["Düşük", "Orta", "Orta", "Yüksek"]
    assert ask(spark, S.cost(F.lit(1_000_000), F.lit(1_000_000))) == pytest.approx(0.375)


@pytest.mark.parametrize("score,minutes,want", [(41.0, 19, "hot"), (41.0, 20, "steady"), (40.0, 5, "steady"), (99.0, 181, "cooling"), (1.0, 180, "steady")])
def test_shown_course(spark, score, minutes, want):
    assert ask(spark, S.shown_course(F.col("s"), F.col("u"), F.lit(NOW)), s=score, u=NOW - timedelta(minutes=minutes)) == want


def test_category(spark):
    def decide(given, text):
        name, swapped = T.final_category(F.lit(given), T.penalised(T.category_scores(F.col("t")), F.col("t")))
        return ask(spark, name, t=text), ask(spark, swapped, t=text)

    assert decide("Siyaset", "galatasaray ve beşiktaş derbi") == ("Spor", True)
    assert decide("Spor", "galatasaray ve beşiktaş derbi") == ("Spor", False)
    assert decide("Sanat", "nothing of note") == ("Sanat", False)
    best, score = T.best_category({c: F.lit(5) for c in ("Spor", "Ekonomi")})
    assert (ask(spark, best), ask(spark, score)) == ("Spor", 5)
    # a word counts once; penalties stop at nothing
    assert ask(spark, T.keyword_score(F.col("t"), {"high": ["a"], "medium": ["b"], "low": ["c"]}), t="aaabbb") == 80
    out = T.penalised({"X": F.lit(30)}, F.col("t"), [(["a"], [(-60, ["X"])]), (["b"], [(10, ["X", "Y"])])])
    assert ask(spark, out["X"], t="ab") == 10


def test_display(spark):
    assert ask(spark, D.link(F.col("x")), x="a.b/c") == "https://a.b/c" and ask(spark, D.link(F.col("x")), x=None) == ""
    assert ask(spark, D.canonical(F.lit(5), F.col("s"), F.lit("c")), s="") == "c" and ask(spark, D.canonical(F.lit(5), F.col("s"), F.lit("c")), s="x") == "5-x"
    assert ask(spark, D.iso(F.col("t")), t=NOW) == "2024-01-01T00:00:00Z" and ask(spark, D.iso(F.col("t")), t=NOW + timedelta(microseconds=1)) == "2024-01-01T00:00:00.000001Z"
    assert ask(spark, D.xml(F.col("x")), x="a&<b>") == "a&amp;&lt;b&gt;"
    assert ask(spark, D.cut(F.col("x"), 3), x="abcd") == "abc..." and ask(spark, D.cut(F.col("x"), 4), x="abcd") == "abcd"
    assert ask(spark, D.capitalised(F.col("x")), x="sPOR haber") == "Spor haber"
    assert [ask(spark, c, x="pub_12_3") for c in D.callback(F.col("x"))] == ["pub", None] and [ask(spark, c, x="del_7") for c in D.callback(F.col("x"))] == ["del", 7]
    assert ask(spark, D.base_url(F.col("p"), F.col("f"), F.col("h")), p=None, f="", h="a.b/") == "https://a.b"
    assert '"description":"say \\"x\\""' in ask(spark, D.document(F.lit("s"), F.lit("t"), F.col("x"), F.col("d"), F.lit(None).cast("timestamp_ntz"), "b"), x='say "x"', d=NOW)


def test_words_found_in_one_pass(spark):
    """Words within words, at both ends, more than once, and none: as contains() finds them."""
    from pulsegrid.functions.patterns import sums

    groups = [{"a": 1, "ab": 2, "babab": 4}, {"çş": 10, "ab": 20}, {}]
    texts = ["ababab", "xçşx", "ab", "", None, "zzz", "ÇŞ", "a" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sums(F.col("t"), groups)).collect()]
    assert got == [[sum(w for k, w in g.items() if t and k in t) for g in groups] for t in texts]
    assert [r[0] for r in df.select(sums(F.col("t"), [{}])).collect()] == [[0]] * len(texts)


def test_fixed_rounds_like_printf(spark):
    rng = random.Random(5)
    x = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 2.5e-3, 0.95, 9.95, 9.96, 20.25, 35.15, 99.25, 99.75, 99.95, -0.26, 1e15 + 0.5, 7.5e-8, 2.25e-7, 7.425e-6, 1.5e-8, 5e-9, None]
    x += [rng.randrange(100_000) / 4000 for _ in range(300)] + [rng.randrange(2000) * 7.5e-8 + rng.randrange(900) * 3e-7 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for n in (1, 8):
        got = [r[0] for r in df.select(D.fixed(F.col("x"), n)).collect()]
        assert got == [None if v is None else f"{v:.{n}f}" for v in x]
