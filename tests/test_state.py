"""Keyed state: cycles, restart, timers, against a replay that keeps all items."""

import datetime as dt
import math

import pytest

from pulsegrid.streaming import state

T0 = dt.datetime(2024, 1, 1)
COLUMNS = [f.split()[0] for f in state.ITEM.split(", ")]


def item(trend, id_, minutes, **more):
    row = {"trend_id": trend, "id": id_, "ts": T0 + dt.timedelta(minutes=minutes), "at_s": (T0 - dt.datetime(1970, 1, 1)).total_seconds() + 60.0 * minutes, "title": None, "category": "Spor", "source_name": "s", "source_tier": 1, "boost": 1.6, "junk": False, "head": f"text {id_}", "similarity": None, "entity": 90.0, "criticality": 80.0, "opinion": False}
    return tuple((row | more)[c] for c in COLUMNS)


def drain(spark, folder, at, rows, **how):
    spark.createDataFrame(rows, state.ITEM).coalesce(1).write.mode("append").parquet(f"{folder}/items.parquet")
    q = state.scoring_job(spark.readStream.schema(state.ITEM).parquet(f"{folder}/items.parquet"), at, **how)
    q.awaitTermination()


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "at")


def test_cycles_restart_and_alerts(spark, places):
    """Each drain is a new run of the job on its folder."""
    folder, at = places
    drain(spark, folder, at, [item(1, 1, 0), item(1, 2, 1), item(2, 3, 0, head=None), item(3, 4, 0, entity=0.0, criticality=0.0, similarity=0.95, boost=1.0, source_tier=3)])
    drain(spark, folder, at, [item(1, 5, 2, entity=10.0, criticality=None, source_name=None), item(2, 6, 1, head="late text", title="Named", opinion=True)])
    drain(spark, folder, at, [item(1, 7, 3, junk=True), item(2, 8, 2)])
    drain(spark, folder, at, [item(1, 9, 4)])
    got = {(r.trend_id, r.version): r for r in state.changes(spark, at).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1)]  # trend 2 had no text in its first cycle
    tps = lambda n, minutes, e, c, nov, conf: min(100.0, (0.35 * min(100, 35 * math.log2(1 + n / max(1, minutes))) + 0.25 * e + 0.25 * c + 0.15 * nov) * 1.6 * conf)
    assert got[1, 1].final_tps == pytest.approx(tps(2, 1, 90, 80, 100, 1.0))
    assert got[1, 2].final_tps == pytest.approx(tps(3, 2, 10, 30, 100, 1.0)) and got[1, 2].previous_tps == got[1, 1].final_tps
    assert got[3, 1].final_tps == pytest.approx(0.35 * 15 * 0.75) and not got[3, 1].alerted and got[3, 1].title == "text 4"
    # the first score and the second meet a previous score of nought, the third that of the first cycle
    assert [got[1, v].alerted for v in (1, 2, 3, 4)] == [True, True, False, False]
    assert [got[1, v].trajectory for v in (1, 2)] == ["up", "down" if got[1, 2].final_tps < 0.94 * got[1, 1].final_tps else "steady"]
    assert got[2, 1].title == "Named" and got[2, 1].final_tps == pytest.approx(0.55 * tps(2, 1, 90, 80, 100, 1.0))
    assert {r.trend_id: r.version for r in state.current(spark, at).collect()} == {1: 4, 2: 2, 3: 1}
    assert sorted((r.trend_id, r.version) for r in state.alerts(spark, at).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_timers_let_scores_fade(spark, places):
    folder, at = places
    how = {"decay_s": 1800.0, "late": "0 seconds", "factors": {"Spor": 0.5}, "other": 0.9}
    drain(spark, folder, at, [item(1, 1, 0), item(2, 2, 0, category=None)], **how)
    for k, minutes in enumerate((61, 95, 125, 500)):  # other trends move event time on
        drain(spark, folder, at, [item(9, 10 + k, minutes)], **how)
    steps = {}
    for r in sorted(state.changes(spark, at).filter("trend_id < 9").collect(), key=lambda r: (r.trend_id, r.version)):
        steps.setdefault(r.trend_id, []).append(r)
    for trend, factor in ((1, 0.5), (2, 0.9)):
        rows = steps[trend]
        assert [r.kind for r in rows[:2]] == ["score", "decay"] and len(rows) >= 4
        want = rows[0].final_tps
        for k, r in enumerate(rows[1:]):
            want *= factor ** (1 + k / 2)  # always from the last scoring, as the original has it
            assert r.final_tps == pytest.approx(want) and r.is_active == (want >= 2) and not r.alerted
            assert want / factor ** (1 + k / 2) > 3  # only what was above three fades


def test_state_stays_small():
    import pandas as pd

    t = state.blank()
    for k in range(40):
        t = state.met(t, pd.DataFrame([item(1, 100 - k, k, source_name=f"s{k}")], columns=COLUMNS))
    assert len(t["recent"]) == 15 and len(t["sources"]) == 5 and t["n"] == 40 and t["reference"] == 61 and t["model"] == 100
    assert state.faded(t, 0.0, {}, 0.9) is None


def test_rows_and_frames_give_one_state():
    """Items come as rows, without pandas; nulls in every field that may hold one."""
    import random

    import pandas as pd

    rng, maybe = random.Random(3), lambda x: x if rng.random() < 0.6 else None
    a = b = state.blank()
    for _ in range(12):
        items = [
            item(1, rng.randrange(10**6), rng.randrange(900), title=maybe("t"), category=maybe("Spor"), source_name=maybe(f"s{rng.randrange(4)}"), source_tier=maybe(rng.randrange(1, 4)), head=maybe("text"), similarity=maybe(rng.random()), entity=maybe(5.0), criticality=maybe(7.0), opinion=maybe(True))
            for _ in range(rng.randrange(1, 25))
        ]
        frame = pd.DataFrame(items, columns=COLUMNS)
        a, b = state.met(a, frame), state.met(b, list(frame[list(state.WANTED)].astype(object).where(frame[list(state.WANTED)].notna(), None).itertuples(index=False, name=None)))
        assert a == b and all(x is None or x == x for x in a.values())


def test_a_group_beyond_one_chunk(spark, places, monkeypatch):
    """One trend with more rows than are looked at together, over two runs, as one look at all of them."""
    import pandas as pd

    monkeypatch.setattr(state, "CHUNK", 7)
    folder, at = places
    rows = [item(1, k, 1000 - 3 * k, head=None if k < 20 else f"text {k}", source_name=f"s{k % 4}", entity=float(k)) for k in range(60)]
    drain(spark, folder, at, rows[:45])
    drain(spark, folder, at, rows[45:])
    t = state.blank()
    for part in (rows[:45], rows[45:]):
        t, found = state.scored(state.met(t, pd.DataFrame(part, columns=COLUMNS)))
    got = state.current(spark, at).collect()[0]
    assert (got.version, got.title, got.final_tps, got.previous_tps, got.tps_signal, got.trajectory) == (2, "text 20", t["final_tps"], t["previous_tps"], found["tps_signal"], found["trajectory"])
