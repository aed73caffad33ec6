"""Operators over sessions of which one has a third of all rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from panelframe.operators import folds, intervals, ledger, overlay, quality, ranks
from panelframe.sources import documents


def hot(n, seed=1):
    """(session, id, value): ids are distinct; a session is null now and then."""
    rng = random.Random(seed)
    return [("hot" if k < n // 3 else rng.choice(["a", "b", "c", None]), k, rng.choice([None, *range(5)])) for k in rng.sample(range(n), n)]


def table(spark, rows, columns="session string, id long, value long"):
    return spark.createDataFrame(rows, columns).repartition(7)


def test_numbers_go_on_over_the_ranges(spark):
    rows = hot(3000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.numbered(table(spark, rows), ["session"], [F.col("value"), F.col("id").desc()], "number").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is not None, r[2] or 0, -r[1]))
        want |= {r[1]: k for k, r in enumerate(mine, 1)}
    assert {r["id"]: r["number"] for r in got} == want and len(got) == 3000
    assert ranks.numbered(table(spark, []), ["session"], [F.col("id")], "number").count() == 0
    same = ranks.numbered(table(spark, [("x", 1, 1)] * 50), ["session"], [F.col("id")], "number")
    assert sorted(r["number"] for r in same.collect()) == list(range(1, 51))


def test_renumbered_and_rescued(spark):
    rng = random.Random(2)
    rows = [(s or "none", i, rng.choice(["blank", "context_only"] + ["keep"] * (s == "a")), rng.choice([None, 0.1, 0.2, 0.9])) for s, i, _ in hot(600)]
    rows += [("all blank", 10_000 + k, "blank", k / 10) for k in range(5)]
    got = {r["id"]: r["decision"] for r in quality.rescue(table(spark, rows, "session string, id long, decision string, blank_score double"), "session", "id").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        pool = [r for r in mine if r[2] != "blank"] or mine
        saved = {r[1] for r in sorted(pool, key=lambda r: (0.5 if r[3] is None else r[3], r[1]))[:3]} if not any(r[2] == "keep" for r in mine) else set()
        want |= {r[1]: "keep_rescued" if r[1] in saved else r[2] for r in mine}
    assert got == want
    numbers = quality.renumber(table(spark, hot(300)), "session", "id").where("session = 'hot'").orderBy("id").collect()
    assert [r["number"] for r in numbers] == list(range(1, 101))


def test_digest_is_free_of_order_and_of_nothing_else(spark):
    rows = hot(900)
    made = lambda x: {r["session"]: r["hash"] for r in quality.digest(table(spark, x), "session", "id", "value").collect()}
    one = made(rows)
    assert made(rows[::-1]) == one and len(set(one.values())) == 5
    other = [r if r[1] != 5 else (r[0], 5, 99) for r in rows]
    assert [s for s in one if made(other)[s] != one[s]] == ["hot"]
    assert made([*rows, rows[0]])[rows[0][0]] != one[rows[0][0]]


@pytest.mark.parametrize("change,valid", [(lambda x: x, True), (lambda x: x[1:], False), (lambda x: [*x, x[0]], False), (lambda x: [*x, ("hot", 9999)], False), (lambda x: [*x[1:], ("hot", 9999)], False)])
def test_orders_of_whole_sessions(spark, change, valid):
    active = [("hot", k) for k in range(300)] + [("b", 1), ("c", 2)]
    order = change(active[:300]) + [("b", 1), ("b", None), ("other", 7)]
    got = {r["session"]: r["valid"] for r in overlay.same_members(table(spark, order, "session string, id long"), table(spark, active, "session string, id long"), "session").collect()}
    assert got == {"hot": valid, "b": True, "c": False}


def test_heads_and_tails(spark):
    rows = hot(900)
    got = sorted((r["session"], r["id"], r["left_out"]) for r in ledger.head_and_tail(table(spark, [r for r in rows if r[0]] + [("few", 1, 0), ("few", 2, 0)]), "session", "id", 3, 2).collect())
    want = []
    for s in ("a", "b", "c", "hot", "few"):
        ids = [1, 2] if s == "few" else sorted(r[1] for r in rows if r[0] == s)
        want += [(s, i, max(0, len(ids) - 5)) for i in sorted({*ids[:3], *ids[-2:]})]
    assert got == sorted(want)


def test_views_and_banks(spark):
    rng = random.Random(5)
    base = [(s or "none", i, rng.randrange(9), i) for s, i, _ in hot(400)]
    edits = [(s, i, rng.choice([None, -i]), rng.random() < 0.3, None) for s, i, _, _ in base if rng.random() < 0.5]
    none = spark.createDataFrame([], "session string, id long, seq long")
    got = {r["id"]: r["display_order"] for r in overlay.edited_view(table(spark, base, "session string, id long, y_start long, panel_index long"), none, table(spark, edits, "session string, id long, position long, deleted boolean, review string"), "session").collect()}
    edit, want = {e[1]: e for e in edits}, {}
    for s in {b[0] for b in base}:
        place = lambda b: (edit.get(b[1], (0, 0, None))[2] is None, edit.get(b[1], (0, 0, None))[2] or 0, b[2], b[3])
        mine = sorted((b for b in base if b[0] == s and not edit.get(b[1], (0, 0, 0, False))[3]), key=place)
        want |= {b[1]: k for k, b in enumerate(mine, 1)}
    assert got == {b[1]: want.get(b[1]) for b in base}
    files = [(f"action/{k:04d}.wav",) for k in range(100)] + [("default/x.mp3",), ("default/y.txt",), ("reveal/z.ogg",)]
    bank = [(r["kind"], r["source"], r["k"], r["n"]) for r in documents.sound_bank(table(spark, files, "source string"), ["transition", "action", "reveal"]).orderBy("kind", "k").collect()]
    assert bank == [*(("action", f"action/{k:04d}.wav", k, 100) for k in range(100)), ("reveal", "reveal/z.ogg", 0, 1), ("transition", "default/x.mp3", 0, 1)]


def test_listing_of_many_sessions(spark):
    rules = [(s, 1, "a.json", True) for s in ("hot", "b")] + [("hot", 2, f"p{k}.png", False) for k in range(50)]
    listing = [("hot", "a.json", 0), ("b", "a.json", 5), *(("hot", f"p{k}.png", 1) for k in range(49)), ("b", "p49.png", 1)]
    got = sorted(tuple(r) for r in ledger.completeness(table(spark, rules, "session string, step int, artifact string, required boolean"), table(spark, listing, "session string, artifact string, bytes long"), "session").collect())
    assert got == [("b", 1, "", ""), ("hot", 1, "a.json empty", ""), ("hot", 2, "", "p49.png missing")]


def test_near_hashes_of_a_crowded_key(spark):
    rng = random.Random(8)
    rows = [(k, rng.getrandbits(12) if k % 3 else rng.getrandbits(63)) for k in range(400)]
    got = {r["id"]: r["duplicate_of"] for r in quality.near_hashes(table(spark, rows, "id long, hash long")).collect()}
    want = {i: min((j for j, g in rows if j < i and bin(h ^ g).count("1") <= 6), default=None) for i, h in rows}
    assert got == want
    assert quality.near_hashes(table(spark, [], "id long, hash long")).count() == 0


def test_near_hashes_are_not_broadcast(spark, monkeypatch):
    plans = []

    def final(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    settled = quality.settled
    monkeypatch.setattr(quality, "settled", lambda df: settled(final(df)))
    rng = random.Random(9)
    final(quality.near_hashes(table(spark, [(k, rng.getrandbits(12)) for k in range(300)], "id long, hash long")))
    assert len(plans) == 2 and all("isFinalPlan=true" in p and "Join" in p and "Broadcast" not in p.split("Initial Plan")[0] for p in plans)


def test_overrides_meet_texts_once(spark):
    panels = [(f"s0123abcd_p{k}" if k % 2 else f"p{k}", None if k == 4 else f"text {k}") for k in range(60)]
    overrides = [("p1", "plain"), ("s0123abcd_p1", "own"), ("p3", "plain three"), ("s9999ffff_p5", "another's"), ("p2", "two"), ("p6", "  ")]
    df = overlay.overridden(table(spark, panels, "id string, narration string"), table(spark, overrides, "id string, text string"))
    got = {r["id"]: (r["text"], r["ai_text"], r["edited"]) for r in df.collect()}
    assert got["s0123abcd_p1"] == ("own", "text 1", True) and got["s0123abcd_p3"] == ("plain three", "text 3", True) and got["p2"] == ("two", "text 2", True)
    assert got["s0123abcd_p5"] == ("text 5", "text 5", False) and got["p6"] == ("text 6", "text 6", False) and got["p4"] == ("", "", False) and len(got) == 60


def test_gutters_meet_no_rows_and_plans_split(spark):
    # One strip has most of the rows: gutters of 3 to 120 rows of the page's colour.
    rng = random.Random(9)
    rows, want = [], []
    for strip, height in (("tall", 4000), ("low", 300)):
        y = 0
        while y < height:
            art, gap = rng.randrange(20, 90), rng.randrange(1, 8)
            level = rng.choice([250.0, 252.0, 40.0])
            rows += [(strip, k, False, 100.0, 251.0) for k in range(y, y + art)] + [(strip, k, True, level, 251.0) for k in range(y + art, y + art + gap)]
            if gap >= 3 and level > 200:
                want.append((strip, y + art, y + art + gap - 1, (2 * y + 2 * art + gap - 1) // 2))
            y += art + gap
    df = table(spark, rows, "strip string, y long, mono boolean, level double, background double")
    none = spark.createDataFrame([], "strip string, f0 long, f1 long")
    found = intervals.gutters(df, none)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Join" not in intervals.runs(df, ["strip"], "y", F.col("mono"))._jdf.queryExecution().optimizedPlan().toString()
    plan = folds.fallback_plan(df, found, 200, 300).collect()
    cuts = {s: folds.absorbed([m for t, _, _, m in want if t == s], 10**9, 0) for s in ("tall", "low")}
    assert {r["strip"] for r in plan} == {"tall", "low"} or cuts
    for r in plan:
        mids = [m for t, _, _, m in want if t == r["strip"]]
        assert r["y1"] - r["y0"] <= 300 or folds._place(r["y0"], r["y1"], sorted(mids)) is None
    tall = sorted((r["y0"], r["y1"]) for r in plan if r["strip"] == "tall")
    assert all(a[1] == b[0] for a, b in zip(tall, tall[1:])) and max(b - a for a, b in tall) < 4000


def test_percentiles_of_whole_sessions(spark):
    import numpy as np

    rows = [(s, i, None if v is None else v * 7 % 11) for s, i, v in hot(900)] + [("one", 1, 4), ("none", 2, None)]
    got = {r["session"]: r for r in ranks.percentiles(table(spark, rows), "session", "value", {"a": 0.25, "b": 0.5, "c": 0.65}).collect()}
    assert set(got) == {r[0] for r in rows} and got["none"]["a"] is None and got["none"]["n"] == 1
    for s, r in got.items():
        values = [v for t, _, v in rows if t == s and v is not None]
        assert r["n"] == sum(t == s for t, _, _ in rows)
        if values:
            assert [r["a"], r["b"], r["c"]] == pytest.approx(np.percentile(values, [25, 50, 65]).tolist())
