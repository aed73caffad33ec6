"""Chains, prefixes, near hashes, cuts and carried memory with known answers."""

import random

from pyspark.sql import functions as F

from panelframe.functions import logs as G
from panelframe.operators import folds
from panelframe.operators import intervals as I
from panelframe.operators import memory as M
from panelframe.operators import overlay as O
from panelframe.operators import quality as Q


def test_long_chains_and_loops(spark):
    """A chain of 1500 sessions gives over a million rows; a loop ends where it closes."""
    rows = [(k, k - 1 if k else None) for k in range(1500)] + [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 5001), (7000, 7000), (8000, 9999)]
    got = O.chains(spark.createDataFrame(rows, "session long, earlier long"))
    by = {r["session"]: (r["n"], r["deepest"]) for r in got.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).collect()}
    assert all(by[k] == (k + 1, k) for k in range(1500)) and set(by) == {*range(1500), 5000, 5001, 5002, 6000, 7000, 8000}
    some = {(r["session"], r["depth"]): r["ancestor"] for r in got.where("session >= 5000 or session = 1499").collect()}
    assert some[1499, 1499] == 0 and [some[6000, d] for d in range(4)] == [6000, 5001, 5002, 5000] and by[6000] == (4, 3)
    assert by[5000] == (3, 2) and by[7000] == (1, 0) and some[8000, 1] == 9999


def test_prefixes_of_any_length(spark):
    known = spark.createDataFrame([("abcdef",), ("abcxyz",), ("b",), ("b",), ("abc",)], "name string")
    asked = spark.createDataFrame([("a",), ("abcd",), ("abcx",), ("b",), ("abc",), ("zz",), ("",)], "q string")
    got = {r["q"]: r["name"] for r in O.resolve_prefix(asked, known).collect()}
    assert got == {"a": None, "abcd": "abcdef", "abcx": "abcxyz", "b": "b", "abc": "abc", "zz": None, "": None}
    assert {r["q"]: r["name"] for r in O.resolve_prefix(asked, known, 5).collect()}["abcd"] is None


def test_near_hashes_lose_no_pair(spark):
    rng = random.Random(6)
    hashes = []
    for _ in range(60):
        base = rng.getrandbits(64)
        hashes += [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 0, 3, 6, 7)]
    valid = [rng.random() < 0.8 for _ in hashes]
    want = {i: min((j for j in range(i) if valid[i] and valid[j] and (hashes[i] ^ hashes[j]).bit_count() <= 6), default=None) for i in range(len(hashes))}
    rows = [(i, h - (1 << 64) if h >> 63 else h, v) for i, (h, v) in enumerate(zip(hashes, valid))]
    panels = spark.createDataFrame(rows, "id int, hash long, valid boolean")
    for agree in (None, 1, 3):
        got = {r["id"]: r["duplicate_of"] for r in Q.near_hashes(panels, valid=F.col("valid"), agree=agree).collect()}
        assert got == want
    masks = Q._agreeing(6, 2)
    assert len(masks) == 28 and len({m & ((1 << 64) - 1) for m in masks}) == 28


def test_cuts_from_entries(spark):
    """Overlap repaired to the middle, a boundary without a gutter joins its entries, thin panels are absorbed."""
    entries = spark.createDataFrame([("s", 0, 10, 110, " one "), ("s", 1, 90, 300, ""), ("s", 2, 310, 330, "thin"), ("s", 3, 340, 500, "four"), ("s", 4, 520, 700, "five")], "strip string, k int, y0 long, y1 long, text string")
    boundaries = I.entry_boundaries(entries)
    assert [(r["k"], r["b"]) for r in boundaries.orderBy("k").collect()] == [(1, 100), (2, 305), (3, 335), (4, 510)]
    found = spark.createDataFrame([("s", 94, 98), ("s", 300, 306), ("s", 331, 337)], "strip string, lo long, hi long")
    weak = spark.createDataFrame([("s", 505, 509), ("s", 100, 101)], "strip string, lo long, hi long")
    heights = spark.createDataFrame([("s", 800)], "strip string, height long")
    strict = I.nearest_run(boundaries, found, [5, 10])
    got = [(r["y0"], r["y1"], r["text"], r["members"], r["top_snap"], r["bottom_snap"]) for r in I.build_cuts(entries, heights, strict).orderBy("panel").collect()]
    assert got == [(0, 96, "one", [0], None, 4), (96, 303, "", [1], 4, 2), (303, 334, "thin", [2], 2, 1), (334, 800, "four five", [3, 4], 1, None)]
    relaxed = I.nearest_run(boundaries, found, [5, 10], weak)
    assert {r["k"]: r["cut"] for r in relaxed.collect()} == {1: 96, 2: 303, 3: 334, 4: 507}
    kept = folds.absorb_thin(relaxed.select("strip", "cut").join(heights, "strip"), 60)
    fewer = I.without_thin(relaxed, kept)
    got = [(r["y0"], r["y1"], r["text"]) for r in I.build_cuts(entries, heights, fewer).orderBy("panel").collect()]
    assert got == [(0, 96, "one"), (96, 334, "thin"), (334, 507, "four"), (507, 800, "five")]  # the one above is the taller


def test_blank_regions_on_panels(spark):
    panels = spark.createDataFrame([("s", i, 1000 * i, 1000 * i + 600) for i in range(7)] + [("t", 0, 0, 100)], "strip string, id int, p0 long, p1 long")
    rows = [("s", 0, 590, 0.95, "blank"), ("s", 990, 1100, 0.95, "blank"), ("s", 2560, 2700, 0.95, "blank"), ("s", 3200, 3300, 0.92, "blank"), ("s", 4010, 4300, 0.9, "blank"), ("s", 4290, 4590, 0.9, "blank"), ("s", 5100, 5200, 0.7, "suspicious"), ("t", 20, 40, 0.7, "suspicious")]
    regions = spark.createDataFrame(rows, "strip string, b0 long, b1 long, score double, verdict string")
    got = {(r["strip"], r["id"]): (r["p0"], r["p1"], r["flag"], r["score"]) for r in I.without_blanks(panels, regions).collect()}
    assert ("s", 0) not in got and got["s", 1] == (1100, 1600, None, None) and got["s", 2] == (2000, 2560, None, None)
    assert got["s", 3] == (3000, 3600, "suspicious", 0.92) and got["s", 6] == (6000, 6600, None, None)
    assert got["s", 5] == (5000, 5600, None, None) and got["t", 0] == (0, 100, "suspicious", 0.7)
    # Two bands cover the fourth panel by 98 %.
    assert ("s", 4) not in got


def test_memory_goes_on_without_counters(spark):
    entries = spark.createDataFrame([(1, 1, "character", "Mo"), (1, 1, "event", "fall"), (1, 2, "thread", "lost key"), (1, 3, "character", "Mo"), (2, 1, "character", "Al")], "series int, chapter int, kind string, name string")
    got = sorted(tuple(r) for r in M.carried_forward(entries, entries).collect())
    assert got == [(1, 2, "character", "Mo", 0, 0), (1, 3, "character", "Mo", 0, 0), (1, 3, "thread", "lost key", 0, 0)]


def test_accepted_names(spark):
    names = {"m-2.5": ["Large 2.5"], "m-2.0": []}
    rows = spark.createDataFrame([("LARGE_25",), ("m-7",), ("M 2 0",), ("other",), (None,)], "raw string")
    assert [r[0] for r in rows.select(G.accepted_name(F.col("raw"), names, "m-")).collect()] == ["m-2.5", "m-7", "m-2.0", "other", None]


def test_page_panels(spark):
    cuts = spark.createDataFrame([("s", 800, "001", 1, 30, 90, "p.png")], "strip string, width int, id string, k int, y0 int, y1 int, image_file string")
    r = I.page_panels(cuts).first()
    assert tuple(r["bbox"]) == (0, 30, 800, 60) and (r["page"], r["index"], r["reading_order"]) == (1, 1, "top_to_bottom")
