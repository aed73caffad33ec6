"""Cases of single functions with known answers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelframe.functions import geometry as G
from panelframe.functions import logs as L
from panelframe.functions import text as X
from panelframe.operators import intervals as I
from panelframe.operators import overlay as O
from panelframe.operators import quality as Q
from panelframe.operators import timeline as TL
from panelframe.operators import web as W


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,ratio", [("Hello", 1.0), ("", 1.0), (None, 1.0), ("1 2 3", 1.0), ("안녕", 0.0), ("ab안녕", 0.5), ("K", 1.0)])
def test_latin_ratio(spark, text, ratio):
    assert one(spark, X.latin_ratio(F.col("t").cast("string")), t=text) == ratio


def test_foreign_bubble_goes_and_its_neighbour_stays(spark):
    r = one(spark, X.english_bubbles(F.col("t")), t="안녕하세요 / Run away! / ...")
    assert (r["kept"], r["dropped"]) == ("Run away!", 2)


def test_cleaning_twice_changes_nothing(spark):
    once = one(spark, X.strip_non_latin(F.col("t")), t="He shouts 안녕 and , leaves!!  now")
    assert once == "He shouts and, leaves! now"
    assert one(spark, X.strip_non_latin(F.col("t")), t=once) == once


@pytest.mark.parametrize("text,promo", [("Read at asurascans.com", True), ("Join our Discord server", True), ("TL: someone", True), ("FOG SWORD: RUSHING FOG STORM", False), ("I read at the table every night.", False), ("", False), (None, False)])
def test_promo(spark, text, promo):
    assert one(spark, X.is_promo(F.col("t").cast("string")), t=text) is promo


def test_domain_goes_before_its_name(spark):
    assert one(spark, X.strip_promo(F.col("t")), t="Go to asurascans.com today") == "Go to today"


@pytest.mark.parametrize("text,out", [("a  b", "a b."), ("Done!", "Done!"), ("", ""), ("say \"no\"", "say \"no\"")])
def test_normalise(spark, text, out):
    assert one(spark, X.normalise(F.col("t")), t=text) == out


def test_long_speech_keeps_whole_sentences(spark):
    words = lambda n: " ".join(["word"] * n)
    assert one(spark, X.fit_speech(F.col("t")), t=f"{words(5)}. {words(4)}. {words(30)}.") == f"{words(5)}. {words(4)}."
    assert one(spark, X.fit_speech(F.col("t")), t=f"{words(20)}. {words(20)}.") == f"{words(20)}."
    assert one(spark, X.fit_speech(F.col("t")), t=words(60)) == f"{words(10)}."
    assert one(spark, X.fit_speech(F.col("t")), t=f"{words(9)}. ... {words(30)}") == f"{words(9)}."


def test_milliseconds_round_up(spark):
    assert one(spark, X.round_ms_up(F.col("s")), s=45000 / 1350) == 33.334
    assert one(spark, X.round_ms_up(F.col("s")), s=2.0) == 2.0
    assert one(spark, X.srt_time(F.col("s")), s=3661.5) == "01:01:01,500"


def test_pans(spark):
    size = {"w": 1080, "h": 3000}
    assert one(spark, G.compute_pan(F.col("w"), F.col("h")), **size).asDict() == {"kind": "pan_down", "scaled_w": 1080, "scaled_h": 3000, "travel_px": 1080}
    assert one(spark, G.compute_pan(F.col("w"), F.col("h"), contain=True), **size)["travel_px"] == 0
    assert one(spark, G.compute_pan(F.col("w"), F.col("h")), w=0, h=5) is None


@pytest.mark.parametrize("raw,seconds", [("51s", 51.0), ("1.5s", 1.5), ("2m", 120.0), ("250ms", 0.25), ("7", 7.0), ("x", None)])
def test_durations(spark, raw, seconds):
    assert one(spark, L.duration_seconds(F.col("t")), t=raw) == seconds


@pytest.mark.parametrize("key,secret", [("apiKey", True), ("agnes_api_key", True), ("author", False), ("monkey", False), ("AUTH", True), ("keyboard", False)])
def test_sensitive_keys(spark, key, secret):
    assert one(spark, L.is_sensitive_key(F.col("k")), k=key) is secret


def test_json_is_cut_from_prose(spark):
    assert one(spark, L.json_part(F.col("t")), t='```json\n{"a": [1]}\n``` ok') == '{"a": [1]}'
    assert one(spark, L.json_part(F.col("t")), t="x [1, 2] y") == "[1, 2]"
    assert one(spark, L.json_part(F.col("t")), t="prose") is None


def test_tiles_end_at_the_height(spark):
    ends = [(t["y0"], t["y1"]) for t in one(spark, I.tiles(F.col("h")), h=4500)]
    assert ends == [(0, 2000), (1800, 3800), (3600, 4500)]
    assert one(spark, I.tiles(F.col("h")), h=0) == []


def test_cuts_depend_on_the_last_kept(spark):
    cuts = lambda values, h: one(spark, I.spaced_cuts(F.array(*[F.lit(v).cast("long") for v in values]), F.lit(h).cast("long"), 100))
    assert cuts([50, 120, 210, 390], 500) == [0, 120, 390, 500]
    assert cuts([120, 450], 500) == [0, 120, 500]


def test_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    a = [(1, k, s := rng.randrange(9000), s + rng.randrange(1, 4000)) for k in range(60)]
    b = [(1, k, s := rng.randrange(9000), s + rng.randrange(1, 4000)) for k in range(60)]
    got = I.overlapping(spark.createDataFrame(a, "s int, i int, a0 int, a1 int"), spark.createDataFrame(b, "s int, j int, b0 int, b1 int"), "s", ("a0", "a1"), ("b0", "b1"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for _, i, x0, x1 in a for _, j, y0, y1 in b if x0 < y1 and y0 < x1)


def test_near_hashes_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = base + [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in base] + base[:3]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {r["id"]: r["duplicate_of"] for r in Q.near_hashes(spark.createDataFrame([*enumerate(signed)], "id int, hash long")).collect()}
    for i, h in enumerate(hashes):
        assert got[i] == min((j for j in range(i) if (hashes[j] ^ h).bit_count() <= 6), default=None)


def test_leading_bubbles_open_the_first_scene(spark):
    rows = [(1, 1, "a", "", "Who is / there?", True), (1, 2, "b", "He runs.", "", False), (1, 3, "c", "He runs.", "", False), (1, 4, "d", "", "Stop!", True), (1, 5, "e", "She waits.", "", False)]
    panels = spark.createDataFrame(rows, "chapter int, idx int, panel_id string, narration string, dialogue string, context_only boolean").withColumn("blank", F.lit(False))
    got = {r["panel_id"]: r["text"] for r in TL.build_narration(panels).collect()}
    assert got == {"b": "Who is there? He runs. Stop!", "e": "She waits."}


def test_chain_with_a_cycle_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "session string, earlier string")
    got = sorted(tuple(r) for r in O.chains(links).collect())
    assert got == sorted([("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("b", "a", 2), ("c", "c", 0), ("c", "a", 1), ("c", "b", 2), ("d", "d", 0)])


def test_reader_images(spark):
    html = '<img src="/logo.png"><div id="readerarea"><img data-src="p1.jpg" src="loading.gif"><img src="p2.jpg"/><p style="background:url(\'b.jpg\')"></p></div><img src="/ads/x.jpg">'
    pages = spark.createDataFrame([(1, "https://x.org/c/1/", html), (2, "https://x.org/c/2/", '<img src="/uploads/a.jpg"><img src="/logo/b.jpg">')], "k int, url string, html string")
    got = [(r["k"], r["place"], r["url"]) for r in W.page_art(W.page_images(pages, "k", "html"), pages, "k", "url").orderBy("k", "place").collect()]
    assert got == [(1, 1, "https://x.org/c/1/p1.jpg"), (1, 2, "https://x.org/c/1/p2.jpg"), (1, 3, "https://x.org/c/1/b.jpg"), (2, 1, "https://x.org/uploads/a.jpg")]


@pytest.mark.parametrize("spec,kept", [("1-3", [1, 2, 3]), ("1,3,5-8", [1, 3, 5]), ("last", [5]), ("4-", [4, 5]), ("-2", [1, 2]), ("all", [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5])])
def test_range_specs(spark, spec, kept):
    rows = spark.range(1, 6).withColumnRenamed("id", "n")
    assert sorted(r["n"] for r in O.in_ranges(rows, "n", spec).collect()) == kept


def test_panel_motion_over_the_canvas(spark):
    """Covering panels move as far as their segment does, within what hangs over; small moves are holds."""
    down, right, both = (1.0, 0.99, 0.0, 233.2, 0.0, 60.0), (1.0, 0.9, 131.2, 0.0, 68.0, 0.0), (1.2, 0.99, 0.0, -466.4, 0.0, -80.0)
    rows = [(1, 1080, 3000, *down), (2, 1080, 1922, *down), (3, 2000, 1920, *right), (4, 1080, 1920, *both), (5, 1080, 2300, *both), (6, 0, 5, *down), (7, 10, 10, *right)]
    df = spark.createDataFrame(rows, "id int, w int, h int, zoom double, match_score double, dx double, dy double, dxps double, dyps double")
    m = G.panel_motion(F.col("w"), F.col("h"), F.struct("zoom", "match_score", "dx", "dy", "dxps", "dyps"), blurred=False)
    got = {r["id"]: r["m"] for r in df.select("id", m.alias("m")).collect()}
    short = lambda r: (r["kind"], r["scaled_w"], r["scaled_h"], r["travel_px"], r["pan_x_px"], r["pan_y_px"])
    assert short(got[1]) == ("pan_down", 1080, 3000, 192, 0.0, 192.0) and short(got[2]) == ("static", 1080, 1922, 0, 0.0, 0.0)
    assert short(got[3]) == ("pan_right", 2000, 1920, 86, 86.0, 0.0)  # a tenth of the width, damped to 0.8
    assert short(got[4]) == ("zoom_in", 1080, 1920, 0, 0.0, 0.0)  # nothing hangs over
    assert short(got[5]) == ("pan_up", 1188, 2530, 384, 0.0, -384.0)  # a tenth closer
    assert got[6] is None and (got[7]["scaled_w"], got[7]["kind"]) == (40, "static")


def test_small_rules(spark):
    from panelframe.functions import geometry as G
    from panelframe.functions.text import progress_seconds

    lines = [("x time=01:02:03.5 y",), ("time=1:00:00,25",), ("time=N/A",), (None,), ("time=0:61:99",)]
    assert [r[0] for r in spark.createDataFrame(lines, "l string").coalesce(1).select(progress_seconds(F.col("l"))).collect()] == [3723.5, 3600.25, None, None, 3759.0]
    ranges = [(-5, 25, 100), (-5, 24, 100), (80, 200, 109), (80, 200, 110), (50, 40, 100)]
    got = [r[0] for r in spark.createDataFrame(ranges, "a int, b int, h int").coalesce(1).select(G.saved_range(F.col("a"), F.col("b"), F.col("h"))).collect()]
    assert [None if r is None else tuple(r) for r in got] == [None, None, None, (80, 110), None]


def test_foreign_characters_for_java(spark):
    """The pattern that Java reads fast is FOREIGN, for every character."""
    every = spark.range(1, 0x20000).where("id not between 55296 and 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    assert every.where(F.col("c").rlike(X.FOREIGN) != F.col("c").rlike(X._FOREIGN)).count() == 0
    assert every.where(F.col("c").rlike(X._FOREIGN)).count() > 100_000


def test_batches_of_pages_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 48, 1, 1).select("id", F.concat(F.lit("<img src='a.png'>"), F.repeat(F.lit("x"), 1 << 20)).alias("html"))

    @F.arrow_udf("long")
    def together(a: pa.Array) -> pa.Array:
        return pa.array([len(a)] * len(a))

    assert W.page_images(pages, "id", "html").count() == 48
    assert max(r[0] for r in pages.select(together("html")).collect()) <= 8
