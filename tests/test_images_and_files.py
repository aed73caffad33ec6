"""Images written here, read by Spark's image source; documents, subtitles and folds with known answers."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelframe.operators import folds
from panelframe.operators import pixels as P
from panelframe.sources import documents as D


def write_png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("png")
    rng = np.random.default_rng(7)
    art = np.full((400, 80, 3), 255)
    art[100:300] = rng.integers(30, 210, (200, 80, 3))
    write_png(folder / "art.png", art)
    red = np.zeros((60, 40, 3))
    red[..., 0] = 200
    write_png(folder / "red.png", red)
    return P.row_metrics(spark.read.format("image").load(f"file://{folder}")).withColumn("strip", F.element_at(F.split("strip", "/"), -1)).cache()


def test_row_metrics(rows):
    r = {x["y"]: x for x in rows.where("strip = 'art.png'").collect()}
    assert len(r) == 400 and r[0]["mono"] == 1.0 and r[0]["variance"] == 0.0 and r[0]["flat"] and r[0]["white"] == 1.0
    assert not r[150]["flat"] and r[150]["edge"] > 20 and r[150]["entropy"] > 4
    red = rows.where("strip = 'red.png'").first()
    assert abs(red["mean"] - 0.299 * 200) < 1e-9 and red["saturated"] == 1.0  # channels come as blue, green, red


def test_blur_and_edges_by_hand():
    step = np.array([[0.0, 0, 0, 100, 100, 100]] * 4)
    assert P.sobel_x(step).tolist() == [[0, 0, 400, 400, 0, 0]] * 4  # (1 + 2 + 1) times the step on both its sides
    dot = np.zeros((5, 5))
    dot[2, 2] = 200
    side, middle = np.exp(-2) / (1 + 2 * np.exp(-2)), 1 / (1 + 2 * np.exp(-2))
    soft = P.blurred(dot)
    assert soft[2, 2] == round(200 * middle * middle) and soft[1, 2] == soft[2, 3] == round(200 * side * middle) and soft[1, 1] == round(200 * side * side) and soft[0].sum() == 0
    assert P.sobel_x(np.array([[1.0, 2, 4]])).tolist() == [[0, 12, 0]]  # one row stands for its neighbours, the ends are mirrored
    assert P.entropy_of(np.array([[4, 4, 0], [8, 0, 0]])).tolist() == [1.0, 0.0]


def test_window_signals(spark, tmp_path):
    """A window's entropy and colour spread are those of all its pixels, not of its rows."""
    px = np.zeros((32, 10, 3))
    px[:16] = 128
    px[1:16:2] = 32  # rows of one level each, in turns
    px[16:, :5], px[16:, 5:] = (90, 60, 60), (60, 60, 90)
    write_png(tmp_path / "w.png", px)
    rows = P.row_metrics(spark.read.format("image").load(f"file://{tmp_path}"))
    assert rows.agg(F.max("entropy")).first()[0] == 1.0 and rows.where("y < 16").agg(F.max("entropy")).first()[0] == 0.0
    first, second = P.windows(rows).orderBy("w").collect()
    assert first["entropy"] == 1.0 and first["variance"] == 0.0 and first["coarse_mean"] == 128.0 and first["coarse_square"] == 128.0**2
    gray = px[16:] @ [0.299, 0.587, 0.114]
    block = px[16:].reshape(-1, 3)
    assert abs(second["spread"] - np.sqrt(((block - np.median(block, 0)) ** 2).sum(1)).std()) < 1e-9
    assert abs(second["mean"] - gray.mean()) < 1e-9


def test_a_fade_and_stripes_are_no_blank(spark, tmp_path):
    fade = np.repeat(np.linspace(40, 220, 640)[:, None, None], 40, 1).repeat(3, 2)
    stripes = np.full((640, 40, 3), 200)
    stripes[(np.arange(640) // 16) % 2 == 1] = 190
    flat = np.full((640, 40, 3), 240)
    for name, px in {"fade": fade, "stripes": stripes, "flat": flat}.items():
        write_png(tmp_path / f"{name}.png", px)
    rows = P.row_metrics(spark.read.format("image").load(f"file://{tmp_path}")).withColumn("strip", F.element_at(F.split("strip", "/"), -1))
    got = {r["strip"]: r for r in P.blank_regions(P.windows(rows), rows.groupBy("strip").agg((F.max("y") + 1).alias("height"))).collect()}
    assert got["flat.png"]["verdict"] == "blank" and got["flat.png"]["score"] == 1.0 and "low entropy" in got["flat.png"]["reasons"]
    # The fade's levels vary at a coarse look by far more than 24, the stripes' by 25.
    assert "fade.png" not in got and "stripes.png" not in got


def test_margins_background_and_bands(rows):
    assert [tuple(r) for r in P.trimmed(rows).orderBy("strip").collect()] == [("art.png", 100, 300), ("red.png", 0, 60)]
    assert {r["strip"]: round(r["background"]) for r in P.background(rows).collect()} == {"art.png": 255, "red.png": 60}
    # The edge kernel reaches one row beyond the art.
    assert [tuple(r) for r in P.text_band(rows).collect()] == [("art.png", 99, 300)]
    assert sorted((r["lo"], r["hi"]) for r in P.gutter_rows(rows).where("strip = 'art.png'").collect()) == [(0, 99), (300, 399)]


def test_blank_regions(rows):
    w = P.windows(rows)
    got = P.blank_regions(w, rows.groupBy("strip").agg((F.max("y") + 1).alias("height"))).where("strip = 'art.png'").collect()
    assert sorted((r["y0"], r["y1"], r["verdict"]) for r in got) == [(0, 96, "blank"), (304, 400, "blank")]


def test_crop_scores(spark, rows):
    crops = spark.createDataFrame([("art.png", 1, 0, 50), ("art.png", 2, 120, 200), ("none.png", 3, 0, 10)], "strip string, id int, y0 int, y1 int")
    got = {r["id"]: r for r in P.crop_scores(rows, crops).collect()}
    assert got[1]["white"] == 1.0 and abs(got[2]["variance"] - rows.where("strip = 'art.png' and y between 120 and 199").agg(F.avg("variance")).first()[0]) < 1e-6
    assert got[3]["method"] == "missing"


def test_region_metrics(spark, tmp_path):
    px = np.full((40, 20, 3), 50)
    px[10:20, 8:12] = 150
    write_png(tmp_path / "r.png", px)
    images = spark.read.format("image").load(f"file://{tmp_path}")
    origin = images.select("image.origin").first()[0]
    panels = spark.createDataFrame([(origin, "a", 5, 25), (origin, "b", 25, 40), (origin, "c", 60, 70), ("none", "d", 0, 5)], "strip string, id string, y0 int, y1 int")
    got = {r["id"]: r for r in P.region_metrics(images, panels).collect()}
    gray = px[5:25, :, 0].astype(float)
    assert got["a"]["variance"] == round(gray.var(), 2) and got["a"]["fg_ratio"] == 0.1 and got["a"]["width"] == 20 and got["a"]["height"] == 20
    assert got["a"]["entropy"] == round(-(0.1 * np.log2(0.1) + 0.9 * np.log2(0.9)), 3)
    # Four edge columns of height 8, weighted 4 within and 3 and 1 about the two ends: (8 * 4 + 2 * 3 + 2 * 1) * 100 * 4 / 400.
    assert got["a"]["edge_density"] == 40.0
    assert got["b"]["variance"] == got["b"]["edge_density"] == got["b"]["entropy"] == 0.0 and got["c"]["fg_ratio"] == 0.0 and set(got) == {"a", "b", "c"}


def test_padding_and_sources_of_scores(spark):
    rows = spark.createDataFrame([("s", y, 1.0 if y < 3 or y > 7 else 0.5) for y in range(10)] + [("t", y, 1.0) for y in range(4)], "strip string, y int, dark double")
    assert sorted(tuple(r) for r in P.black_padding(rows).collect()) == [("s", 3, 8), ("t", 0, 4)]
    panels = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("s", 4)], "strip string, id int")
    crops = spark.createDataFrame([("s", 1, 0, 5, 1.0), ("s", 2, 5, 5, 2.0), ("s", 3, 0, 5, None)], "strip string, id int, y0 int, y1 int, v double")
    files = spark.createDataFrame([("s", 1, 9.0), ("s", 2, 8.0), ("s", 4, None)], "strip string, id int, v double")
    got = {r["id"]: (r["v"], r["method"]) for r in P.source_of_scores(panels, crops, files, ["v"]).collect()}
    assert got == {1: (1.0, "strip_crop"), 2: (8.0, "padding_stripped"), 3: (None, "missing"), 4: (None, "missing")}


def test_fallback_plan_splits_and_drops(spark):
    rows = spark.createDataFrame([("s", y) for y in range(1000)] + [("t", y) for y in range(30)], "strip string, y int")
    found = spark.createDataFrame([("s", 100), ("s", 103), ("s", 500), ("s", 997)], "strip string, mid long")
    got = sorted(tuple(r) for r in folds.fallback_plan(rows, found, 4, 450).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("s", 1, 0, 100), ("s", 2, 100, 500), ("s", 3, 500, 1000), ("t", 1, 0, 30)] and {r[4:] for r in got} == {("unknown", 0.0)}
    got = sorted(tuple(r)[:4] for r in folds.fallback_plan(rows, found, 450, 300).collect())
    # 100 and 103 are too far from the middle; the strip under the least distance has one cut alone, so no panel.
    assert got == [("s", 1, 0, 500), ("s", 2, 500, 1000)]


def test_motion_templates(spark, tmp_path):
    segment = lambda n: {"seg": n, "t0": 0, "t1": 1, "dur": 1, "zoom": 1, "matchScore": 0.9, "dx": 0, "dy": 1, "dxps": 0, "dyps": 1}
    (tmp_path / "a.json").write_text(json.dumps({"name": "x", "reference_width": 100, "segments": [segment(3), segment(1), segment(2)]}))
    t = D.motion_templates(spark, f"file://{tmp_path}/a.json")
    assert (t.first()["reference_width"], t.first()["reference_height"], t.first()["low_confidence_damping"]) == (100.0, 2332.0, 0.6)
    assert [r["seg"] for r in D.template_segments(t).orderBy("pos").collect()] == [1, 2, 3]
    for k, bad in enumerate(({"name": "x"}, {"segments": []}, {"segments": [{"seg": 1}]})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="no whole segments"):
            D.motion_templates(spark, f"file://{tmp_path}/bad{k}.json").collect()


def test_thin_panels_join_the_taller_neighbour():
    assert folds.absorbed([100, 110, 300], 500, 50) == [100, 300]
    assert folds.absorbed([10], 500, 50) == [] and folds.absorbed([], 20, 50) == []
    assert folds.absorbed([100, 120], 220, 50) == [120]  # equal neighbours: upwards


def test_splits_are_balanced():
    assert folds.pieces(0, 4000, "p", [2000, 900, 3100], 1600) == [("paa", 0, 900), ("pab", 900, 2000), ("pba", 2000, 3100), ("pbb", 3100, 4000)]
    assert folds.pieces(0, 4000, "p", [100], 1600) == [("p", 0, 4000)] and folds.pieces(0, 10, "p", [], 1600) == [("p", 0, 10)]


def test_document_kinds(spark, tmp_path):
    for name, body in {"a": {"panels": [{"id": "1", "image_file": "x.png", "y_start": 3}]}, "b": {"panels": [{"id": "2", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}]}, "c": {"entries": [{"panel_index": 1, "y_start": 0, "y_end": 9}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "d.json").write_text('{"panels": [')
    docs = D.panel_documents(spark, f"file://{tmp_path}").cache()
    assert {r["path"][-6]: r["kind"] for r in docs.collect()} == {"a": "cut", "b": "page", "c": "plan", "d": "corrupt"}
    assert D.panels_of(docs).count() == 2 and D.plan_entries(docs).first()["y_end"] == 9


def test_subtitles_there_and_back(spark, tmp_path):
    from panelframe.operators.timeline import srt_blocks

    cues = spark.createDataFrame([(1, 1, 0, 0.0, 1.5, "One two"), (1, 2, 0, 61.25, 62.0, "Three")], "chapter int, idx int, cue int, start double, end double, caption string")
    D.write_blocks(srt_blocks(cues), f"file://{tmp_path}/srt")
    got = D.read_srt(spark, f"file://{tmp_path}/srt/chapter=1").orderBy("number").collect()
    assert [(r["number"], r["start"], r["end"], r["caption"]) for r in got] == [(1, 0.0, 1.5, "One two"), (2, 61.25, 62.0, "Three")]


def test_cut_off_array_keeps_what_is_whole(spark):
    rows = spark.createDataFrame([(1, 'x {"lines": [{"a": {"b": "}]"}}, {"a": 2}, {"a": '), (2, "none"), (3, '{"lines": []}'), (4, None)], "k int, t string")
    assert [(r["k"], r["pos"], r["item"]) for r in D.salvaged(rows, "k", "t").collect()] == [(1, 0, '{"a": {"b": "}]"}}'), (1, 1, '{"a": 2}')]


def test_pages_in_natural_order(spark):
    pages = spark.createDataFrame([("c/p10.png", 5, 9), ("c/p2.png", 5, 9), ("c/p2_1.png", 5, 9), ("c/wide.png", 9, 5), ("c/ad.png", 5, 9)], "path string, w int, h int")
    got = [(r["path"], r["reason"]) for r in D.page_order(pages, "path", ["ad"]).orderBy("sort_key").collect()]
    assert got == [("c/ad.png", "named"), ("c/p2.png", None), ("c/p2_1.png", "repeated"), ("c/p10.png", None), ("c/wide.png", "landscape")]


def test_first_backup_wins(spark, tmp_path):
    path = f"file://{tmp_path}/rejects"
    D.keep_first_backup(spark.range(3), path)
    D.keep_first_backup(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    meta = D.with_provenance(spark.range(1), "g", "h", inputs={"strip": "abc"}).first()["meta"]
    assert meta["generator"] == "g" and meta["input_hashes"] == {"strip": "abc"} and D.with_provenance(spark.range(1), "g", "h").first()["meta"]["input_hashes"] == {}


def test_bars_and_colours(spark, tmp_path):
    rng = np.random.default_rng(3)
    framed = np.zeros((300, 120, 3))
    framed[20:290, 15:113] = rng.integers(0, 256, (270, 98, 3))
    framed[100, :] = 0  # a dark line within
    framed[5, 40:44] = 250  # a bar may have a few lit pixels: 4 of 120
    plain = rng.integers(0, 256, (17, 9, 3)).astype(float)
    images = {"framed": framed, "plain": plain, "dark": np.zeros((30, 10, 3)), "grey": np.full((4, 4, 3), 99.0)}
    for name, px in images.items():
        write_png(tmp_path / f"{name}.png", px)
    read = spark.read.format("image").load(f"file://{tmp_path}")
    short = lambda r: r["strip"].rsplit("/", 1)[1][:-4]
    got = {short(r): tuple(r)[1:] for r in P.bars(P.line_profiles(read)).collect()}
    assert got == {"framed": (20, 10, 15, 7), "plain": (0, 0, 0, 0), "dark": (30, 30, 10, 10), "grey": (0, 0, 0, 0)}
    for rows in (7, 256):
        stats = {short(r): r for r in P.colour_stats(P.shade_parts(read, rows)).collect()}
        for name, px in images.items():
            px = px.astype(np.uint8).astype(float)
            light, most, least, r = px @ np.array([0.299, 0.587, 0.114]), px.max(2), px.min(2), stats[name]
            near = lambda c, v, to=0.051: abs(r[c] - v) <= to
            assert near("brightness", light.mean()) and near("contrast", light.std()) and near("red", px[..., 0].mean()) and near("blue", px[..., 2].mean())
            assert near("p5", np.percentile(light, 5)) and near("p95", np.percentile(light, 95))
            assert near("saturation", np.where(most > 0, (most - least) / np.maximum(most, 1), 0).mean(), 0.00051)


def test_plans_of_other_sizes(spark):
    from panelframe.functions import geometry as G

    entry = "array(named_struct('y0', 10, 'y1', 21, 'boxes', array(named_struct('x', 1, 'y', 3, 'w', 5, 'h', 7))))"
    cases = [(100, 200, 100, 200), (100, 200, 50, 100), (100, 200, 50, 104), (100, 200, 50, 120), (100, 0, 50, 100), (None, 200, 50, 100)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, pw int, ph int, w int, h int")
    got = [r["r"] for r in df.select("k", G.rescaled(F.expr(entry), (F.col("pw"), F.col("ph")), (F.col("w"), F.col("h"))).alias("r")).orderBy("k").collect()]
    flat = lambda r: None if r["entries"] is None else (r["entries"][0]["y0"], r["entries"][0]["y1"], *r["entries"][0]["boxes"][0])
    assert [(flat(r), r["scaled"], r["problem"]) for r in got] == [
        ((10, 21, 1, 3, 5, 7), False, None),
        ((5, 10, 0, 2, 2, 4), True, None),
        ((5, 11, 0, 2, 2, 4), True, None),
        (None, False, "aspect"),
        (None, False, "size"),
        (None, False, "size"),
    ]
