"""Queries over all rows and whole texts: what lies past the plain queries' cuts must count."""

import itertools
import random
from datetime import datetime

from pyspark.sql import functions as F

from panelframe.operators import ledger as L
from panelframe.plans import load, registry
from panelframe.plans.timeline_queries import bank

load()


def whole(spark, tmp_path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    return registry.QUERIES[name](spark, str(tmp_path)).collect()


def test_undo_takes_the_newest_edit_in_force(spark):
    pick = random.Random(5)
    rows = [(k, i, pick.random() < 0.45) for k in range(30) for i in range(20)]
    want = set()
    for k, log in itertools.groupby(rows, lambda r: r[0]):
        stack = []
        for _, i, undo in log:
            if not undo:
                stack.append(i)
            elif stack:
                stack.pop()
        want |= {(k, i) for i in stack}
    got = L.in_force(spark.createDataFrame(rows, "k int, i int, undo boolean"), "k", "i", F.col("undo"))
    assert {(r["k"], r["i"]) for r in got.collect()} == want and got.columns == ["k", "i", "undo"]


def test_edits_of_any_event_reach_any_conversation(spark, tmp_path):
    chapters, turns = 150, 8
    talk = [(c, t, "user", "x" * 10) for c in range(chapters) for t in range(turns)]
    at = datetime(2024, 1, 1)
    # Chapter 149, panel 7: event ids 149 + 150 n with n % 8 = 7, far past 6000 and none a multiple of 5.
    nth = lambda n: 149 + chapters * n
    events = [(nth(8 * 700 + 7), at, 0, "view", 55.0, None), (nth(8 * 701 + 6), at, 0, "purchase", 1.0, None), (nth(8 * 702 + 5), at, 0, "purchase", 1.0, None), (nth(8 * 703), at, 0, "error", 1.0, None)]
    got = whole(spark, tmp_path, "f11_edit_replay", conversations=(talk, "conv_id long, turn int, role string, text string"), events=(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    last = {r["panel"]: r["seconds"] for r in got if r["chapter"] == 149}
    assert last == {0: 3.0, 1: 3.0, 2: 3.0, 3: 3.0, 4: 3.0, 5: 3.0, 7: 5.5}  # 6 is removed, 5's removal undone
    assert len(got) == chapters * turns - 1


TALK = "conv_id long, turn int, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_texts_keep_their_ends(spark, tmp_path):
    text = "word " * 400 + "end"
    talk = ([(0, 0, "user", text), (0, 1, "user", text), (0, 2, "user", "a" * 20 + "b")], TALK)
    docs = ([(1, text, "en", "s", 9), (2, text, "en", "s", 9)], DOCS)
    get = lambda name, **t: {(r[0], r[1]): r for r in whole(spark, tmp_path, name, **t)}
    assert get("e04_coverage_fill", conversations=talk)[0, 0]["text"] == text
    assert get("b37_prompt_rows", conversations=talk)[0, 1]["row"] == f"#1 [user] {text}"
    assert get("a10_srt_parse", conversations=talk)[0, 1]["caption"] == text
    synced = get("e23_caption_sync", conversations=talk)
    assert synced[0, 0]["caption"] == text[::-1] and synced[0, 2]["changed"]
    labels = ([(1, 1, 0), (2, 0, 0)], LABELS)
    rows = {r["id"]: r for r in whole(spark, tmp_path, "e12_overrides", documents=docs, labels=labels)}
    assert (rows["1"]["text"], rows["1"]["ai_text"], rows["s0123abcd_2"]["text"]) == ("edited 1", text, text)
    assert get("e21_confirmed", documents=docs, labels=labels)["s", 1]["narration"] == text


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_no_row_is_left_out(spark, tmp_path):
    orders = ([(5, 1, "F"), (6, 1, "O"), (10, 2, "P")], "o_orderkey long, o_custkey long, o_orderstatus string")
    got = whole(spark, tmp_path, "e10_continuation", orders=orders, customer=([(7,), (1,), (2,)], "c_custkey long"))
    assert {r["raw"] for r in got} == {"5", "6", "10"} and {r["audio_seconds"] for r in got if r["raw"] in "56"} == {0.5, None}
    at = datetime(2024, 1, 1)
    events = ([(i, at, 1, "purchase" if i == 9 else "view", 50.0, None) for i in range(7, 13)], EVENTS)
    got = whole(spark, tmp_path, "h03_invalidation", events=events)
    assert {r["step"]: r["status"] for r in got} == {8: "success", 9: "stale", 10: "stale", 11: "stale", 12: "stale", 1: "success"}
    assert {r["b"] for r in whole(spark, tmp_path, "c06_nearest_gutter", events=events)} == set(range(7, 13))
    docs = ([(d, "t", "en", "s", 1) for d in (3, 1003, 2003)], DOCS)
    got = whole(spark, tmp_path, "e05_first_lines", documents=docs, labels=([(1003, 1, 0), (2003, 0, 0)], LABELS))
    assert {(r["doc_id"], r["part"]) for r in got} == {(1003, "hook"), (2003, "beat")}
    spark.range(1, 101).selectExpr("id as p_partkey", "cast(id % 7 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert bank(spark, str(tmp_path)).count() == 100
