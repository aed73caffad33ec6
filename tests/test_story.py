"""Story memory against a plain fold, in batch and on a stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from panelframe.functions.text import STOP_WORDS
from panelframe.operators import story as S
from panelframe.streaming import story as live

SCHEMA = f"series string, idx long, ts timestamp, {S.UPDATE}, kind int"


def plain(updates):
    """The rows of S.story by looking through whole lists."""
    words = lambda x: set(re.findall("[a-z0-9']+", x.lower())) - set(STOP_WORDS)
    cut = lambda x, n=200: (x or "").strip().replace("\n", " ")[:n]
    out = []
    for series in {u["series"] for u in updates if u["series"] is not None}:
        cast, places, threads, events = [], [], [], []

        def whose(name, store):
            name = (name or "").strip().lower()
            return next((e for e in store if name and name in [x.strip().lower() for x in (e["name"], *e.get("aliases", ()))]), None)

        def named(hint):
            h = words(hint)
            return next((t for t in threads if t["open"] and len(h) > 1 and len(h & words(t["text"])) / len(h) >= 0.6), None)

        for u in sorted((u for u in updates if u["series"] == series and u["idx"] is not None), key=lambda u: u["idx"]):
            at = u["idx"]
            for store, seen, new in ((cast, "seen", "cast"), (places, "places_seen", "places")):
                for n in u[seen] or []:
                    if e := whose(n, store):
                        e["last"] = at
                for c in u[new] or []:
                    if not (name := cut(c["name"])):
                        continue
                    e = whose(name, store)
                    if e is None:
                        store.append({"name": name, "text": cut(c["description"]), "first": at, "last": at} | ({"role": cut(c["role"]) or "unknown", "aliases": [cut(a) for a in c["aliases"] or [] if a]} if new == "cast" else {}))
                        continue
                    e["last"] = at
                    if new == "cast":
                        e["text"] = e["text"] or cut(c["description"])
                        e["aliases"] += [a for a in dict.fromkeys(cut(a) for a in c["aliases"] or []) if a and a not in e["aliases"]]
            for hint in u["resolved"] or []:
                if t := named(hint):
                    t.update(open=False, last=at)
            for text in u["opened"] or []:
                if (text := cut(text, 300)) and not named(text):
                    threads.append({"text": text, "open": True, "first": at, "last": None})
            events = (events + [(cut(e), at) for e in u["events"] or [] if cut(e)])[-50:]
        out += [(series, "character", k, e["name"], e["role"], e["text"], tuple(e["aliases"]), None, e["first"], e["last"]) for k, e in enumerate(cast, 1)]
        out += [(series, "place", k, e["name"], None, e["text"], None, None, e["first"], e["last"]) for k, e in enumerate(places, 1)]
        out += [(series, "thread", k, f"t{k}", None, t["text"], None, "active" if t["open"] else "resolved", t["first"], t["last"]) for k, t in enumerate(threads, 1)]
        out += [(series, "event", k, None, None, e, None, None, at, None) for k, (e, at) in enumerate(events, 1)]
    return sorted(out, key=str)


def made(n, seed, hot=0):
    rng = random.Random(seed)
    some = lambda f, most=3: [f() for _ in range(rng.randrange(most))] if rng.random() < 0.5 else None
    name = lambda: rng.choice(["Ann", "ann ", "Bo", "Cy", "The Cat", "", "Dee\nDee", "Bo Bo", "x" * 250])
    text = lambda: " ".join(rng.choice("the lost sword of king red fox returns home night battle secret door key".split()) for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(n):
        series = "hot" if i < hot else rng.choice(["a", "b", "c", None])
        person = lambda: {"name": name(), "role": rng.choice([None, "ally", " "]), "description": rng.choice([None, "", "tall", "d" * 300]), "aliases": some(name)}
        place = lambda: {"name": name(), "description": rng.choice([None, "dark"])}
        rows.append({"series": series, "idx": i if rng.random() < 0.97 else None, "ts": None, "seen": some(name), "cast": some(person), "places_seen": some(name), "places": some(place), "resolved": some(text), "opened": some(text, 2), "events": some(text), "kind": 1})
    return rows


def table(spark, rows):
    from datetime import datetime, timedelta

    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    at = lambda r: datetime(2024, 1, 1) + timedelta(seconds=r["idx"] or 0)
    return spark.createDataFrame([tuple(at(r) if c == "ts" else r[c] for c in names) for r in rows], SCHEMA)


def told(rows):
    value = lambda r, c: tuple(r[c]) if c == "aliases" and r[c] is not None else r[c]
    return sorted((tuple(value(r, c) for c in ("series", *S.ENTRY)) for r in rows), key=str)


def test_memory_equals_a_plain_fold(spark):
    rows = made(400, 1, hot=150)
    assert told(S.story(table(spark, rows)).collect()) == plain(rows)
    assert S.story(table(spark, [])).count() == 0
    few = table(spark, rows).select("series", "idx", "opened")
    assert told(S.story(few).collect()) == plain([{**r, **dict.fromkeys((c for c in S.FIELDS if c != "opened"), None)} for r in rows])


def test_a_hint_closes_the_first_thread_it_names(spark):
    base = dict.fromkeys(S.FIELDS)
    rows = [
        base | {"series": "s", "idx": 1, "opened": ["The sword is lost in the lake", "Ann seeks the red door"]},
        base | {"series": "s", "idx": 2, "opened": ["sword lost in lake"], "resolved": ["lake"]},
        base | {"series": "s", "idx": 3, "resolved": ["the sword in the lake", "red door"]},
        base | {"series": "s", "idx": 4, "opened": ["sword lost in lake"]},
    ]
    rows = [r | {"ts": None, "kind": 0} for r in rows]
    got = [(r["name"], r["status"], r["first_seen"], r["last_seen"]) for r in S.story(table(spark, rows)).orderBy("pos").collect()]
    assert got == [("t1", "resolved", 1, 3), ("t2", "resolved", 1, 3), ("t3", "active", 4, None)]
    assert told(S.story(table(spark, rows)).collect()) == plain(rows)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def streamed(spark, folder, parts, name, **how):
    for k, part in enumerate(parts):
        table(spark, part).coalesce(1).write.mode("append").parquet(f"file://{folder}/in/{k:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}/in")
    q = live.story(source, **how).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"file://{folder}/ckpt").start()
    q.awaitTermination(300)
    return spark.table(name)


def test_stream_equals_batch(spark, rocks, tmp_path):
    rows = made(120, 2)
    out = streamed(spark, tmp_path, [rows[k : k + 40] for k in range(0, 120, 40)], "live_story").collect()
    # What a series remembers in the end is all it remembered last: its entries never go, but for the oldest events.
    last = {}
    for r in out:
        last.setdefault(r["series"], []).append(r)
    want = plain(rows)
    got = []
    for series, mine in last.items():
        many = sum(1 for w in want if w[0] == series)
        got += mine[-many:]
    assert told(got) == want


def test_a_silent_series_ends_its_chapter(spark, rocks, tmp_path):
    base = dict.fromkeys(S.FIELDS) | {"ts": None, "kind": 0}
    person = {"name": "Ann", "role": None, "description": None, "aliases": ["A"]}
    first = [base | {"series": "s", "idx": 10, "cast": [person], "opened": ["the sword is lost"], "events": ["a fall"]}]
    other = [base | {"series": "o", "idx": 50_000, "events": ["later"]}]
    after = [base | {"series": "o", "idx": 50_001, "events": ["later"]}]
    again = [base | {"series": "s", "idx": 50_002, "seen": ["nobody"], "events": ["anew"]}]
    out = streamed(spark, tmp_path, [first, other, after, again], "closed_story", idle="1 hour", late="1 minute").where("series = 's'")
    closed = out.where("closed").collect()
    assert sorted(r["kind"] for r in closed) == ["character", "event", "thread"] and {r["first_seen"] for r in closed} == {10}
    new = {r["kind"]: r for r in out.where("not closed").where(F.col("description").isin("anew") | (F.col("first_seen") == 0) | (F.col("kind") == "thread")).collect()}
    assert new["character"]["first_seen"] == new["character"]["last_seen"] == 0 and new["event"]["description"] == "anew" and new["thread"]["status"] == "active"


def test_only_given_fields_go_to_python(spark):
    rows = spark.createDataFrame([(k % 50, k, [f"the red door {k % 7}"]) for k in range(400)], "series long, idx long, opened array<string>")
    got = S.story(rows)
    assert {(r["series"], r["pos"]) for r in got.collect()} >= {(k, 1) for k in range(50)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "places_seen" not in plan.replace("places_seen array", "") and "MapInArrow" in plan
    none = S.story(rows.drop("opened"))
    assert none.count() == 0 and none.columns == got.columns
