"""The replay of edits against an editor that keeps copies of everything."""

import copy
import random

from panelframe.operators import editor as E

PANELS = "chapter long, panel string, position long, seconds double"
CAPTIONS = "chapter long, id string, panel string, text string, start double, end double"
EDITS = "chapter long, seq long, op string, panel string, other string, text string, number double, order array<string>"


def plain(panels, captions, edits):
    out = []
    for chapter in {p[0] for p in panels} | {e[0] for e in edits}:
        mine, at = [], 0.0
        for _, p, _, s in sorted((p for p in panels if p[0] == chapter), key=lambda p: p[2]):
            mine.append({"id": p, "s": s, "auto": s, "from": round(at, 3)})
            at += s
        first = copy.deepcopy(mine)
        caps = {c[1]: {"p": c[2], "text": c[3], "a": c[4], "b": c[5], "a0": c[4], "b0": c[5]} for c in captions if c[0] == chapter}
        effects, joins, past, future = {}, {}, [], []

        def rejoin():
            keys = [(x["id"], y["id"]) for x, y in zip(mine, mine[1:])]
            old = dict(joins)
            joins.clear()
            joins.update({k: old.get(k, ("cut", 0.5)) for k in keys})

        def begins():
            t, got = 0.0, []
            for e in mine:
                got.append(round(t, 3))
                t += e["s"]
            return got

        def retime(p):
            k = [e["id"] for e in mine].index(p)
            e, a = mine[k], begins()[k]
            b = a + e["s"]
            scale, own_a, own_b = (b - a) / max(e["auto"], 0.01), e["from"], e["from"] + e["auto"]
            if scale != 1.0:
                own_a, own_b = own_a or a, own_b or b
            for c in caps.values():
                if c["p"] == p:
                    c["a"], c["b"] = round(a + (c["a0"] - own_a) * scale, 3), round(b + (c["b0"] - own_b) * scale, 3)

        def act(what):
            nonlocal mine
            name, *x = what
            if name == "timeline":
                mine = copy.deepcopy(x[0])
                rejoin()
            elif name == "seconds" and x[0] in [e["id"] for e in mine]:
                k = [e["id"] for e in mine].index(x[0])
                mine[k]["s"] = x[1]
                retime(x[0])
                b = begins()
                for j, e in enumerate(mine):
                    if b[j] >= b[k] + x[1]:
                        retime(e["id"])
            elif name == "effect" and x[0] in effects:
                effects[x[0]] = x[1]
            elif name == "text" and x[0] in caps:
                caps[x[0]]["text"] = x[1]
            elif name == "join" and x[0] in joins:
                joins[x[0]] = x[1]

        rejoin()
        for _, _, op, p, other, text, number, order in sorted((e for e in edits if e[0] == chapter), key=lambda e: e[1]):
            ids, before = [e["id"] for e in mine], copy.deepcopy(mine)
            step = None
            if op == "undo" and past:
                future.append(past.pop())
                act(future[-1][0])
            elif op == "redo" and future:
                past.append(future.pop())
                act(past[-1][1])
            elif op == "reset":
                mine, past, future = copy.deepcopy(first), [], []
                rejoin()
            elif op == "reorder":
                by = {e["id"]: e for e in mine}
                mine = [by[i] for i in order if i in by]
                rejoin()
                step = ("timeline", before), ("timeline", copy.deepcopy(mine))
            elif op == "duration" and p in ids:
                e = mine[ids.index(p)]
                was, e["s"] = e["s"], round(max(number, 0.1), 3)
                retime(p)
                step = ("seconds", p, was), ("seconds", p, e["s"])
            elif op == "remove":
                mine = [e for e in mine if e["id"] != p]
                caps = {i: c for i, c in caps.items() if c["p"] != p}
                effects.pop(p, None)
                rejoin()
                step = ("timeline", before), ("timeline", copy.deepcopy(mine))
            elif op == "add" and p in [e["id"] for e in first]:
                new = copy.deepcopy(next(e for e in first if e["id"] == p))
                mine.insert(len(mine) if not other else ids.index(other) + 1 if other in ids else 0, new)
                rejoin()
                step = ("timeline", before), ("timeline", copy.deepcopy(mine))
            elif op == "effect":
                was, effects[p] = effects.get(p, ("static", 0.0)), (text, round(number, 3))
                step = ("effect", p, was), ("effect", p, effects[p])
            elif op == "caption" and p in caps:
                was, caps[p]["text"] = caps[p]["text"], text
                step = ("text", p, was), ("text", p, text)
            elif op == "transition":
                was, joins[p, other] = joins.get((p, other), ("cut", 0.5)), (text, round(number, 3))
                step = ("join", (p, other), was), ("join", (p, other), joins[p, other])
            if step:
                past, future = [*past, step][-200:], []
        b = begins()
        out += [(chapter, "panel", k + 1, e["id"], None, None, b[k], e["s"]) for k, e in enumerate(mine)]
        out += [(chapter, "caption", k + 1, i, c["p"], c["text"], c["a"], round(c["b"] - c["a"], 3)) for k, (i, c) in enumerate(sorted(caps.items()))]
        out += [(chapter, "transition", k + 1, x, y, t, None, s) for k, ((x, y), (t, s)) in enumerate(joins.items())]
        out += [(chapter, "effect", k + 1, i, None, t, None, s) for k, (i, (t, s)) in enumerate(sorted(effects.items()))]
    return sorted(out, key=str)


def run(spark, panels, captions, edits):
    got = E.edited(spark.createDataFrame(panels, PANELS), spark.createDataFrame(captions, CAPTIONS), spark.createDataFrame(edits, EDITS))
    return sorted((tuple(r) for r in got.collect()), key=str)


def edits(rng, n, chapters, ops):
    out = []
    for seq in range(n):
        c, p = rng.choice(chapters), f"p{rng.randrange(9)}"
        op = rng.choice(ops)
        order = rng.sample([f"p{k}" for k in range(9)], rng.randrange(5, 10)) if op == "reorder" else None
        out.append((c, seq, op, f"c{rng.randrange(6)}" if op == "caption" else p, rng.choice([None, "", f"p{rng.randrange(9)}"]) if op == "add" else f"p{rng.randrange(8)}", rng.choice(["fade", "zoom_in", "new words"]), rng.choice([0.05, 0.5, 1.2345, 3.0, 8.0]), order))
    return out


OPS = ["reorder", "duration", "duration", "remove", "add", "add", "effect", "caption", "transition", "undo", "undo", "redo", "redo", "nothing"]


def test_replay_equals_an_editor_of_copies(spark):
    rng = random.Random(6)
    panels = [(c, f"p{k}", k, rng.choice([0.0, 1.5, 2.25, 3.1])) for c in range(8) for k in range(8)]
    captions = [(c, f"c{k}", f"p{k}", "said", 0.3 + k, 1.1 + k) for c in range(8) for k in range(6)]
    # Chapter 0 has a third of all edits; 3 has a reset; 9 has edits and no panels.
    log = edits(rng, 900, [0, 0, 0, 1, 2, 3, 4, 5, 9], OPS) + [(3, 450, "reset", None, None, None, None, None)]
    assert run(spark, panels, captions, log) == plain(panels, captions, log)


def test_two_hundred_steps_can_be_undone(spark):
    rng = random.Random(7)
    panels = [(1, f"p{k}", k, 2.0) for k in range(6)]
    log = edits(rng, 230, [1], ["duration", "effect", "reorder"]) + [(1, 1000 + k, "undo", None, None, None, None, None) for k in range(205)]
    log += [(1, 2000 + k, "redo", None, None, None, None, None) for k in range(7)] + [(1, 3000, "duration", "p1", None, None, 4.0, None), (1, 3001, "redo", None, None, None, None, None)]
    got = run(spark, panels, [], log)
    assert got == plain(panels, [], log) and got


def test_empty_and_null_rows(spark):
    assert run(spark, [], [], []) == []
    panels = [(1, "a", 1, None), (1, None, 2, 1.0), (None, "a", 1, 1.0), (1, "b", 3, 2.0), (1, "b", 3, 2.0)]
    log = [(1, 1, None, "a", None, None, None, None), (1, 2, "duration", "a", None, None, None, None), (1, 2, "reorder", None, None, None, None, None), (1, 3, "undo", None, None, None, None, None), (None, 4, "remove", "a", None, None, None, None)]
    got = run(spark, panels, [(1, "c", None, None, None, None)], log)
    assert [r[3] for r in got if r[1] == "panel"] == ["a", "b", "b"] and [r[5] for r in got if r[1] == "caption"] == [""]


def test_a_project_begins_with_what_is_shown(spark):
    words = [{"start": 0.0, "end": 0.4, "text": "Run "}, {"start": 0.5, "end": 0.9, "text": "now"}]
    pan = {"kind": "up", "travel_px": 3}
    rows = [
        ("a", 1, "a1", 1, 0.0, 2.0, pan, "Run now", "1.png", 1.0, words),
        ("a", 2, "a2", 2, 2.0, 2.0, None, " Run now", "2.png", 1.0, words),
        ("a", 3, "a3", None, None, None, None, "skipped", "", None, None),
        ("a", 4, "a4", 3, 4.0, 1.5, pan, None, "4.png", None, None),
        ("silent", 1, "s1", 1, 0.0, 3.0, pan, "unheard", "1.png", None, None),
        ("no image", 1, "n1", 1, 0.0, 3.0, pan, "x", "", None, None),
        (None, 1, "z", 1, 0.0, 3.0, pan, "x", "1.png", None, None),
    ]
    kind = "chapter string, idx long, panel_id string, order long, start_seconds double, duration_seconds double, pan struct<kind:string,travel_px:int>, text string, image_file string, audio_seconds double, words array<struct<start:double,end:double,text:string>>"
    srt = spark.createDataFrame([("silent", 1, 0.5, 1.25, "from a file"), ("a", 1, 0.0, 1.0, "unused")], "chapter string, number long, start double, end double, caption string")
    got = [tuple(r) for r in E.bootstrap(spark.createDataFrame(rows, kind), srt).orderBy("chapter", "kind", "place").collect()]
    assert got == [
        ("a", "caption", 1, "cap_001", "a1", "Run now", 0.0, 1.05, 0.0, 1.05),
        ("a", "effect", 1, "a1", None, "up", None, 2.0, None, None),
        ("a", "effect", 2, "a2", None, "static", None, 2.0, None, None),
        ("a", "effect", 3, "a4", None, "up", None, 1.5, None, None),
        ("a", "panel", 1, "a1", None, None, 0.0, 2.0, 0.0, 2.0),
        ("a", "panel", 2, "a2", None, None, 2.0, 2.0, 2.0, 2.0),
        ("a", "panel", 3, "a4", None, None, 4.0, 1.5, 4.0, 1.5),
        ("a", "transition", 1, "a1", "a2", "cut", None, 0.5, None, None),
        ("a", "transition", 2, "a2", "a4", "cut", None, 0.5, None, None),
        ("silent", "caption", 1, "cap_001", "", "from a file", 0.5, 0.75, 0.5, 0.75),
        ("silent", "effect", 1, "s1", None, "up", None, 3.0, None, None),
        ("silent", "panel", 1, "s1", None, None, 0.0, 3.0, 0.0, 3.0),
    ]


def test_a_step_before_a_removal_is_taken_back_whole():
    chapter = E.Chapter(1)
    for panel, seconds in (("a", 2.0), ("b", 3.0)):
        chapter.panel(panel, seconds)
    edits = [("reorder", None, None, ["b", "a"]), ("duration", "a", 9.0, None), ("remove", "a", None, None), ("add", "a", None, None), ("duration", "a", 5.0, None)]
    for op, panel, number, order in edits:
        chapter.apply(op, panel, None, None, number, order)
    seen = [[e[:2] for e in chapter.timeline]]
    for op in ["undo"] * 5 + ["redo"] * 5:
        chapter.apply(op, None, None, None, None, None)
        seen.append([e[:2] for e in chapter.timeline])
    back = [[["b", 3.0], ["a", 5.0]], [["b", 3.0], ["a", 2.0]], [["b", 3.0]], [["b", 3.0], ["a", 9.0]], [["b", 3.0], ["a", 2.0]], [["a", 2.0], ["b", 3.0]]]
    assert seen == back + back[-2::-1]
