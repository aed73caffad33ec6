"""Review changes against a machine of whole lists."""

import hashlib
import random

from panelframe.operators import review as R


def plain(panels, links, log):
    """Batches one after another; a refused one changes nothing."""
    name = lambda s: hashlib.sha1(str(s).encode()).hexdigest()
    state = {}
    for s, i, y in sorted(panels, key=lambda p: (p[2], p[1])):
        state.setdefault(s, {"panels": {}, "order": [], "held": None})["panels"].setdefault(i, {"gone": False, "said": None})

    def chain(s):
        out = []
        while s is not None and s not in out:
            out.append(s)
            s = links.get(s)
        return out

    def place(s, i):
        if i is not None and i.startswith("s") and "_" in i and len(i.split("_", 1)[0]) > 8 and set(i.split("_", 1)[0][1:]) <= set("0123456789abcdef"):
            prefix, i = i[1:].split("_", 1)
            owners = [a for a in chain(s) if name(a).startswith(prefix)]
            s = owners[0] if len(owners) == 1 else None
        return (s, i) if s in state and i in state[s]["panels"] else None

    refused, by_seq = {}, sorted(log, key=lambda r: r[1])
    for batch, seq, s, op, i, status in by_seq:
        problem = None
        if op not in ("delete", "restore", "status", "confirm", "confirm_all"):
            problem = "unknown operation"
        elif not op.startswith("confirm") and place(s, i) is None:
            problem = "unknown panel"
        elif op == "status" and status not in ("needs_review", "reviewed", "edited"):
            problem = "invalid status"
        if problem:
            refused.setdefault(batch, (seq, problem))
    for batch, seq, s, op, i, status in by_seq:
        if batch in refused:
            continue
        if op.startswith("confirm"):
            for a in chain(s):
                if a in state:
                    z = state[a]
                    order = [p for p in z["order"] if not z["panels"][p]["gone"]] or [p for p, x in z["panels"].items() if not x["gone"]]
                    if order:
                        z["order"], z["held"] = order, seq
                        for p in order:
                            if op == "confirm_all" and not z["panels"][p]["said"]:
                                z["panels"][p]["said"] = "reviewed"
            continue
        a, i = place(s, i)
        if op == "status":
            state[a]["panels"][i]["said"] = status
        else:
            state[a]["panels"][i]["gone"], state[a]["held"] = op == "delete", None
    rows = [(s, i, x["gone"], x["said"] or "needs_review", z["order"].index(i) + 1 if i in z["order"] else None, z["held"]) for s, z in state.items() for i, x in z["panels"].items()]
    return sorted(rows, key=str), sorted((b, *x) for b, x in refused.items())


def run(spark, panels, links, log):
    p = spark.createDataFrame(panels, "session long, id string, y_start long")
    l = spark.createDataFrame([*links.items()], "session long, earlier long")  # noqa: E741
    g = spark.createDataFrame(log, "batch long, seq long, session long, op string, id string, status string")
    out, refused = R.review_changes(p, l, g)
    return sorted((tuple(r) for r in out.collect()), key=str), sorted(tuple(r) for r in refused.collect())


def test_review_equals_a_plain_machine(spark):
    rng = random.Random(4)
    name = lambda s: hashlib.sha1(str(s).encode()).hexdigest()
    # Session 0 has a third of all panels and changes; 5 and 6 continue each other.
    panels = [(0 if k < 40 else rng.randrange(1, 8), f"p{k % 25}", rng.randrange(30)) for k in range(120)]
    panels = [*{(s, i): (s, i, y) for s, i, y in sorted(panels, key=lambda p: -p[2])}.values()]
    links = {1: 0, 2: 1, 3: 2, 4: None, 5: 6, 6: 5, 7: 99}
    log = []
    for seq in range(400):
        s = 0 if seq % 3 == 0 else rng.randrange(0, 9)
        op = rng.choice(["delete", "delete", "restore", "status", "status", "confirm", "confirm_all", rng.choice(["burn", None]) if rng.random() < 0.1 else "delete"])
        owner = rng.choice([s, s, links.get(s) or s])
        i = f"p{rng.randrange(25)}"
        i = i if owner == s else f"s{name(owner)[: rng.choice([8, 12, 40])]}_{i}"
        status = rng.choice(["reviewed", "edited", "needs_review"]) if rng.random() < 0.95 else rng.choice(["lost", None])
        log.append((seq // 2, seq, s, op, None if op in ("confirm", "confirm_all") else i, status if op == "status" else None))
    got, want = run(spark, panels, links, log), plain(panels, links, [(b, q, s, op or "none", i, t) for b, q, s, op, i, t in log])
    assert want[1] and got == want


def test_a_bad_row_refuses_its_batch_only(spark):
    panels = [(1, "a", 2), (1, "b", 1), (2, "a", 0)]
    log = [(1, 1, 1, "delete", "a", None), (1, 2, 1, "delete", "zz", None), (2, 3, 1, "delete", "b", None), (3, 4, 2, "confirm_all", None, None), (4, 5, 1, "restore", "b", None), (5, 6, 1, "confirm", None, None)]
    rows, refused = run(spark, panels, {2: 1}, log)
    assert refused == [(1, 2, "unknown panel")]
    # b was deleted when its strip was locked, so that the second confirmation locks what is left of the first.
    assert rows == [(1, "a", False, "reviewed", 1, 6), (1, "b", False, "needs_review", None, 6), (2, "a", False, "reviewed", 1, 4)]


def test_nothing_to_review(spark):
    assert run(spark, [], {}, []) == ([], [])
    assert run(spark, [(None, "a", 1), (1, None, 1), (1, "a", 3), (1, "a", 2)], {}, [(None, 1, None, "delete", "a", None)]) == ([(1, "a", False, "needs_review", None, None)], [])
