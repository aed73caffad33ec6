"""The event log source, the script sink, the model hook, and JSON of any depth."""

import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.functions import nested as N
from panelframe.operators import recompute as R
from panelframe.sources import event_log, scripts

# The event log


def lines(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        if rng.random() < 0.1:
            yield rng.choice(["", "not json", "[1]", '{"cut": ', "  "])
        else:
            yield json.dumps({"t": k + 0.5, "step": rng.choice(["cut", "plan", None]), "event_type": "x" * rng.randrange(200), "message": rng.choice(["é ", {"a": 1}, 7]), "severity": rng.choice(["info", "error"]), "duration_s": rng.choice([1, 2.5, None, True, "3"]), "more": k}, ensure_ascii=rng.random() < 0.5)


def want(text, path):
    out, at = [], 0
    for raw in text.encode().split(b"\n"):
        line = raw.decode().strip()
        if line:
            try:
                e = json.loads(line)
            except ValueError:
                e = None
            word = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            number = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
            if isinstance(e, dict):
                out.append((number(e["t"]), e["step"], e["event_type"], word(e["message"]), e["severity"], number(e["duration_s"]), None, path, at, None))
            else:
                out.append((None,) * 7 + (path, at, line))
        at += len(raw) + 1
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[7], r[8]))


@pytest.mark.parametrize("split", [7, 1000, 1 << 30])
def test_log_cut_at_any_byte(spark, tmp_path, split):
    event_log.register(spark)
    texts = {"a.jsonl": "\n".join(lines(60, 1)), "b/c.jsonl": "\n".join(lines(40, 2)) + "\n", "empty.jsonl": ""}
    for name, text in texts.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    expected = sorted((r for name, text in texts.items() for r in want(text, f"{tmp_path}/{name}")), key=lambda r: (r[7], r[8]))
    if split == 7:
        texts.pop("b/c.jsonl")
        os.remove(tmp_path / "b/c.jsonl")
        (tmp_path / "a.jsonl").write_bytes("\n".join(lines(4, 5)).encode())
        expected = want("\n".join(lines(4, 5)), f"{tmp_path}/a.jsonl")
    log = spark.read.format("event_log").option("path", f"file://{tmp_path}").option("splitBytes", str(split)).load()
    assert rows(log) == expected
    errors = [r for r in expected if r[4] == "error" and r[1] == "cut"]
    assert rows(log.where("severity = 'error' and step = 'cut'")) == errors
    assert rows(spark.read.format("event_log").option("path", f"file://{tmp_path}").option("step", "cut").load().where("severity = 'error'")) == errors
    assert log.where("step = 'cut' and step = 'plan'").count() == 0


def test_stream_reads_on_where_it_stopped(spark, tmp_path):
    event_log.register(spark)
    path = tmp_path / "log"
    path.mkdir()
    text = "\n".join(lines(50, 3)) + "\n"
    cut = text.index("\n", 2000) + 30  # within a line
    got = []

    def run():
        q = spark.readStream.format("event_log").option("path", f"file://{path}").option("splitBytes", "900").load()
        take = lambda b, i: got.extend(tuple(r) for r in b.collect())
        q.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ckpt").start().awaitTermination(120)

    (path / "a.jsonl").write_bytes(text[:cut].encode())
    run()
    first = len(got)
    with open(path / "a.jsonl", "ab") as f:
        f.write(text[cut:].encode())
    (path / "b.jsonl").write_bytes(b'{"step": "late"}\nnot yet')
    run()
    assert 0 < first < len(got)
    whole = rows(spark.read.format("event_log").option("path", f"file://{path}").load())
    assert sorted(got, key=lambda r: (r[7], r[8])) == whole[:-1] and whole[-1][-1] == "not yet"


# Scripts


def test_text_and_index_come_together(spark, tmp_path):
    said = [("a/b", 2, "p2", "two"), ("a/b", 1, "p1", " one "), ("a/b", 3, "p3", None), ("c", 1, "p9", ""), (None, 1, "p", "x"), *[(f"n{k}", 1, "p", "same") for k in range(30)]]
    df = scripts.scripts(spark.createDataFrame(said, "chapter string, idx int, id string, text string"))
    path = f"file://{tmp_path}/out"
    scripts.write(df.repartition(4), path)
    got = {r["chapter"]: r for r in scripts.read(spark, path).collect()}
    assert len(got) == 32 and got["a/b"]["script"] == "one\ntwo" and got["c"]["script"] == "" and json.loads(got["c"]["lines"]) == []
    assert json.loads(got["a/b"]["lines"]) == [{"line": 1, "panel": "p1", "chars": 3}, {"line": 2, "panel": "p2", "chars": 3}]
    scripts.write(df.where("chapter = 'c'"), path, "overwrite")
    assert [r["chapter"] for r in scripts.read(spark, path).collect()] == ["c"]


def test_scripts_are_read_by_the_folders_of_tasks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    df = spark.range(300).select(F.concat(F.lit("c "), "id").alias("chapter"), F.repeat(F.lit("é\r\n"), F.col("id").cast("int")).alias("script"), F.lit('[{"line":1,"panel":"p","chars":2}]').alias("lines"))
    scripts.write(df.repartition(3), path)
    got = scripts.read(spark, path)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    # Nor does a batch hold more than its due, whatever a task has.
    monkeypatch.setattr(scripts, "BATCH", 100)
    reader = scripts.Scripts({"path": path}).reader(None)
    batches = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(batches) == 300 and max(batches) < 10 and len(reader.partitions()) == 3
    scripts.write(df.where("false"), path, "overwrite")
    assert scripts.read(spark, path).count() == 0


def test_a_failed_task_leaves_neither(spark, tmp_path):
    df = spark.createDataFrame([(f"c{k}", "text", "[]" if k < 9 else "{broken") for k in range(10)], scripts.Scripts({}).schema()).repartition(5)
    with pytest.raises(Exception):
        scripts.write(df, f"file://{tmp_path}/out")
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


# The model hook


def docs(spark, n):
    return spark.createDataFrame([(k, f"h{k % 7}", f"text {k}") for k in range(n)], "id long, hash string, text string")


ANSWER = T.StructType([T.StructField("size", T.LongType())])


def test_finished_slices_are_never_asked_for_again(spark, tmp_path):
    asked, fail = str(tmp_path / "asked"), str(tmp_path / "fail")
    open(fail, "w").close()

    def model(part):
        if 37 in set(part["id"]) and os.path.exists(fail):
            raise RuntimeError("lost")
        with open(asked, "a") as f:
            f.writelines(f"{i}\n" for i in part["id"])
        return pd.DataFrame({"size": part["text"].str.len().astype("int64")})

    wanted = docs(spark, 60).repartition(2, "id")
    cache = docs(spark, 20).select("id", F.when(F.col("id") < 15, F.col("hash")).otherwise("old").alias("hash"), F.lit(-1).cast("long").alias("size"))
    go = lambda: {r["id"]: r for r in R.recomputed(wanted, cache, ["id"], model, ANSWER, journal=f"file://{tmp_path}/journal", rows=4).collect()}
    with pytest.raises(Exception):
        go()
    before = open(asked).read().split()
    os.remove(fail)
    got = go()
    after = open(asked).read().split()
    assert before and len(after) == len(set(after)) == 45  # each row that the cache lacks, once
    assert {i: r["size"] for i, r in got.items()} == {k: -1 if k < 15 else len(f"text {k}") for k in range(60)}
    assert {r["origin"] for i, r in got.items() if i < 15} == {"cache"}


def test_faults_that_pass_and_faults_that_do_not(spark, tmp_path):
    tries = str(tmp_path / "tries")

    def model(part):
        with open(tries, "a") as f:
            f.write("x")
        if len(open(tries).read()) < 3 or (part["id"] == 5).any():
            raise R.Transient("busy")
        return pd.DataFrame({"size": part["id"]})

    none = docs(spark, 0).select("id", "hash", F.lit(0).cast("long").alias("size"))
    got = {r["id"]: r for r in R.recomputed(docs(spark, 6).coalesce(1), none, ["id"], model, ANSWER, rows=1, retries=2, wait=0.01).collect()}
    assert got[0]["attempts"] == 3 and got[0]["size"] == 0 and got[0]["error"] is None
    assert got[5]["error"] == "busy" and got[5]["size"] is None and got[5]["attempts"] == 3
    results = R.recomputed(docs(spark, 4), none, ["id"], lambda p: pd.DataFrame({"size": p["id"] * 2}), ANSWER)
    path = f"file://{tmp_path}/cache"
    for _ in range(2):  # the same run twice
        cache = R.committed(results, path, "one")
    assert sorted(tuple(r) for r in cache.select("id", "size").collect()) == [(k, 2 * k) for k in range(4)]
    replay = R.canned(docs(spark, 4), cache, ["id"])
    assert sorted((r["id"], r["size"]) for r in replay.collect()) == [(k, 2 * k) for k in range(4)]
    assert R.recomputed(docs(spark, 0), cache, ["id"], model, ANSWER).count() == 0


# JSON of any depth


def test_deep_documents(spark):
    deep = lambda n, leaf: json.dumps(leaf) if n == 0 else '{"k":' + deep(n - 1, leaf) + "}"
    base, own = deep(400, {"a": 1, "b": [1]}), deep(400, {"b": {"token": "t"}, "c": None})
    cases = [(base, own), ('{"a":{"b":1}}', '{"a":{"c":{"d":2}},"e":[{"x":1}]}'), ('{"a":1}', "[1]"), ("[1]", "{}"), (None, "{}"), ('{"a":{"b":1}}', '{"a":null}'), ('{"é":"ü"}', None), ("{" * 5, "{}"), ('{"k":' * 100_000 + "1" + "}" * 100_000, "{}")]
    got = [r[0] for r in spark.createDataFrame(cases, "a string, b string").coalesce(1).select(N.merged_json(F.col("a"), F.col("b"))).collect()]
    assert json.loads(got[0]) == json.loads(deep(400, {"a": 1, "b": {"token": "t"}, "c": None}))
    assert got[1:] == ['{"a":{"b":1,"c":{"d":2}},"e":[{"x":1}]}', '{"a":1}', None, None, '{"a":null}', '{"é":"ü"}', None, None]
    secret = [(deep(5, {"apiKey": {"x": [1]}, "author": "A", "list": [[{"Passwd": 1, "plain": "sk-123456789"}]]}),), ('"use sk-123456789 now"',), ("7",), ("null",), (None,), ("{",), ('{"AUTH":null,"monkey":"m"}',)]
    got = [r[0] for r in spark.createDataFrame(secret, "a string").coalesce(1).select(N.redacted_json(F.col("a"))).collect()]
    assert json.loads(got[0]) == json.loads(deep(5, {"apiKey": "***REDACTED***", "author": "A", "list": [[{"Passwd": "***REDACTED***", "plain": "sk-123456789"}]]}))
    assert got[1:] == ['"use ***REDACTED*** now"', "7", "null", None, None, '{"AUTH":"***REDACTED***","monkey":"m"}']


def test_versions_of_a_stored_memory(spark):
    state = lambda *texts: [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "a string").coalesce(1).select(N.loaded_context(F.col("a"))).collect()]
    got = state('{"_meta":{"version":2,"last_panel":9}}', '{"_meta":{"version":3}}', '{"_meta":{"version":true}}', '{"_meta":null,"characters":{"A":{"x":1}}}', "[]", None, '{"_meta":{"version":"5"}}')
    assert [s for _, s in got] == ["loaded", "reset", "loaded", "broken", "broken", "broken", "loaded"]
    first = json.loads(got[0][0])
    assert first["_meta"] == {"last_panel": 9, "seed_built": False, "image_seed_built": False, "version": 2} and first["characters"] == {}
    assert json.loads(got[1][0]) == N.SCAFFOLD and json.loads(got[6][0])["_meta"]["version"] == 2


def test_blanked_configuration(spark):
    got = [r[0] for r in spark.createDataFrame([('{"apiKey":"x","token":0,"deep":{"token":"t"},"author":"a"}',), ("[]",)], "a string").coalesce(1).select(N.blanked_config(F.col("a"))).collect()]
    assert got == ['{"apiKey":"","token":0,"deep":{"token":"t"},"author":"a"}', None]


def test_batches_of_documents_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("a"))

    @F.arrow_udf("long")
    def together(a: pa.Array) -> pa.Array:
        return pa.array([len(a)] * len(a))

    got = texts.select(N.redacted_json(F.col("a")).alias("r"), together("a").alias("n")).collect()
    assert len(got) == 48 and max(r["n"] for r in got) <= 8
