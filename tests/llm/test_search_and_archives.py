"""Neighbour search against brute force; archives against what was written."""

import hashlib
import io
import zipfile

import numpy as np
import pytest

from panelframe.llm import ann, warc


def brute(ids, x, asked, k):
    out = {}
    for i, v in zip(ids, x):
        if i in asked:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_search_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.4 * rng.normal(size=(120, 16)) for c in centres])
    x[900:1200] = x[900]  # one vector many times
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist(), 1.0) for i, v in zip(ids, x)]
    rows += [(5000, None, 1.0), (5020, [0.0] * 16, 1.0), (5040, [float("nan")] * 16, 1.0), (None, x[0].tolist(), 1.0), (rows[0][0], rows[0][1], 2.0)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), lambda i: i % 20 == 0, sample=900).collect()
    want = brute(ids, x, {int(i) for i in ids if i % 20 == 0}, 20)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = dict(zip(ids, x))
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and q not in dict(near)
        assert all(abs(s - at[q] @ at[i]) < 1e-9 for i, s in near)


def test_recall_holds_outside_the_sample(spark):
    n, k = 3000, 20
    x = np.random.default_rng(1).normal(size=(n, 32))  # no structure; the sample is a fifth
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, lambda i: i % 10 == 0, sample=600).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(n), x, {*range(0, n, 10)}, k)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / k for q in want]) >= 0.95


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_on_the_given_embeddings(spark, scale):
    """The whole query against brute force."""
    from panelframe.llm import queries

    folder = f"/root/testdata/sf{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries.QUERIES["op2_neighbours"](spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    want = brute(ids, x, {int(i) for i in ids if i % 20 == 0}, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q].keys() & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_odd_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(6)] + [(20, [1.0, 2.0, 3.0]), (40, [1.0]), (60, [2.0, 2.0]), (60, None), (80, [])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 60} and {r["vec_id"] for r in found} == {*range(6), 60}


def test_every_query_gets_k(spark):
    x = np.random.default_rng(4).normal(size=(500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # Three parts of some 170 rows, of which the low aim has one looked through.
    found = ann.search(df, lambda i: i % 50 == 0, k=300, aim=0.01, sample=300).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 300 for i in range(0, 500, 50)}


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, lambda i: i == 0).collect())
    assert found == [(0, 1, 3), (0, 2, 2), (0, 3, 1)]
    assert ann.search(df.where("false"), lambda i: i == 0).count() == 0


def test_equal_scores_go_to_smaller_ids():
    v = [[1.0, 0.0]] * 30
    got = ann.nearest_in_block(np.array([7]), [[1.0, 0.0]], np.arange(30)[::-1].copy(), v, 5)
    assert got["vec_id"].tolist() == [0, 1, 2, 3, 4]


def test_archives_hold_every_page(spark, tmp_path):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "é" * 5000, "<p>one</p>"]
    rows = [(i, f"https://x.org/{i} a", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>one</p>", "z"), (0, "u", "<p>one</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages.repartition(3), folder=folder, archive_bytes=400)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by["0"]] == ["response"] * 2
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in by["2"] + by["6"]] == [("revisit", "0", 10)] * 2
    assert sorted((r["page_id"], r["refers_to"]) for r in by["3"] + by["4"]) == [("3", None), ("4", "3")]
    assert bytes(by["5"][0]["payload"]) == html[5].encode() and by[""][0]["record_type"] == "response"
    for r in got:
        i = int(r["page_id"]) if r["page_id"] else None
        body = (html[i] if i is not None else "<p>one</p>") or ""
        assert r["payload_digest"] == warc.digest(body.encode()) and r["payload_bytes"] == len(body.encode())
    listed = warc.archives_in(spark, folder)
    assert listed.count() == archives.count() > 1 and warc.read_archives(listed).count() == len(rows)
    with zipfile.ZipFile(archives.first()["archive"].removeprefix("file://")) as z:  # any ZIP reader can read them
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    assert warc.write_archives(pages.where("false")).count() == 0


def test_small_payloads_never_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, least_bytes=3), payloads=False).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


@pytest.mark.parametrize("wide", [False, True])
def test_directory_is_parsed(monkeypatch, wide):
    if wide:  # makes the standard library write ZIP64 records for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("a.txt", b"x" * 200)
        z.writestr("b/é.txt", b"y" * 300)
    raw = out.getvalue()
    found = warc.members(io.BytesIO(raw), len(raw))
    assert {n: raw[a : a + k] for n, (a, k, _) in found.items()} == {"a.txt": b"x" * 200, "b/é.txt": b"y" * 300}
    if wide:
        assert warc.END64 in raw


def test_digest_form():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(warc.digest(b"x")) == 32
    assert hashlib.sha1(b"x").digest()
