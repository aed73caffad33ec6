"""Token counts, encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelframe.llm import bpe_codec, packing, token_counts
from panelframe.llm.pretokens import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PARTS = [*"abcdefgth  \n\t's're0123é中　\xa0,.!— \x85İſ", "<|endoftext|>", " the", "  ", "   ", "\r\n", "ééé", "😀", " "]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def texts(n=400, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [None, "", " ", "\n", "x" * 5000, "ab" * 4000 + " z", "<|endoftext|>", *made, made[0], made[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7, t) for i, t in enumerate(rows)] + [(None, "null id", None, None, None)], "doc_id long, text string, ids string, n_tokens int, decoded string")


def encoded(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_counts_and_codec_equal_the_library(spark, library):
    rows = texts()
    docs = frame(spark, rows)
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    coded = {r["doc_id"]: r for r in bpe_codec.encode_decode(docs).collect()}
    assert len(counts) == len(coded) == len(rows) + 1
    for i, t in [*enumerate(rows), (None, "null id")]:
        want = encoded(library, t)
        assert counts[i]["n_tokens"] == len(want) and counts[i]["n_bytes"] == len((t or "").encode())
        assert counts[i]["over_limit"] == (len(want) > 512)
        assert coded[i]["ids"] == want and coded[i]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_empty_tables(spark):
    none = frame(spark, []).where("false")
    assert token_counts.count_tokens(none).count() == bpe_codec.encode_decode(none).count() == packing.pack(none).count() == 0


@pytest.mark.parametrize("window,block", [(1024, 1 << 20), (64, 500)])
def test_packing_loses_nothing(spark, library, window, block):
    rows = texts(150, 2) + ["One two three. Four five! " * 300]
    docs = frame(spark, rows)
    pieces = packing.pack(docs, window=window, block_tokens=block).withColumn("crc", F.crc32("ids")).collect()
    of, sequences = {}, {}
    for p in pieces:
        assert 0 < p["length"] <= window and len(p["ids"]) == 4 * p["length"] and p["crc"] == zlib.crc32(p["ids"])
        of.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for i, t in [*enumerate(rows), (None, "null id")]:
        mine = sorted(of[i], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in mine), "<u4").tolist()
        assert ids == [*encoded(library, t), 0]
        assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine)])[:-1].tolist()
        assert {p["doc_tokens"] for p in mine} == {len(ids)}
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0, *(p["length"] for p in s)])[:-1].tolist()
        assert sum(p["length"] for p in s) <= window


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        window, n = 32, rng.randrange(1, 120)
        ends = np.array([rng.random() < 0.2 for _ in range(n)])
        doc_ends = np.unique([*(rng.randrange(1, n + 1) for _ in range(3)), n])
        places, cost = packing.candidates(ends, doc_ends, window, stride=8)
        assert np.diff(places).max() <= window
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if (size := int(places[j] - places[i])) <= window:
                    best[j] = min(best[j], best[i] + window - size + cost[j])
        cut = packing.cuts(places, cost, window)
        index = {int(p): k for k, p in enumerate(places)}
        assert sum(window - int(b - a) + cost[index[int(b)]] for a, b in zip(cut, cut[1:])) == best[-1]


def test_packing_cuts_at_sentences_and_wastes_little(spark):
    """The whole query: few sequences, and within a sentence no cut unless it is longer than a window."""
    from panelframe.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in queries.QUERIES["op7_packing"](spark, folder).collect()]
    pieces = packing.pack(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"])) for p in pieces)
    encode = packing.encoder(packing.tokenizer_path(packing.VOCABULARY))
    of = {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
    whole = 0
    for mine in of.values():
        mine.sort(key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in mine), "<u4")
        assert len(ids) == mine[0]["doc_tokens"]
        stops = np.concatenate([[0], np.flatnonzero(encode.ends[ids]) + 1, [len(ids)]])
        for p in mine[1:]:
            k = np.searchsorted(stops, p["start"])
            assert stops[k] == p["start"] or stops[k] - stops[k - 1] > 1024
        whole += len(mine) == 1
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    total = sum(sizes.values())
    assert max(sizes.values()) <= 1024 and len(sizes) <= 1.05 * total / 1024 + 1
    assert sum(1024 - n for n in sizes.values()) < 0.05 * total
    assert whole > len(of) / 2


def test_digest_columns(spark, library):
    from panelframe.llm import queries

    row = queries.QUERIES["op9_bpe_codec"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()["text"]
    ids = encoded(library, text)
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_tokens"] == len(ids)
