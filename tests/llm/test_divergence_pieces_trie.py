"""Source divergence, SentencePiece codec and prefix trie against SQL, the library and brute force."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from panelframe.llm import divergence, piece_codec, prefix_trie, queries

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


# Source divergence


def exact(rows, least_docs, top):
    """The audit by plain loops over dictionaries."""
    docs = [(x or "", lang or "", s or "") for x, lang, s in rows]
    words = [(lang, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), x))) for x, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held, total = {}, {}
        for la, _, ws in words:
            if la == lang:
                for t in set(ws):
                    held[t] = held.get(t, 0) + 1
        kept = {t for t, n in held.items() if n >= least_docs}
        sources = {d[2] for d in docs if d[1] == lang}
        count = {s: {} for s in sources}
        for la, s, ws in words:
            for t in ws if la == lang else []:
                if t in kept:
                    count[s][t] = count[s].get(t, 0) + 1
                    total[t] = total.get(t, 0) + 1

        def share(c, kept=kept):
            n = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c.get(t, 0) + 1) // n for t in kept}

        p, q = {s: share(count[s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s].get(t) and p[s][t] > q[t])
            out += [(lang, s, "pair", i, -v, k + 1) for k, (v, _, i) in enumerate(pair)]
            out += [(lang, s, "term", i, -v, k + 1) for k, (v, _, i) in enumerate(term[:top])]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")


def test_divergence_equals_plain_loops(spark):
    rng = random.Random(2)
    words = ["Ab", "ab", "é", "zz", "Ünï", "中文", "c", "d'e", "x1y", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "é", None])) for _ in range(250)]
    rows += [(None, "en", "only null"), ("", "xx", "lone"), ("unheard of", "yy", "p"), ("12 34 _ -", "yy", "q"), *[rows[0]] * 40]
    for least, top in ((3, 200), (1, 2), (400, 5)):
        got = divergence.audit(documents(spark, rows), least_docs=least, top=top).collect()
        assert sorted(tuple(r) for r in got) == exact(rows, least, top)


def test_divergence_of_no_documents_and_of_long_texts(spark, monkeypatch):
    assert divergence.audit(documents(spark, []).where("false")).count() == 0
    rows = [("Word other " * 3000 + "tail", "en", "a"), ("word" * 5000, "en", "b"), *[("other tail word", "en", "b")] * 3]
    want = exact(rows, 3, 200)
    assert sorted(tuple(r) for r in divergence.audit(documents(spark, rows)).collect()) == want
    text = b"ab cd" * 400 + "é".encode() * 900
    monkeypatch.setattr(divergence, "STRETCH", 50)
    assert b" ".join(x for part in divergence._stretches(text) for x in part.translate(divergence._TERM).split()) == b" ".join(text.translate(divergence._TERM).split())


@pytest.mark.parametrize("k,block", [(1, 512), (3, 7), (10, 64), (200, 512)])
def test_bands_hold_what_fewer_than_k_dominate(monkeypatch, k, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(k)
    for n in (0, 1, 60, 700):
        held, wide, name = rng.integers(1, 9, n), rng.integers(1, 30, n), rng.permutation(n)
        over = (held[:, None] >= held) & (wide[:, None] <= wide) & (name[:, None] < name)
        assert sorted(divergence.band(held, wide, name, k).tolist()) == np.flatnonzero(over.sum(0) < k).tolist()


def test_sums_of_pairs_in_blocks(spark, monkeypatch):
    rows = [("a b c d", "en", s) for s in "pqrst" for _ in range(3)] + [("a a b", "en", "p"), ("d d e", "en", "q")]
    want = exact(rows, 3, 200)
    monkeypatch.setattr(divergence, "PAIR_ROWS", 3)
    assert sorted(tuple(r) for r in divergence.audit(documents(spark, rows)).collect()) == want


# SentencePiece


def models():
    """The public model, and the same with a large character map (one that the library has built in) and other settings."""
    sp = pytest.importorskip("sentencepiece")
    with open(piece_codec.tokenizer_path(piece_codec.MODEL), "rb") as f:
        raw = f.read()
    yield "public", raw
    try:
        from sentencepiece import sentencepiece_model_pb2 as proto
    except ImportError:
        return
    rules = proto.ModelProto()
    rules.ParseFromString(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    for squeeze in (True, False):
        for dummy in (True, False):
            for mapped in (True, False):
                m = proto.ModelProto()
                m.ParseFromString(raw)
                m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, dummy
                m.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap if mapped else b""
                yield f"squeeze {squeeze}, prefix {dummy}, map {mapped}", m.SerializeToString()
    m = proto.ModelProto()
    m.ParseFromString(raw)
    for i in (300, 301, 302, 5000):
        m.pieces[i].type = piece_codec.UNUSED
    for i, name in ((400, "<x>"), (401, "thx")):
        m.pieces[i].type, m.pieces[i].piece = piece_codec.USER_DEFINED, name
    yield "own and unused pieces", m.SerializeToString()


PIECES = [*"abcdefgth  \n\t's're0123é中　\xa0,.!— \x85İſ▁▁", " the", "<x>", "thx", "  ", "   ", "\r\n", "ééé", "😀", "ﬁ", "é", "①", "ｱﾞ", "<s>", "​", "\x00", "½", "가", "가"]


def spoken(n, seed):
    rng = random.Random(seed)
    return ["", " ", "  ", "x" * 3000, "ab " * 500, "▁", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(50))) for _ in range(n))]


@pytest.mark.parametrize("short", [48, 0])
@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_pieces_and_their_places_equal_the_library(monkeypatch, short, stretch):
    import sentencepiece as sp

    monkeypatch.setattr(piece_codec, "SHORT", short)
    monkeypatch.setattr(piece_codec, "STRETCH", stretch)
    for name, raw in models():
        library, own = sp.SentencePieceProcessor(model_proto=raw), piece_codec.PieceCodec(raw)
        for t in spoken(150, 1):
            ids, starts, ends = own.encode(t)
            assert ids.tolist() == library.encode(t), (name, t)
            assert own.decode(ids) == library.decode(ids.tolist()), (name, t)
            if hasattr(library, "encode_as_proto"):
                assert [*zip(starts.tolist(), ends.tolist())] == [(p.begin, p.end) for p in library.encode_as_proto(t).pieces], (name, t)
        rng = random.Random(3)
        for _ in range(200):
            ids = [rng.choice([0, 1, 2, 259, 260, 264, 300, 500, 31999, *range(190, 258)]) for _ in range(rng.randrange(9))]
            assert own.decode(np.array(ids, "<u4")) == library.decode(ids), (name, ids)


def test_stretches_of_a_model_that_joins_spaces():
    import sentencepiece as sp

    for name, raw in models():
        library, own = sp.SentencePieceProcessor(model_proto=raw), piece_codec.PieceCodec(raw)
        text = "one  two " * (piece_codec.STRETCH // 4)
        assert own.encode(text)[0].tolist() == library.encode(text), name
        break


def test_codec_of_a_table(spark):
    import sentencepiece as sp

    library = sp.SentencePieceProcessor(model_file=piece_codec.tokenizer_path(piece_codec.MODEL))
    rows = [None, *spoken(60, 4), "a long one " * 100_000, "twice", "twice"]
    docs = spark.createDataFrame([(i, t, "s", 7, t) for i, t in enumerate(rows)] + [(None, "null id", None, None, None)], "doc_id long, text string, ids string, starts int, decoded string")
    got = piece_codec.encode_decode(docs).collect()
    assert len(got) == len(rows) + 1 and piece_codec.encode_decode(docs.where("false")).count() == 0
    for r in got:
        t = "null id" if r["doc_id"] is None else rows[r["doc_id"]] or ""
        assert r["ids"] == library.encode(t) and r["decoded"] == library.decode(r["ids"])
        assert len(r["starts"]) == len(r["ends"]) == len(r["ids"])
        assert all(a <= b for a, b in zip(r["starts"], r["ends"])) and (not t or r["ends"][-1] == len(t.encode()))


@here
def test_whole_codec_query(spark):
    import sentencepiece as sp

    library = sp.SentencePieceProcessor(model_file=piece_codec.tokenizer_path(piece_codec.MODEL))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op12_piece_codec"](spark, FOLDER).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t)), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in docs.items()]
    assert sorted(tuple(r) for r in got) == sorted(want)


# Prefix trie


def trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes, below, stat, out = {}, {}, {}, []
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, len(turns) == d))
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        under = [stat[x] for x in below.get(k, [])]
        stat[k] = sum(x[0] for x in under) or 1, sum(x[1] for x in under) + (len(nodes[k]) - 1) * words
        ends = ",".join(map(str, sorted(c for c, e in nodes[k] if e)))
        out.append((min(nodes[k])[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(nodes[k]), len(under), *stat[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def grown(spark, rows, **how):
    turns = spark.createDataFrame([(*r, "path", 3) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, **how).collect()), key=str)


@pytest.mark.parametrize("size", [1, 10, None])
def test_trie_equals_brute_force(spark, size):
    rng = random.Random(3)
    rows = [(rng.choice([c, c, 3 * c, 20 * c]), rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b c", None, "a a\x0ba", ""])) for c in range(120) for t in range(rng.randrange(7))]
    rows += [(None, 1, "user", "nobody's"), (-3, 0, "user", "below zero"), *[(7, 2, "user", "thrice")] * 3]
    assert grown(spark, rows, container_turns=size) == trie(rows)


def test_trie_of_copies_long_turns_and_nothing(spark):
    # A third of all conversations are one; others share all but their last turns, deeper than any round.
    rows = [(c, t, "u", "the same") for c in range(100) for t in range(4)]
    rows += [(1000 + c, t, "u", f"turn {t}" if t < 15 else f"own {c}") for c in range(60) for t in range(16 if c % 3 else 15)]
    rows += [(5000, 0, "u", "word " * 200_000), *((5001, t, "u", str(t)) for t in range(300))]
    assert grown(spark, rows, container_turns=8) == trie(rows)
    assert grown(spark, []) == []


@here
@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_prefix_trie"])
def test_whole_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(map(tuple, found.fetchall()), key=str)


def test_members_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 4)
    named = spark.createDataFrame([("a", c) for c in (9, 100, 3, 4, -5)] + [("b", 1)], "name string, conv_id long")
    got = {r["name"]: r["ends"] for r in prefix_trie._ends(named).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"a": sha("-5,3,4,9,100"), "b": sha("1")}
