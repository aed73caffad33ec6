"""Secrets, rules, classifier, near duplicates and shards against brute force."""

import base64
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelframe.llm import ngram_join, quality_model, quality_rules, secret_scan, sharding, shingles


def github(body="Zk" * 15):
    n, mark = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        mark = secret_scan.BASE62[k] + mark
    return f"ghp_{body}{mark}"


def base_spans(text):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_secrets_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "secret", "toKen", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc123", "xY9+/_", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "İ", "\n", "tokentoken="]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s for s in secret_scan.spans(text) if s[2] in secret_scan.BASE_KINDS] == sorted(base_spans(text), key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_checksums_decide():
    good, bad = github(), github()[:-1] + "!"
    jwt = ".".join([base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("="), base64.urlsafe_b64encode(b'{"sub": 1}').decode().rstrip("="), "sig"])
    kinds = lambda t: [k for *_, k in secret_scan.spans(t)]
    assert kinds(f"x {good} y") == ["github"] and kinds(f"x {bad} y") == []
    assert kinds(jwt) == ["jwt"] and kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []


def test_secrets_in_very_long_texts():
    """Runs of keywords that lead to no secret are read in time that grows with the text."""
    import time

    began = time.time()
    for part in ("eyJ", "eyJa.", "eyJa.eyJ", "token", "token ", "AKIA", "ghp_", "npm_", "4111 ", "0123456789abcdef01234567 ", "password=", "a", "4111111111111111"):
        secret_scan.spans(part * (1_200_000 // len(part)))
    assert time.time() - began < 60
    text = "x " * 500_000 + github() + " y" * 500_000
    assert secret_scan.spans(text) == [(1_000_000, 1_000_040, "github")] and len(secret_scan._mask(text, "[SECRET]")) == len(text) - 32


def test_rules_and_classifier_on_a_very_long_text(spark):
    text = " ".join(f"word{i % 700} and more of it." for i in range(120_000))
    rows = [(1, text), (2, "short one."), (3, None), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["_rules"] for r in quality_rules.judge_narrow(docs).collect()}
    assert got[1]["n_words"] == 600_000 and got[3]["n_words"] == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    assert len({r["score"] for r in quality_model.score(docs, model).collect() if r["doc_id"] == 1}) == 1
    assert quality_model.good(docs, model, threshold=0.0).count() == 4


def test_the_fitting_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("cast(1 as bigint) as doc_id", "concat('a b ', id) as text")
    gathered = []
    monkeypatch.setattr(quality_model, "fit", lambda bags, labels: gathered.append(bags))
    quality_model.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), most=10)
    assert len(gathered[0]) == 1
    long = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    quality_model.train(long, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), spread=50)
    assert len(gathered[1][0]) == 50


def test_secret_tables(spark):
    rows = [(1, f"a {github()} password=hunter22"), (2, None), (3, ""), (3, ""), (None, "token: abcdef")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, secrets string")
    found = secret_scan.secret_digest(secret_scan.find_secrets(docs)).collect()
    assert Counter((r["doc_id"], r["n_assign"]) for r in found) == Counter({(1, 1): 1, (2, 0): 1, (3, 0): 2, (None, 1): 1})
    masked = [r["text"] for r in secret_scan.redact(docs).collect()]
    assert masked == ["a [SECRET] [SECRET]", None, "", "", "[SECRET]"]
    assert secret_scan.find_secrets(docs.where("false")).count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rule_statistics_equal_brute_force():
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "c d", " ", " ", "\n", "\t", "\x0b", "#", "é", "\xa0", "\x1c", "a b c "]) for _ in range(rng.randrange(60)))
        assert quality_rules.measure(text)[:5] == brute_stats(text)


def test_rules_judge_junk_and_keep_the_rest(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(["the", "river", "house", "quietly", "moved", "stone", "and", "under", "morning", "letters"]) + rng.choice(["", "", "", ".", str(rng.randrange(99))]) for _ in range(200)) + "."
    rows = [(i, clean(), None) for i in range(40)] + [(100 + i, "BUY### NOW&&& " * 60, 1) for i in range(10)] + [(200, None, None), (201, "", None), (None, clean(), None), (7, clean(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _p int")
    got = [(r["doc_id"], r["_rules"]["kept"], r["_rules"]["base_failed"]) for r in quality_rules.judge(docs).collect()]
    assert len(got) == len(rows) and quality_rules.judge(docs).columns == [*docs.columns, "_rules"]
    assert all(kept != (i is not None and i >= 100) for i, kept, _ in got)
    assert all(failed for i, _, failed in got if i in (200, 201))
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_expectation_maximisation_finds_the_good_rules():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    right = [0.95, 0.9, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(4000) < r, good, ~good) * 2 - 1 for r in right], 1) * (rng.random((4000, 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float))
    assert model["good"][0] > model["good"][2] and abs(model["share"] - 0.8) < 0.06
    p = quality_rules.posterior(votes, model)
    assert ((p > 0.5) == good)[np.abs(votes).sum(1) > 0].mean() > 0.9


def test_rules_on_the_given_tables(spark):
    """The whole query: base columns by brute force; the votes decide beyond the base rule, for the better."""
    from panelframe.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d["doc_id"]]
        n, *rest = brute_stats(d["text"] or "")
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n) and not (r["base_failed"] and r["kept"])
    labels = [(rows[x["doc_id"]], x["quality"]) for x in spark.read.parquet(f"{folder}/labels.parquet").collect() if x["doc_id"] in rows]
    base, method = (np.mean([keep(r) == (q == 1) for r, q in labels]) for keep in (lambda r: not r["base_failed"], lambda r: r["kept"]))
    assert sum(not r["base_failed"] and not r["kept"] for r in rows.values()) > 10 and method > base + 0.02
    clean = [r["kept"] for r, q in labels if q == 1 and not r["base_failed"]]
    assert np.mean(clean) > 0.98


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_model.train(docs, labels)
    rows = quality_model.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], r["quality"]) for r in rows if r["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (2, "", 5), (None, "x", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.score(docs, quality_model.train(docs, none)).collect()
    assert len(rows) == 4 and all(abs(r["score"] - 0.5) < 1e-9 and r["predicted"] == 1 for r in rows)
    assert quality_model.score(docs.where("false"), quality_model.train(docs.where("false"), none)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality_model.FEATURES)) for k in (1, 3, 2)]
    x, start, y, one = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    shape = {"E": (quality_model.FEATURES, 16), "e": (16,), "V": (16, 8), "U": (16, 8), "a": (8,), "c": (16,), "b": (1,)}
    w = {k: rng.normal(size=s) * 0.3 for k, s in shape.items()}
    loss = lambda: -np.mean(y * np.log(s := quality_model._forward(w, x, start)["score"]) + (1 - y) * np.log(1 - s))
    g = quality_model._gradients(w, x, start, y, one)
    for k in w:
        i = tuple(0 for _ in w[k].shape)
        before = w[k][i]
        w[k][i] = before + 1e-6
        up = loss()
        w[k][i] = before - 1e-6
        down = loss()
        w[k][i] = before
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-6


def brute_components(rows, n=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 14, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = [*base]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k].upper(), rng.choice(vocabulary)]])
            rows.append((len(rows), " ".join(copy)))
    rows += [(5, rows[0][1]), (5, rows[0][1]), (900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (None, "alone and without any number here")]
    # A chain: each text is near the next one only.
    words = [f"c{k}" for k in range(90)]
    rows += [(1000 + k, " ".join(words[3 * k : 3 * k + 40])) for k in range(12)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, node string, _k int, _of string")
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute_components(rows)
    kept = ngram_join.keep_one(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns) and {(r["node"], r["_k"], r["_of"]) for r in kept} == {("x", 1, "y")}
    want = brute_components(rows)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({d for d, n, c in want if d is not None and (d == c or not n)})


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == ngram_join.keep_one(docs).count() == 0


def test_shards(spark):
    rows = [(i, "t" * (i % 17), f"s{i % 3}" if i % 2 else "big") for i in range(500)] + [(500, None, None), (None, "x", "lone"), (3, "again", "s0"), (3, "again", "s0")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.interleave(docs, shards=8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    for source, n in Counter(s for *_, s in rows).items():
        share = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(share.values()) <= n / 8 + 2 and min(share[k] for k in range(8)) >= n / 8 - 2
    assert sharding.interleave(docs.where("false")).count() == 0
    # Equal rows are spread like others, over the buckets of the ranking too.
    same = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'' as text", "if(id < 3000, 'hot', 'cold') as source")
    dealt = sharding.interleave(same).collect()
    assert Counter(r["shard"] for r in dealt) == Counter({k: 500 for k in range(8)}) and all(abs(n - 375) <= 2 for n in Counter(r["shard"] for r in dealt if r["source"] == "hot").values())


def test_shingles_of_long_and_odd_texts():
    """A text's set is the same alone, among others, and cut into pieces; unequal words have unequal hashes."""
    rng = random.Random(5)
    words = ["a", "b", "\u00e4\u00f6", "\u8a9e", "Zq", "x" * 300, "x" * 299 + "y", *(f"w{k}" for k in range(5000))]
    long_text = " ".join(rng.choice(words) for _ in range(150_000))
    giant = "k" * 700_000 + " one two three four five"
    texts = [long_text, None, "", " \n\t", "one two", "ONE two", "one\x0btwo", "one\u00a0two", giant, "a b c d e", "e d c b a"]
    got = shingles.sets(pa.array(texts, pa.string()), 5)

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    assert [len(s) for s in got] == [len(brute(t)) for t in texts]
    for t, s in zip(texts, got):
        assert np.array_equal(shingles.sets(pa.array([t], pa.string()), 5)[0], s)
        assert np.array_equal(shingles.sets(pa.array(["before", t, "after"], pa.large_string())[1:2], 5)[0], s)
    assert got[4][0] == got[5][0] == got[6][0] != got[7][0] and got[9][0] != got[10][0]
    halves = [" ".join(long_text.split()[:70_000]), " ".join(long_text.split()[69_996:])]
    assert np.array_equal(np.union1d(*shingles.sets(pa.array(halves), 5)), got[0])
    one, two = shingles.names(got)
    assert len(set(zip(one.tolist(), two.tolist()))) == len({frozenset(brute(t)) for t in texts}) and one[1] == two[1] == 0


def test_deal_and_gather():
    """What the stretches and the buckets find shared is what at least two nodes hold; copies of one node share nothing."""
    rng = np.random.default_rng(3)
    sets = {k: np.unique(shingles.mix(rng.integers(1, 400, rng.integers(1, 60)).astype(np.uint64))) for k in range(1, 60)}
    held = Counter(t for s in sets.values() for t in s.tolist())
    want = {(k, t) for k, s in sets.items() for t in s.tolist() if held[t] > 1}
    found, rows = set(), {}
    for part in ([*range(1, 20)], [*range(20, 40)], [40], [*range(41, 60)]):
        (owner, token), out = ngram_join.deal(np.array(part), [sets[k] for k in part], 4, False)
        found |= {(part[o], t) for o, t in zip(owner.tolist(), token.tolist())}
        for b, *row in out:
            rows.setdefault(b, []).append(row)
    often = {}
    for r in rows.values():
        node, token, frequent, holders = ngram_join.gather(r, False)
        found |= set(zip(node.tolist(), token.tolist()))
        often |= dict(zip(frequent.tolist(), holders.tolist()))
    assert found == want and often == {t: n for t, n in held.items() if n >= ngram_join.LEAST_FREQUENT}
    copies = [ngram_join.deal(np.array([7]), [sets[7]], 1, False)[1][0][1:] for _ in range(3)]
    assert not len(ngram_join.gather(copies, False)[0])


@pytest.mark.parametrize("base_in", [True, False])
def test_near_duplicates_in_a_large_group(spark, base_in):
    """Near copies of one text around the threshold, and texts that share a long passage and are not near."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))] if base_in else []
    for _ in range(150):
        copy = [*base]
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            copy[rng.randrange(120)] = rng.choice(["same", f"new{len(rows)}", f"few{rng.randrange(9)}"])
        rows.append((len(rows) + 1, " ".join(copy[: rng.choice([120, 120, 110, 95])])))
    passage = [f"p{k}" for k in range(60)]
    rows += [(1000 + k, " ".join([*passage, *(f"own{k}.{i}" for i in range(rng.choice([4, 12, 20, 30])))])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=str) == brute_components(rows)
