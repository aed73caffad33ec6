"""Source divergence audit: how far the term shares of each source of a language are from its other sources and from it all."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelframe.llm.common import give_back, map_batches, slices, written

# Every share is of so many parts.
WHOLE = 1_000_000_000
# Terms are runs of these bytes: letters, A-Z as a-z, and all beyond ASCII. All other bytes part them.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Bytes of a text whose terms are listed at once, and counts that a task holds before it passes them on.
STRETCH, HELD = 1 << 20, 400_000
# Rows that a task takes before it cuts its bands, and pairs of sources that it works out at once.
BAND_ROWS, PAIR_ROWS = 100_000, 1 << 20
# Terms of a block are held against the band at once.
BLOCK = 128
# Tasks that the bands of one group meet in before they meet in one.
SALTS = 32


def _stretches(text: bytes):
    """text in parts that end where a term ends."""
    at = 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut < len(text) and _TERM[text[cut]] != 32:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in several rows that sum up; a row without a term for each group."""

    def batches(source):
        counts, total = {}, 0

        def out():
            nonlocal total
            for (l, s), (n, d) in counts.items():
                # The group by itself, without a term, then its terms.
                terms = [None, *n]
                many = [0, *n.values()]
                docs = [0, *map(d.__getitem__, n)]
                columns = [pa.repeat(pa.scalar(l, pa.string()), len(terms)), pa.repeat(pa.scalar(s, pa.string()), len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(many, pa.int64()), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            total = 0

        for batch in slices(source):
            for text, lang, src in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (lang, src) not in counts:
                    counts[lang, src] = Counter(), Counter()
                n, docs_of = counts[lang, src]
                before = len(n)
                own = set()
                for part in _stretches(text):
                    words = part.translate(_TERM).split()
                    n.update(words)
                    own.update(words)
                docs_of.update(own)
                total += len(n) - before
                if total >= HELD:
                    yield from out()
        yield from out()
        give_back()

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return map_batches(docs.select(empty(text_col).alias("t"), empty(lang_col).alias("l"), empty(source_col).alias("s")), batches, "lang string, source string, term string, n long, docs long")


def band(held: np.ndarray, wide: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: by no smaller held, no larger wide and an earlier name.

    In the order of (held falling, wide rising, name) all that dominate a term come before it.  The first k that do
    are dominated by fewer than k themselves, so holding each block against what is kept and itself is exact.
    """
    order = np.lexsort((name, wide, -held))
    # Of terms with equal counts, only the first k names can stay.
    h, w = held[order], wide[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    start = np.flatnonzero(fresh)
    order = order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]
    rank = np.empty(len(name), np.int32)
    rank[np.argsort(name, kind="stable")] = np.arange(len(name))
    wide = np.unique(wide, return_inverse=True)[1].astype(np.int32)
    kept = np.empty(0, np.int64)
    for at in range(0, len(order), BLOCK):
        block = order[at : at + BLOCK]
        over = np.concatenate([kept, block])
        beats = (wide[over, None] <= wide[None, block]) & (rank[over, None] < rank[None, block])
        # Of two in a block, the later in the order dominates none of the earlier ones.
        beats[len(kept) :] &= np.triu(np.ones((len(block), len(block)), bool), 1)
        kept = np.concatenate([kept, block[np.count_nonzero(beats, axis=0) < k]])
    return kept


def _skyband(rows: DataFrame, k: int) -> DataFrame:
    """The k-skyband of each group's rows(lang, source, term, n, total) within each task; many rows of a group are cut now and then."""
    names = ["lang", "source", "term", "n", "total"]

    def batches(source):
        held, count = [], 0

        def cut():
            table = pa.Table.from_batches(held).combine_chunks()
            lang, src = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * (len(src.dictionary) + 1) + src.indices.to_numpy()
            n, total = (table.column(c).to_numpy() for c in ("n", "total"))
            # The rank of a term by its bytes.
            term = table.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
            rank = np.empty(len(term.dictionary), np.int64)
            rank[pa.compute.sort_indices(term.dictionary).to_numpy()] = np.arange(len(term.dictionary))
            name = rank[term.indices.to_numpy()]
            order = np.argsort(group, kind="stable")
            edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])), len(order))
            keep = [order[x:y][band(n[order[x:y]], total[order[x:y]], name[order[x:y]], k)] for x, y in zip(edges[:-1], edges[1:])]
            return table.take(pa.array(np.concatenate(keep))).combine_chunks().to_batches()

        limit = BAND_ROWS
        for batch in source:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count > limit:
                held = cut()
                count = sum(b.num_rows for b in held)
                limit = BAND_ROWS + 2 * count
        if held:
            yield from cut()
        give_back()

    return map_batches(rows.select(*names), batches, "lang string, source string, term string, n long, total long")


def _share(n, group_n, terms) -> F.Column:
    """1 + floor(WHOLE * (n + 1) / (group_n + terms)), exactly."""
    wide = lambda c: c.cast("decimal(24,0)")
    return F.lit(1) + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * wide(n + F.lit(1)), wide(group_n + terms))


def _apart(p: F.Column, q: F.Column) -> F.Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _floor_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _together(kept: DataFrame) -> DataFrame:
    """(lang, source, other, more): sums over the terms that both sources hold, of what such a term adds beyond what it adds
    when only one of them holds it.  kept has (lang, at array of (source, p, none)); sums modulo 2^64 are exact in the end."""

    def batches(source):
        for batch in source:
            lists = batch.column(1)
            flat = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            src = flat.field(0).dictionary_encode()
            who, names, sources = src.indices.to_numpy().astype(np.int64), src.dictionary, max(len(src.dictionary), 1)
            langs = batch.column(0).dictionary_encode()
            lang, lang_names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
            p, none = (flat.field(k).to_numpy() for k in (1, 2))
            # Row i of the flat table meets the others of its term.
            term = np.repeat(np.arange(len(size)), size)
            met = size[term]
            sums: dict[int, int] = {}
            at = 0
            ends = np.cumsum(met)
            while at < len(term):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_ROWS, "right")))
                rows = np.arange(at, stop)
                m = met[rows]
                x = np.repeat(rows, m)
                y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[term[rows]], m)
                keep = x != y
                x, y = x[keep], y[keep]
                more = _floor_apart(p[x], p[y]) - _floor_apart(p[x], none[y]) - _floor_apart(none[x], p[y]) + _floor_apart(none[x], none[y])
                key = (lang[term[x]] * sources + who[x]) * sources + who[y]
                order = np.argsort(key, kind="stable")
                key, more = key[order], more[order]
                if len(key):
                    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    for a, b in zip(key[edge].tolist(), np.add.reduceat(more, edge).tolist()):
                        sums[a] = sums.get(a, 0) + b
                at = stop
            if sums:
                key = np.fromiter(sums, np.int64, len(sums))
                pair, other = np.divmod(key, sources)
                l, s = np.divmod(pair, sources)
                value = pa.array([v for v in sums.values()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(l)), names.take(pa.array(s)), names.take(pa.array(other)), value], names=["lang", "source", "other", "more"])
        give_back()

    return map_batches(kept.select("lang", "at"), batches, "lang string, source string, other string, more decimal(38,0)")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group that occurs.

    Terms are runs of letters (A-Z as a-z) and characters beyond ASCII; a language keeps those of at least `least_docs`
    of its documents.  A group and a language give each kept term 1 + floor(WHOLE * (count + 1) / (all + terms)) parts;
    p and q are apart floor((p - q)^2 / q).  Part `pair`: every other source of the language, with the sum over all its
    kept terms; part `term`: the kept terms of the group that it holds more of than the language, to rank `top`.
    Values fall, equal ones come by the UTF-8 of the item.  All of it is exact.

    A null text, language or source is the empty string, a group like any other; repeated rows are documents each;
    a group without terms has its pairs, with the value 0 where the language keeps none; an empty table gives no rows;
    other columns are not read.  Very long texts are counted in stretches.  Counts are summed in the scan, so that
    neither a frequent term nor a large source is more than one row for each task.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    # One shuffle by term: a source's counts, then the language's, of the same rows.
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("at"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    # A term is at most once in each source: a list is no longer than the language has sources.
    terms = written(terms.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"), "divergence-terms")
    held = terms.where("term is not null")
    exploded = lambda t, *c: t.select("lang", *c, F.explode("at").alias("_a")).select("lang", *c, "_a.source", "_a.n")
    languages = held.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    groups = exploded(terms).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    some = lambda c: F.coalesce(F.col(c), zero).alias(c)
    groups = groups.join(languages, "lang", "left").select("lang", "source", "group_n", some("terms"), some("lang_n"))
    # The share of a term that the group has not; 0 where the language keeps no term, and then unused.
    groups = written(groups.withColumn("none", F.when(F.col("terms") > 0, _share(zero, F.col("group_n"), F.col("terms"))).otherwise(zero)), "divergence-groups")

    # Part term: of the terms that the group holds more of, bands of each task, of each group's salts, of each group; then the
    # exact ranks. What dominates such a term is one itself.
    p, q = _share(F.col("n"), F.col("group_n"), F.col("terms")), _share(F.col("total"), F.col("lang_n"), F.col("terms"))
    more = exploded(held, "term", "total").join(groups, ["lang", "source"]).where(p > q).select("lang", "source", "term", "n", "total")
    salted = _skyband(more, top).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    found = _skyband(_skyband(salted, top).repartition("lang", "source"), top)
    valued = found.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(p, q).alias("value"))

    # Part pair: as if no term were held, then what terms that one side holds change, then what terms of both do.
    wide = lambda c: c.cast("decimal(38,0)")
    one = exploded(held).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("many")).join(groups, ["lang", "source"])
    one = one.select("lang", "source", "many", "none", _share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("terms").alias("other_terms"))
    met = one.join(other, "lang").where("source <> other")
    a, b, x = F.col("none"), F.col("other_none"), F.col("p")
    ways = F.explode(F.array(F.struct(F.col("source").alias("g"), F.col("other").alias("h"), (_apart(x, b) - _apart(a, b)).alias("d")), F.struct(F.col("other").alias("g"), F.col("source").alias("h"), (_apart(b, x) - _apart(b, a)).alias("d"))))
    alone = met.select("lang", "many", ways.alias("_w")).select("lang", F.col("_w.g").alias("source"), F.col("_w.h").alias("other"), (F.col("many").cast("decimal(19,0)") * F.col("_w.d").cast("decimal(19,0)")).cast("decimal(38,0)").alias("more"))
    base = groups.join(other, "lang").where("source <> other").select("lang", "source", "other", F.when(F.col("terms") > 0, (F.col("terms").cast("decimal(19,0)") * _apart(a, b).cast("decimal(19,0)")).cast("decimal(38,0)")).otherwise(wide(F.lit(0))).alias("more"))
    shares = exploded(held, "term").join(groups, ["lang", "source"]).select("lang", "term", F.struct("source", _share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), "none").alias("s"))
    both = _together(shares.groupBy("lang", "term").agg(F.collect_list("s").alias("at")).where("size(at) > 1"))
    pairs = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("more").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    ranked = valued.unionByName(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
