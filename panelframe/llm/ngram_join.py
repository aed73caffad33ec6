"""Size-aware heavy-light Jaccard join of documents over word n-grams, up to connected components.

Documents with equal sets are one node from the start.  Then nodes that can be near to no other go:
of the first shingles of a set, in the order of their hashes, so many must be held by another node too.
What is left is small, and its sets are kept, without shingles that no other of them holds.

Nodes up to a boundary size are light: they meet by the pairs (2-subsets) of the rarest shingles of
their set.  Larger ones are heavy: they meet in the inverted lists of single shingles.  The boundary is
the size up to which subsets cost less.  Both use the same fact: two sets that share enough share k of the
first (size - least overlap + k) shingles in one common order, here the rare ones first.

Lists are not expanded into all pairs.  Each node is checked against one hub, the node of its lists with
the largest share of shared shingles, which in a group of near copies is the one nearest to all; that
gives the first components.  Of two nodes with one hub that are still apart, and that hold less of the hub
than they must share, the rest has to come from shingles outside the hub: they meet in lists of these alone.
Only nodes of different hubs, or that hold that much of theirs, meet in the lists again.  So no link that
could join two components is lost, and a large group of near copies costs about its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm import shingles
from panelframe.llm.common import cut, give_back, map_batches, small_batches, typed, written
from panelframe.llm.components import components
from panelframe.llm.shingles import P1, mix

# Shingles that a task deals at once, and those that a bucket of the shuffle holds, about.
STRETCH, BUCKET = 1_500_000, 1_500_000
LEAST_BUCKETS = 8
# So many more of a set's shingles than the least are looked at first, and have to be shared: one in EXTRA.
EXTRA = 10
# Shingles of so many nodes count as frequent; of more, if there were over MOST_FREQUENT of them (12 bytes
# each). This decides their place in the order and with it the work, never the result.
LEAST_FREQUENT, MOST_FREQUENT = 8, 4_000_000
# Light sets have at most so many shingles, whatever the costs; and at least.
LEAST_BOUNDARY, MOST_BOUNDARY = 8, 40
# Bits of the presence filter that spares texts a shuffle: a fixed 512 KiB whatever the input.
FILTER_BITS = 1 << 22


def least_overlap(size, percent: int):
    """The least number of shingles that a set of this size shares with any near one."""
    return -(-percent * size // 100)


def choose_boundary(stats: list[tuple[int, float, float]], percent: int) -> int:
    """The largest size up to which subsets cost less rows than lists cost rows and meetings.

    stats: (size class = size // 4, list entries seen, other holders seen in these lists).
    """
    extra = {c: other / max(seen, 1) for c, seen, other in stats}
    best = LEAST_BOUNDARY
    for size in range(LEAST_BOUNDARY + 1, MOST_BOUNDARY + 1):
        prefix = size - least_overlap(size, percent) + 1
        if (prefix + 1) * prefix / 2 > prefix * (1 + extra.get(size // 4, 0.0)):
            break
        best = size
    return best


def _named(docs: DataFrame, n: int) -> DataFrame:
    """(_id, _mark, size, one, two) of docs(_id, _mark, _text): the size and the 128-bit name of every row's set."""
    from pyspark.sql.pandas.types import to_arrow_schema

    long = T.LongType()
    out = T.StructType([typed(docs, "_id"), *(T.StructField(c, long) for c in ("_mark", "size", "one", "two"))])
    arrow = to_arrow_schema(out)

    def batches(source):
        for batch in source:
            for part in cut(batch):
                found = shingles.sets(part.column(2), n)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), part.column(1), pa.array([len(s) for s in found], pa.int64()), *map(pa.array, shingles.names(found))], schema=arrow)
        give_back()

    return map_batches(docs.select("_id", "_mark", "_text"), batches, out)


def deal(nodes: np.ndarray, sets: list[np.ndarray], buckets: int, short: bool):
    """One stretch of sets, dealt by shingle.

    Gives (local, rows): local are (set number, its shingles that another set of this stretch holds); rows are
    (bucket, nodes, counts, tokens, holders): the nodes with a shingle in the bucket, how many each has, and these,
    node after node.  A shingle of several sets enters once, as of node 0, which comes last, with its holders, so
    that a bucket gets as many entries of a shingle as there are stretches at most.  A short token is the
    upper half of the hash; the bucket stands for lower bits.
    """
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    s = token[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(first) - 1
    holders = np.bincount(group)
    many = np.zeros(len(token), bool)
    many[order] = holders[group] > 1
    local = (owner[many], token[many])
    alone = ~many
    several = np.flatnonzero(holders > 1)
    token = np.concatenate([token[alone], s[np.flatnonzero(first)[several]]])
    owner = np.concatenate([owner[alone], np.full(len(several), len(sets))])
    held = np.concatenate([np.ones(alone.sum(), np.int64), holders[several]])
    bucket = (token & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(bucket * (len(sets) + 1) + owner, kind="stable")
    token, owner, held, bucket = token[order], owner[order], held[order], bucket[order]
    names = np.append(nodes, 0)
    rows = []
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        x, y = edges[b], edges[b + 1]
        if x < y:
            who, count = np.unique(owner[x:y], return_counts=True)
            t = (token[x:y] >> np.uint64(32)).astype(np.uint32) if short else token[x:y]
            rows.append((b, names[who].tobytes(), count.astype(np.uint32).tobytes(), t.tobytes(), held[x:y][owner[x:y] == len(sets)].astype(np.uint32).tobytes()))
    return local, rows


def gather(rows: list[tuple[bytes, bytes, bytes, bytes]], short: bool):
    """(nodes, tokens) of one bucket's entries whose shingle another node holds too, and (tokens, holders) of the frequent ones."""
    nodes, counts = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, np.int64), (1, np.uint32)))
    token = np.frombuffer(b"".join(r[2] for r in rows), np.uint32 if short else np.uint64)
    holder = np.ones(len(token), np.int64)
    node = np.repeat(nodes, counts)
    holder[node == 0] = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
    order = np.argsort(token, kind="stable")
    token, node, holder = token[order], node[order], holder[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    total = np.add.reduceat(holder, start)
    # Node 0 stands for several; entries of one node alone are copies of one set.
    shared = np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start)
    own = np.repeat(shared, np.diff(np.append(start, len(token)))) & (node != 0)
    often = total >= LEAST_FREQUENT
    return node[own], token[own], token[start][often], total[often]


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


_DEALT = "bucket int, nodes binary, counts binary, tokens binary, holders binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    bucket, *rest = zip(*rows)
    return _batch(["bucket", "nodes", "counts", "tokens", "holders"], [pa.array(bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)])


def _by_bucket(source):
    """The rows of each bucket together; they come sorted by bucket."""
    held, at = [], None
    for batch in source:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if b != at and held:
                yield at, held
                held = []
            at = b
            held.append(row)
    if held:
        yield at, held


def _alive(docs: DataFrame, nodes: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """nodes that may be near to another one: enough of their sets' first shingles are held by others.

    A set's first (size - least + k) shingles, by hash, hold k at least of those that it shares with a near one.
    """

    def enough(size):
        return np.minimum(1 + size // EXTRA, least_overlap(size, percent))

    def batches(source):
        held, names, total = [], [], 0

        def out():
            # Equal sets of one stretch are one node.
            _, first = np.unique(np.array(names, np.int64), return_index=True)
            node, sets = np.array(names, np.int64)[first], [held[i] for i in first.tolist()]
            (owner, _), rows = deal(node, sets, buckets, True)
            credit = np.bincount(owner, minlength=len(node))
            some = np.flatnonzero(credit)
            if len(some):
                # Bucket -1: what is known here already.
                rows.append((-1, node[some].tobytes(), credit[some].astype(np.uint32).tobytes(), b"", b""))
            return _dealt(rows)

        for batch in source:
            for part in cut(batch):
                found = shingles.sets(part.column(0), n)
                for s, one in zip(found, shingles.names(found)[0].tolist()):
                    size = len(s)
                    if size > 1:  # only an equal set can be near to a smaller one
                        lead = s[: int(size - least_overlap(size, percent) + enough(size))]
                        held.append(lead)
                        names.append(one)
                        total += len(lead)
                if total >= STRETCH:
                    yield out()
                    held, names, total = [], [], 0
        if held:
            yield out()
        give_back()

    def credits(source):
        for b, rows in _by_bucket(source):
            if b < 0:
                node, count = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, np.int64), (1, np.uint32)))
            else:
                node, count = np.unique(gather(rows, True)[0], return_counts=True)
            for k in range(0, len(node), 100_000):
                yield _batch(["one", "shared"], [node[k : k + 100_000], count[k : k + 100_000].astype(np.int64)])
        give_back()

    dealt = map_batches(docs.select("_text"), batches, _DEALT)
    # Bucket -1 is dealt over all tasks.
    dealt = dealt.repartition(buckets, F.when(F.col("bucket") < 0, -F.pmod(F.xxhash64("nodes"), F.lit(1 << 20)) - 1).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    shared = map_batches(dealt, credits, "one long, shared long").groupBy("one").agg(F.sum("shared").alias("shared"))
    size = F.col("size")
    least = F.ceil(F.lit(percent) * size / F.lit(100))
    return nodes.where("size > 1").join(shared, "one").where(F.col("shared") >= F.least(F.floor(size / EXTRA) + 1, least)).drop("shared")


def presence(spark, ids: DataFrame):
    """A broadcast bit table of fixed size in which the bit of every id in ids(rep) is set."""
    bits = ids.where("rep is not null").select(id_bit(F.col("rep")).alias("bit")).distinct().toArrow().column(0).to_numpy()
    mask = np.zeros(FILTER_BITS, bool)
    mask[bits] = True
    return spark.sparkContext.broadcast(np.packbits(mask))


def id_bit(c):
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")


def _marked(bits: pa.Array, packed: np.ndarray) -> np.ndarray:
    """Which of the rows may be of an id in the presence table; rows without an id may."""
    at = bits.fill_null(0).to_numpy(zero_copy_only=False)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) | bits.is_null().to_numpy(zero_copy_only=False)


def _sets(docs: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    """(node, size, tokens) of the nodes in alive. The texts are read again rather than kept; those whose id
    has no bit in the presence table are passed over."""
    packed = presence(docs.sparkSession, alive)

    def batches(source):
        for batch in source:
            batch = batch.filter(pa.array(_marked(batch.column(1), packed.value)))
            for part in cut(batch):
                found = shingles.sets(part.column(0), n)
                yield _batch(["one", "two", "tokens"], [*shingles.names(found), pa.array([s.tobytes() for s in found], pa.binary())])
        give_back()

    read = docs.select("_text", F.when(F.col("_id").isNotNull(), id_bit(F.col("_id"))).alias("bit"))
    found = map_batches(read, batches, "one long, two long, tokens binary").join(alive.select("one", "two", "node", "size"), ["one", "two"])
    # Equal sets of several documents may come several times.
    return found.groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))


def _shared(sets: DataFrame, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """((node, size, tokens) with the tokens that another node of sets holds, if enough, and (token, holders) of frequent ones)."""

    def batches(source):
        held, names, total = [], [], 0

        def out():
            node = np.array(names, np.int64)
            (owner, token), rows = deal(node, held, buckets, False)
            if len(owner):
                who, count = np.unique(owner, return_counts=True)
                rows.append((-1, node[who].tobytes(), count.astype(np.uint32).tobytes(), token.tobytes(), b""))
            return _dealt(rows)

        for batch in source:
            for part in cut(batch):
                names += part.column(0).to_pylist()
                held += [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                total = sum(map(len, held))
                if total >= STRETCH:
                    yield out()
                    held, names, total = [], [], 0
        if held:
            yield out()
        give_back()

    def tokens(source):
        for b, rows in _by_bucket(source):
            for part in [[r] for r in rows] if b < 0 else [rows]:
                if b < 0:
                    node, token = np.repeat(np.frombuffer(part[0][0], np.int64), np.frombuffer(part[0][1], np.uint32)), np.frombuffer(part[0][2], np.uint64)
                    often = total = np.empty(0, np.int64)
                else:
                    node, token, often, total = gather(part, False)
                order = np.argsort(node, kind="stable")
                node, token = node[order], token[order]
                start = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node)) if len(node) else np.zeros(1, np.int64)
                for k in range(0, len(start) - 1, 5000):
                    edge = start[k : k + 5001]
                    yield _batch(["node", "tokens", "holders"], [node[edge[:-1]], pa.array([token[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary()), pa.nulls(len(edge) - 1, pa.int64())])
                for k in range(0, len(often), 100_000):
                    t = often[k : k + 100_000].view(np.int64)
                    yield _batch(["node", "tokens", "holders"], [t, pa.nulls(len(t), pa.binary()), total[k : k + 100_000]])
        give_back()

    dealt = map_batches(sets.select("node", "tokens"), batches, _DEALT)
    dealt = dealt.repartition(buckets, F.when(F.col("bucket") < 0, -F.pmod(F.xxhash64("nodes"), F.lit(1 << 20)) - 1).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    found = written(map_batches(dealt, tokens, "node long, tokens binary, holders long"), "shared-shingles")
    each = found.where("holders is null").groupBy("node").agg(F.collect_list("tokens").alias("parts"))
    size, held = F.col("size"), F.floor(F.aggregate("parts", F.lit(0), lambda s, x: s + F.octet_length(x)) / 8)
    kept = sets.select("node", "size").join(each, "node").where(F.ceil(F.lit(percent) * size / F.lit(100)) <= held)

    def joined(source):
        for batch in source:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                together = [np.sort(np.frombuffer(b"".join(x), np.uint64)).tobytes() for x in part.column(2).to_pylist()]
                yield _batch(["node", "size", "tokens"], [part.column(0), part.column(1), pa.array(together, pa.binary())])
        give_back()

    return written(map_batches(kept, joined, "node long, size long, tokens binary"), "sets"), found.where("holders is not null").select(F.col("node").alias("token"), "holders")


def _frequent(spark, counted: DataFrame):
    """A broadcast of (frequent tokens, their ranks), at most MOST_FREQUENT of them."""
    counted = written(counted, "frequent")
    # One row for each power of two.
    steps = sorted(counted.groupBy(F.floor(F.log2("holders")).cast("int").alias("k")).count().collect(), reverse=True)
    least, held = LEAST_FREQUENT, 0
    for r in steps:
        held += r["count"]
        if held > MOST_FREQUENT:
            least = 1 << (r["k"] + 1)
            break
    often = counted.where(F.col("holders") >= least).toArrow()
    token, holders = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    by_token, rank = np.argsort(token), np.argsort(np.lexsort((token, holders)))
    return spark.sparkContext.broadcast((token[by_token], rank[by_token].astype(np.uint32)))


def _keys(sets: DataFrame, percent: int, boundary: int, frequent) -> DataFrame:
    """(token, node, size, most, share): the list entries of every node that is left.

    most is the largest size that a near set can have, as the node shares no more shingles than its set in sets
    has; share is that number by its size.
    """

    def batches(source):
        often, rank = frequent.value

        def leading(s: np.ndarray, count: int) -> np.ndarray:
            """The first `count` of s in the common order: by hash, and the frequent ones last, by rank."""
            at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
            same = often[at] == s if len(often) else np.zeros(len(s), bool)
            last = s[same][np.argsort(rank[at[same]], kind="stable")] if same.any() else s[:0]
            return np.concatenate([s[~same], last])[:count]

        for batch in source:
            for part in cut(batch):
                made, nodes, sizes, mosts, shares = [], [], [], [], []
                for node, size, raw in zip(*(c.to_pylist() for c in part.columns)):
                    s = np.frombuffer(raw, np.uint64)
                    least = least_overlap(size, percent)
                    most = min(100 * size // percent, len(s) * (100 + percent) // percent - size)
                    if most < least:
                        continue
                    # Shingles that no other node holds come first in the order, and are left out.
                    prefix = size - least + 1 - (size - len(s))
                    first = leading(s, prefix + 1)
                    keys = []
                    if size <= boundary:
                        i, j = np.triu_indices(len(first), 1)
                        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                        keys.append(mix(low * P1 + mix(high)))
                    # Light sets that a heavy one can be near to are in the lists too.
                    if size > boundary or 100 * size >= percent * boundary:
                        keys.append(first[:prefix])
                    made += keys
                    count = sum(map(len, keys))
                    for column, value in zip((nodes, sizes, mosts, shares), (node, size, most, len(s) / size)):
                        column.append(np.full(count, value))
                if made:
                    whole = np.concatenate(made).view(np.int64)
                    columns = [np.concatenate(c) for c in (nodes, sizes, mosts, shares)]
                    for k in range(0, len(whole), 200_000):
                        yield _batch(["token", "node", "size", "most", "share"], [whole[k : k + 200_000], *(c[k : k + 200_000] for c in columns)])
        give_back()

    return map_batches(sets.select("node", "size", "tokens"), batches, "token long, node long, size long, most long, share double")


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with shared, the number of shingles that a and b share, and rest, those of a that b lacks."""

    @F.pandas_udf("struct<shared:bigint,rest:binary>")
    def compared(a, b):
        import pandas as pd

        shared, rest = [], []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            shared.append(int(same.sum()))
            rest.append(x[~same].tobytes())
        return pd.DataFrame({"shared": pd.Series(shared, dtype="int64"), "rest": pd.Series(rest, dtype=object)})

    small_batches()
    first, second = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"set_{c}")) for c in "ab")
    columns = [F.col(c) for c in pairs.columns]
    return pairs.join(first, "a").join(second, "b").select(*columns, compared("set_a", "set_b").alias("_c")).select(*columns, "_c.shared", "_c.rest")


def _needed(size_a, size_b, percent: int):
    """100 |A and B| >= percent |A or B| means (100 + percent) |A and B| >= percent (|A| + |B|)."""
    return F.ceil(F.lit(percent) * (F.col(size_a) + F.col(size_b)) / F.lit(100 + percent))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """(a, size_a, b, size_b): each node a with its hub b, the foremost node that shares a list with a and may be near.

    In a list, one node of each class of sizes stands forth; of two systems of classes, half a class
    apart, so that sets of about one size meet in one of them.
    """
    place = F.log(F.col("size").cast("double")) / F.log(F.lit(100 / percent))
    both = lists.withColumn("class", F.explode(F.array((2 * F.floor(place)).cast("int"), (2 * F.floor(place + 0.5) + 1).cast("int"))))
    top = both.groupBy("token", "class").agg(F.max(F.struct("share", "node", "size", "most")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = both.join(top, ["token", "class"]).where("top.node <> node and struct(top.share, top.node) > struct(share, node) and top.size <= most and size <= top.most")
    best = met.groupBy("node").agg(F.first("size").alias("size_a"), F.max("top").alias("top"))
    return best.select(F.col("node").alias("a"), "size_a", F.col("top.node").alias("b"), F.col("top.size").alias("size_b"))


def _ordered(met: DataFrame) -> DataFrame:
    """met(x, size_x, y, size_y) as (a, size_a, b, size_b) with a < b, each once."""
    pick = lambda p, q, name: F.when(F.col("x") < F.col("y"), F.col(p)).otherwise(F.col(q)).alias(name)
    return met.select(pick("x", "y", "a"), pick("size_x", "size_y", "size_a"), pick("y", "x", "b"), pick("size_y", "size_x", "size_b")).distinct()


def _side(df: DataFrame, end: str, columns: list[str]) -> DataFrame:
    return df.select("token", *(F.col(c).alias(f"{end if c == 'node' else f'{c}_{end}'}") for c in columns))


_ENTRY = ["node", "size", "most", "label", "hub", "held"]
_MAY = "label_x <> label_y and size_x <= most_y and size_y <= most_x"


def _outside(stars: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one hub, in different components, that share a shingle outside the hub and hold less of it than they must share."""

    def tokens(source):
        for batch in source:
            for part in cut(batch):
                found = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                count = [len(x) for x in found]
                if sum(count):
                    yield _batch(["node", "token"], [np.repeat(part.column(0).to_numpy(), count), np.concatenate(found)])
        give_back()

    # A node is loose if it is not linked with its hub, by whatever way.
    loose = members.where("hub <> node").withColumnRenamed("away", "loose")
    hubs = loose.where("loose").select("hub").distinct()
    open_ = written(loose.join(hubs, "hub", "left_semi").select("node", "size", "most", "label", "hub", "held", "loose"), "open-nodes")
    rest = stars.select(F.col("a").alias("node"), "rest").join(open_.select("node"), "node", "left_semi")
    entries = map_batches(rest, tokens, "node long, token long").join(open_, "node")
    # The hub's number goes into the key: shingles meet within one hub's nodes only.
    entries = written(entries.withColumn("token", F.xxhash64("hub", "token")), "outside")
    met = _side(entries.where("loose"), "x", _ENTRY).join(_side(entries, "y", _ENTRY), "token").where(f"{_MAY} and hub_x = hub_y").where(F.least("held_x", "held_y") < _needed("size_x", "size_y", percent))
    return _ordered(met)


def _again(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share a list, of different hubs or both holding as much of theirs as they must share."""
    least = F.ceil(F.lit(percent) * F.col("size") / F.lit(100))
    # Two nodes that hold that much of one hub, one of which is not linked with it.
    known = members.withColumn("full", F.col("away") & (F.col("held") >= least)).drop("away")
    at = written(lists.select("token", "node").join(known, "node"), "labelled")
    shares = at.groupBy("token", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = shares.groupBy("token").agg(F.max_by("hub", F.struct("n", "hub")).alias("main"), F.max("full").alias("full"), F.count(F.lit(1)).alias("hubs"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high and (hubs > 1 or full)").select("token", "main")
    inside = written(at.join(open_, "token"), "open-members")
    few = _side(inside.where("hub <> main or full"), "x", _ENTRY)
    enough = F.least("held_x", "held_y") >= _needed("size_x", "size_y", percent)
    return _ordered(few.join(_side(inside, "y", _ENTRY), "token").where(_MAY).where((F.col("hub_x") != F.col("hub_y")) | enough))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link when 100 |A and B| >= percent |A or B|.

    A set holds the distinct n-word shingles of the whole text; with fewer words the whole sequence is
    the one shingle; a null or wordless text has the empty set and links with nothing (its component is
    its own id).  component_id is the smallest id reachable by links, itself included.  Rows with a null
    id take part and get the component's smallest id (null if there is none); repeated rows are documents
    each, so copies link; an empty table gives no rows; other columns are not read.  A very long text is
    hashed in pieces cut between words, to the same set.  percent must be over 50.

    Components are all that is found: two nodes that are in one already are never compared, so this gives
    neither the links nor their number.
    """
    out = _grouped(docs, id_col, text_col, n, percent)
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("_id")).otherwise(F.col("smallest")).alias("component_id"))


def _buckets(tokens: int) -> int:
    return max(LEAST_BUCKETS, 1 << max(0, tokens // BUCKET).bit_length())


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(_id, _mark, size, root, smallest) of every row, _mark a hash of its text; the last two are null for a row without words."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    every = written(_named(docs, n), "ngram-sets")
    nodes = every.where("size > 0").groupBy("one", "two").agg(F.min("_id").alias("rep"), F.first("size").alias("size"))
    nodes = written(nodes.select((F.monotonically_increasing_id() + 1).alias("node"), "*"), "nodes")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    # About (100 - percent) / 100 + 1 / EXTRA of each set is dealt first.
    alive = written(_alive(docs, nodes, n, percent, _buckets(total * (100 - percent) // 100 + total // EXTRA)), "alive")
    left = alive.agg(F.sum("size")).first()[0] or 0
    sets, counted = _shared(written(_sets(docs, alive, n), "alive-sets"), percent, _buckets(left))
    frequent = _frequent(spark, counted)

    # What lists would cost small sets decides the boundary.
    small = written(_keys(sets.where(F.col("size") <= MOST_BOUNDARY), percent, 0, frequent).select("token", (F.col("size") / 4).cast("int").alias("class")), "small-lists")
    holders = small.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    stats = small.join(holders, "token").groupBy("class").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("n") - 1).alias("other")).collect()  # a row for each class
    boundary = choose_boundary([(r["class"], r["seen"], r["other"]) for r in stats], percent)

    lists = written(_keys(sets, percent, boundary, frequent), "lists")
    stars = written(_overlap(_stars(lists, percent), sets), "stars")
    labels = written(components(stars.where(F.col("shared") >= _needed("size_a", "size_b", percent))), "labels")
    placed = lists.groupBy("node").agg(F.first("size").alias("size"), F.first("most").alias("most"))
    hub = stars.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("shared").alias("held"))
    members = placed.join(labels, "node", "left").join(hub, "node", "left")
    members = written(members.select("node", "size", "most", F.coalesce("component", "node").alias("label"), F.coalesce("hub", "node").alias("hub"), F.coalesce("held", "size").alias("held")), "placed")
    # Whether a node is in another component than its hub. A table of its own, so that a hub's many nodes can be dealt over tasks.
    hub_label = members.select(F.col("node").alias("hub"), F.col("label").alias("_of_hub"))
    members = written(members.join(hub_label, "hub").withColumn("away", F.col("label") != F.col("_of_hub")).drop("_of_hub"), "members")

    apart = written(_outside(stars, members, percent).union(_again(lists, members, percent)).distinct(), "apart")
    more = written(_overlap(apart, sets).where(F.col("shared") >= _needed("size_a", "size_b", percent)).select("a", "b"), "more-links")
    side = lambda c: members.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    merged = components(more.join(side("a"), "a").join(side("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("root"))
    rooted = members.select("node", "label").join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    grouped = written(nodes.join(rooted, "node", "left").select("one", "two", "rep", F.coalesce("root", "node").alias("root")), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("smallest"))
    named = written(grouped.join(smallest, "root").select("one", "two", "root", "smallest"), "named")
    return every.join(named, ["one", "two"], "left").select("_id", "_mark", "size", "root", "smallest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: that with the smallest id.

    Of several rows with that id, equal or near, one stays; a repeated id whose texts are in different
    components stays once in each. Rows without words and rows with a null id stay.  Only the texts whose
    id may be among those to go are shuffled: a fixed-size presence filter passes the others through.
    """
    spark = docs.sparkSession
    i, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    found = written(_grouped(docs, id_col, text_col, n, percent).where("_id is not null and size > 0"), "near-duplicates")
    keepers = written(found.where("_id = smallest").groupBy("_id", "root").agg(F.min("_mark").alias("_mark")).select("_id", "_mark"), "keepers")
    rows = found.groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("n"))
    going = rows.where("n > 1").select("_id").union(rows.join(keepers, ["_id", "_mark"], "left_anti").select("_id"))
    packed = presence(spark, going.select(F.col("_id").alias("rep")))

    # Only the number of a bit goes to Python, and no task needs two workers.
    @F.arrow_udf("boolean")
    def maybe(bits: pa.Array) -> pa.Array:
        return pa.array(_marked(bits, packed.value))

    small_batches()
    bit = F.coalesce(id_bit(i), F.lit(0))
    words = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    sure = docs.where(i.isNull() | ~maybe(bit))
    looked = docs.where(i.isNotNull() & maybe(bit))
    named = keepers.select(F.col("_id").alias("_keep"), F.col("_mark").alias("_of"))
    # The row as one value, so that no name clashes.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = looked.where(words).select(whole, i.alias("_i"), F.xxhash64(text).alias("_m")).join(named, (F.col("_i") == F.col("_keep")) & (F.col("_m") == F.col("_of")))
    once = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_keep", "_of").orderBy(F.lit(1)))).where("_k = 1")
    return sure.unionByName(looked.where(~words)).unionByName(once.select("_row.*"))
