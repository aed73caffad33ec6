"""Prefix trie of rebuilt conversations, as a burst trie: containers of suffixes under trie heads."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.llm.common import give_back, map_batches, written

# A turn in a path: 16 bytes of its name, 8 of its number of words (big-endian).
NAME, TURN = 16, 24
# A container of more turns than this, or than its part of all turns, bursts.
LEAST_TURNS, MOST_TURNS, PARTS = 256, 200_000, 4096
# Ids of so wide a range are joined to one piece of a member list.
ID_RANGE = 1 << 10
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, path): each conversation as its turns' names and word counts, TURN bytes each, in hexadecimal.

    Conversation c gets the first h turns of c - c % family (all, if fewer; none, if it is absent), then its own after
    its first h; h is the CRC-32 of its decimal id modulo `shared`.  Turns go by number, without one first; of equal
    numbers by role, then text.  A turn's name is 128 bits of SHA-256 over its role and text.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role, said = text(role_col), text(text_col)
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, said), 256), 1, 2 * NAME)
    words = F.lpad(F.hex(F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 2 * (TURN - NAME), "0")
    # Role and text are in the order only to tell turns of one number apart.
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.struct(F.col(f"`{turn_col}`").alias("at"), role.alias("role"), F.sha2(said, 256).alias("said"), F.lower(F.concat(name, words)).alias("turn")).alias("t"))
    listed = rows.where("c is not null").groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("all"))
    own = written(listed.select("c", F.transform("all", lambda t: t["turn"]).alias("turns")), "conversations")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % shared).cast("int")
    heads = own.select(F.col("c").alias("base"), F.slice("turns", 1, shared - 1).alias("lead"))
    asks = own.select("c", "turns", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    lead = F.when(F.col("h") > 0, F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return asks.join(heads, "base", "left").select(F.col("c").alias("conv_id"), F.array_join(F.concat(lead, rest), "").alias("path"))


def _ends(named: DataFrame) -> DataFrame:
    """(name, ends) of named(name, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids come together in pieces of a bounded range; the pieces of a name, in order, run through one hash.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = named.groupBy("name", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(piece.alias("piece"))

    def batches(source):
        name, hashed = None, None
        for batch in source:
            out = []
            for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != name:
                    if name is not None:
                        out.append((name, hashed.hexdigest()))
                    name, hashed = n, hashlib.sha256(p.encode())
                else:
                    hashed.update(b"," + p.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["name", "ends"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hashed.hexdigest()])], names=["name", "ends"])

    return map_batches(pieces.repartition("name").sortWithinPartitions("name", "range").select("name", "piece"), batches, "name string, ends string")


def _distinct(paths: DataFrame) -> DataFrame:
    """(path binary, first, n, ends) of every distinct path: its smallest conversation, how many, and the hash of all of them."""
    named = written(paths.select("conv_id", F.sha2("path", 256).alias("name"), F.unhex("path").alias("path")), "rebuilt")
    groups = written(named.groupBy("name").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")), "path-groups")
    several = named.select("name", "conv_id").join(groups.where("n > 1").select("name"), "name")
    ends = _ends(several)
    one = groups.join(named.select(F.col("conv_id").alias("first"), F.col("name").alias("_name"), "path"), "first").where("name = _name").drop("_name")
    return one.join(ends, "name", "left").select("path", "first", "n", F.coalesce("ends", F.sha2(F.col("first").cast("string"), 256)).alias("ends"))


def _head(depth) -> F.Column:
    """The name of the prefix of `depth` turns of a row's path."""
    return F.substring(F.unhex(F.sha2(F.expr(f"substring(path, 1, cast({depth} as int) * {TURN})"), 256)), 1, NAME)


def _burst(suffixes: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of suffixes whose containers are small enough, heads of each round): suffixes(head, up, depth, path, first, n, ends).

    A container too large bursts after the turns that all its suffixes share: by their next turn, so that a round
    never only moves a container on.  up is the head above.
    """
    settled, rounds = [], []
    length = F.octet_length("path") / TURN
    while True:
        large = suffixes.groupBy("head").agg(F.sum(length - F.col("depth") + 1).alias("turns"), F.count(F.lit(1)).alias("rows")).where((F.col("turns") > limit) & (F.col("rows") > 1)).select("head")
        large = written(large, "large-containers")
        if large.isEmpty():
            settled.append(suffixes)
            return settled, rounds
        settled.append(written(suffixes.join(large, "head", "left_anti"), "settled"))
        inside = suffixes.join(large, "head")
        edges = inside.groupBy("head").agg(F.first("up").alias("up"), F.first("depth").alias("depth"), F.min("path").alias("low"), F.max("path").alias("high"))

        def common(source):
            for batch in source:
                rows = []
                for head, up, depth, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                    stop = depth
                    while low[stop * TURN : (stop + 1) * TURN] == high[stop * TURN : (stop + 1) * TURN] != b"":
                        stop += 1
                    rows.append((head, up, depth, stop, low[: stop * TURN]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["head", "up", "depth", "stop", "prefix"])

        heads = written(map_batches(edges.select("head", "up", "depth", "low", "high"), common, "head binary, up binary, depth long, stop long, prefix binary"), "heads")
        moved = written(inside.drop("up", "depth").join(heads.select("head", "stop"), "head"), "burst")
        # The one path that ends where the others part is its head's own.
        own = moved.where(length == F.col("stop")).select("head", F.col("first").alias("own_first"), F.col("n").alias("own_n"), "ends")
        rounds.append(written(heads.join(own, "head", "left"), "burst-heads"))
        suffixes = written(moved.where(length > F.col("stop")).select(_head("stop + 1").alias("head"), F.col("head").alias("up"), (F.col("stop") + 1).alias("depth"), "path", "first", "n", "ends"), "suffixes")


class _Sweep:
    """Nodes of containers whose sorted suffixes come one after another.  Open nodes, from a container's head down, are
    [depth, first, members, children, leaves, saved, ends, words]; closed ones wait for their parent's smallest member."""

    def __init__(self):
        self.head, self.up, self.open, self.prev, self.rows = None, None, [], b"", []

    def begin(self, head: bytes, up: bytes | None, depth: int, path: bytes) -> None:
        self.finish()
        self.head, self.up = head, up
        self.open = [self._node(depth, path)]
        self.prev = path[: depth * TURN]

    @staticmethod
    def _node(depth: int, path: bytes) -> list:
        words = int.from_bytes(path[depth * TURN - TURN + NAME : depth * TURN], "big") if depth else 0
        return [depth, None, 0, 0, 0, 0, _NO_ENDS, words, []]

    def add(self, path: bytes, first: int, n: int, ends: str) -> None:
        turns = len(path) // TURN
        same = self.open[0][0]
        while same < turns and path[same * TURN : (same + 1) * TURN] == self.prev[same * TURN : (same + 1) * TURN]:
            same += 1
        while self.open[-1][0] > same:
            self.close()
        for depth in range(same + 1, turns + 1):
            self.open.append(self._node(depth, path))
        top = self.open[-1]
        top[1], top[2], top[6] = first if top[1] is None else min(first, top[1]), top[2] + n, ends
        self.prev = path

    def close(self) -> None:
        depth, first, n, children, leaves, saved, ends, words, below = self.open.pop()
        leaves = leaves or 1
        saved += (n - 1) * words
        # What is below waited for this node's smallest member.
        self.rows += [(*row[:2], first, *row[3:]) for row in below]
        row = (first, depth, None, n, children, leaves, saved, ends)
        if self.open:
            up = self.open[-1]
            up[1] = first if up[1] is None else min(first, up[1])
            up[2] += n
            up[3] += 1
            up[4] += leaves
            up[5] += saved
            up[8].append(row)
        else:
            self.rows.append((*row, self.head, self.up))

    def finish(self) -> None:
        while self.open:
            self.close()


_SWEPT = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in NODE.split(", ")] + [("head", pa.binary()), ("up", pa.binary())]


def _swept(suffixes: DataFrame) -> DataFrame:
    """The nodes of all containers: those below a container's head whole, its head's own with head and up, its parent open."""

    def batches(source):
        sweep = _Sweep()

        def out():
            rows = [r if len(r) == len(_SWEPT) else (*r, None, None) for r in sweep.rows]
            sweep.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _SWEPT)], names=[c for c, _ in _SWEPT])

        for batch in source:
            for head, up, depth, path, first, n, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if head != sweep.head:
                    sweep.begin(head, up, depth, path)
                sweep.add(path, first, n, ends)
                if len(sweep.rows) >= 10_000:
                    yield out()
        sweep.finish()
        if sweep.rows:
            yield out()
        give_back()

    ordered = suffixes.repartition("head").sortWithinPartitions("head", "path")
    return map_batches(ordered.select("head", "up", "depth", "path", "first", "n", "ends"), batches, f"{NODE}, head binary, up binary")


def _chains(heads: DataFrame) -> DataFrame:
    """The nodes of burst containers, from heads with what their children add up to: from where all its suffixes part up to its head."""

    def batches(source):
        for batch in source:
            rows = []
            for head, up, depth, stop, prefix, own_first, own_n, ends, first, n, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                n += own_n or 0
                first = first if own_first is None else min(first, own_first)
                for d in range(stop, depth - 1, -1):
                    saved += (n - 1) * (int.from_bytes(prefix[d * TURN - TURN + NAME : d * TURN], "big") if d else 0)
                    own = d == stop
                    top = d == depth
                    rows.append((first, d, None if top else first, n, children if own else 1, leaves, saved, ends if own and ends else _NO_ENDS, head if top else None, up if top else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _SWEPT)], names=[c for c, _ in _SWEPT])

    names = ["head", "up", "depth", "stop", "prefix", "own_first", "own_n", "ends", "first", "n", "children", "leaves", "saved"]
    return map_batches(heads.select(*names), batches, f"{NODE}, head binary, up binary")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, shared: int = 4, container_turns: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations: see rebuilt() for these, NODE for the columns.

    A node is a sequence of first turns of some conversation, the root that of none; conv_id is its smallest member.
    Equal conversations are one path with a count from the start, so copies cost no more than their ids.  All paths
    begin in one container; a container of more than container_turns turns (if None: a PARTS-th of all, within
    LEAST_TURNS and MOST_TURNS) bursts by the next turn, and what is left is sorted by container and path and swept.
    Burst heads are added up from their children, the last round's first.

    A null role or text is empty; a turn without a number comes first; rows without a conversation take no part; rows
    alike in all columns are turns each; of one number in one conversation the order is by role, then by the text's
    hash; an empty table gives no rows; other columns are not read.  Very long texts are only hashed and counted;
    a conversation's turns, TURN bytes each, are together in one value.
    """
    paths = rebuilt(turns, conv_col, turn_col, role_col, text_col, family, shared)
    suffixes = _distinct(paths).select(_head("0").alias("head"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "path", "first", "n", "ends")
    suffixes = written(suffixes, "suffixes")
    limit = container_turns
    if limit is None:
        total = suffixes.agg(F.sum(F.octet_length("path") / TURN)).first()[0] or 0
        limit = min(max(LEAST_TURNS, int(total) // PARTS), MOST_TURNS)
    settled, rounds = _burst(suffixes, limit)
    small = settled[0]
    for s in settled[1:]:
        small = small.unionByName(s)
    parts = [written(_swept(small), "swept")]
    # What each container's head tells the one above.
    for heads in reversed(rounds):
        told = parts[0].where("up is not null")
        for p in parts[1:]:
            told = told.unionByName(p.where("up is not null"))
        below = told.groupBy(F.col("up").alias("head")).agg(F.min("conv_id").alias("first"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        parts.append(written(_chains(heads.join(below, "head")), "chains"))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    if not rounds:
        return nodes.drop("head", "up")
    # The parent of a container's head is the node at which the container above burst; it has that one's smallest member.
    above = parts[1].where("head is not null")
    for p in parts[2:]:
        above = above.unionByName(p.where("head is not null"))
    above = above.select(F.col("head").alias("up"), F.col("conv_id").alias("_above"))
    open_ = nodes.where("up is not null").join(above, "up").withColumn("parent_conv_id", F.col("_above")).drop("head", "up", "_above")
    return nodes.where("up is null").drop("head", "up").unionByName(open_)
