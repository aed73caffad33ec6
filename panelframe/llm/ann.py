"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is cut into balanced parts and a small classifier learns which
part a vector belongs to.  Every row is then filed under its most probable part; a query looks through
as many of its most probable parts as a check on a second sample, kept out of the fitting, asks for, and
all rows found there are ranked by their exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.llm.common import written

# Vectors of the sample on which graph, parts and classifier are fitted (those first by a hash of their id): so
# many roots of the table's rows, within these bounds.  The parts grow with it.
SAMPLE_ROOTS, LEAST_SAMPLE, MOST_SAMPLE = 8, 4000, 32_768
# Neighbours of each vector in the graph; vectors of the sample in a part, about.
GRAPH, PART_SAMPLE = 12, 125
# Share of true neighbours of vectors kept out of the fitting that the probed parts must hold; at most so many are asked.
AIM = 0.95
MOST_ASKED = 1000
HIDDEN, ROUNDS, RATE = 96, 220, 0.01
# Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


@dataclass(frozen=True)
class Router:
    """A two-layer classifier from a vector to its parts, and how many parts a query looks through."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k most probable parts of each row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :k]


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of x with the largest inner products, for each row of queries; in blocks."""
    k = min(k, len(x))
    out = [np.argpartition(-(queries[i : i + 512] @ x.T), k - 1, axis=1)[:, :k] for i in range(0, len(queries), 512)]
    return np.concatenate(out) if out else np.empty((0, k), int)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cut a neighbour graph into parts of nearly equal size with few edges between parts.

    Starts from capacity-bound assignment to random centres; then, in rounds, each vertex moves to the part that
    most of its graph neighbours (both ways) are in, the surest vertices first, where there is room.
    """
    n = len(graph)
    room = -(-n * 21 // (parts * 20))  # five per cent over the mean
    fit = x @ x[rng.choice(n, parts, replace=False)].T
    part, left = np.full(n, -1), np.full(parts, room)
    for i in np.argsort(-fit.max(1), kind="stable"):
        p = next(p for p in np.argsort(-fit[i], kind="stable") if left[p])
        part[i], left[p] = p, left[p] - 1
    src = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(src * parts + part[dst], minlength=n * parts).reshape(n, parts)
        order = np.argsort(-(votes.max(1) - votes[np.arange(n), part]), kind="stable")
        moved, left = 0, room - np.bincount(part, minlength=parts)
        for i in order:
            p = int(votes[i].argmax())
            if votes[i, p] > votes[i, part[i]] and left[p] > 0:
                left[part[i]] += 1
                left[p] -= 1
                part[i], moved = p, moved + 1
        if moved < n // 200:
            break
    return part


def probes_for(router: Router, asked: np.ndarray, among: np.ndarray, own: np.ndarray, k: int, aim: float) -> int:
    """Parts that a query must look through to hold the aimed share of the k nearest of `asked` among `among`, own rows left out."""
    if not len(asked) or len(among) < 2:
        return router.parts
    filed, ranking = router.best(among, 1)[:, 0], router.best(asked, router.parts)
    k, true = min(k, len(among) - 1), []
    for i in range(0, len(asked), 512):
        score = asked[i : i + 512] @ among.T
        score[np.arange(len(score)), own[i : i + 512]] = -np.inf
        true.append(np.argpartition(-score, k - 1, axis=1)[:, :k])
    place = np.argsort(ranking, axis=1)[np.arange(len(asked))[:, None], filed[np.concatenate(true)]]
    held = np.cumsum(np.bincount(place.ravel(), minlength=router.parts)) / place.size
    return min(int(np.searchsorted(held, aim)) + 1, router.parts)


def fit_router(x: np.ndarray, kept: np.ndarray, k: int, aim: float = AIM, seed: int = 11, whole: bool = False) -> Router:
    """Fit parts and classifier on sample vectors x, and the number of probes on those kept out. A sample of under two parts gets one part.

    The neighbours looked for are kept vectors too, which the classifier hasn't seen either; with whole, x and
    kept are all there is, and neighbours come from both.
    """
    n, d = x.shape if x.ndim == 2 else (0, 0)
    parts = n // PART_SAMPLE
    if parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    rng = np.random.default_rng(seed)
    graph = neighbours(x, x, GRAPH + 1)
    part = balanced_parts(graph, x, parts, rng)
    # A vector's target is spread over the parts of its graph neighbours.
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(n), part] += graph.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, ROUNDS + 1):
        rows = rng.choice(n, min(n, 2048), replace=False)
        hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
        out = hidden @ w[2] + w[3]
        p = np.exp(out - out.max(1, keepdims=True))
        d_out = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
        d_hidden = (d_out @ w[2].T) * (hidden > 0)
        for j, g in enumerate((x[rows].T @ d_hidden, d_hidden.sum(0), hidden.T @ d_out, d_out.sum(0))):
            m[j] += 0.1 * (g - m[j])
            v[j] += 0.001 * (g * g - v[j])
            w[j] = w[j] - RATE * (1 - step / (ROUNDS + 1)) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    router = Router(*w, 1)
    rows = rng.choice(len(kept), min(len(kept), MOST_ASKED), replace=False)
    among, first = (np.concatenate([x, kept]), len(x)) if whole else (kept, 0)
    return Router(*w, probes_for(router, kept[rows], among, first + rows, k, aim))


def drawn(vectors: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors to fit on, others kept out): a quarter at least is kept out, and no vector is in both."""
    fit = min(sample, len(vectors) - len(vectors) // 4)
    x = np.unique(vectors[:fit], axis=0)
    seen = {v.tobytes() for v in x + 0.0}
    kept = np.array([v for v in np.unique(vectors[fit:], axis=0) + 0.0 if v.tobytes() not in seen]).reshape(-1, vectors.shape[1])
    return x, kept


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v array<double>) of the rows that take part: non-null ids with finite, non-zero vectors of the length
    that most such rows have (the smaller one on ties); one for each id."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), v.alias("_v")).where("_id is not null and _v is not null")
    rows = rows.where("forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(_v, x -> x <> 0)")
    usual = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is not None:
        rows = rows.where(F.size("_v") == usual["n"])
    return rows.groupBy("_id").agg(F.min("_v").alias("_v"))


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=np.float64)


def search(vectors: DataFrame, asks: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample: int | None = None, aim: float = AIM) -> DataFrame:
    """The k nearest found of every query: (query_id, rank, vec_id, score), by largest inner product in double precision.

    Queries are the rows for whose id asks(id) holds; candidates are all rows but the query's own id; ties
    go to the smaller id.  Every query looks through parts until they hold k candidates, or all that there are.
    Vectors that are null, zero, or hold null or non-finite components take no part; null ids neither; an id
    that comes repeatedly takes part once, with its smallest vector; of vectors of several lengths, those
    of the commonest length take part.  An empty table gives no rows; other columns are not read.
    The sample has SAMPLE_ROOTS roots of the rows, LEAST_SAMPLE at least and MOST_SAMPLE at most, if none is given.

    Rows of a part are cut into blocks of about BLOCK_ROWS and its queries into blocks of BLOCK_QUERIES; each task meets one
    of each, so a part that holds a third of all rows is many tasks.  What goes to the driver: the
    sample (at most twice `sample` vectors) and the row count of each part.
    """
    rows = written(usable(vectors, id_col, vector_col).withColumn("_query", F.coalesce(asks(F.col("_id")), F.lit(False))), "ann-rows")
    if sample is None:
        sample = min(max(SAMPLE_ROOTS * math.isqrt(rows.count()), LEAST_SAMPLE), MOST_SAMPLE)
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(2 * sample).select("_v").collect()
    x, kept = drawn(_matrix(r["_v"] for r in chosen) if chosen else np.empty((0, 1)), sample)
    router = fit_router(x, kept, k, aim, whole=len(chosen) < 2 * sample)
    parts, probes = router.parts, router.probes

    # All parts of a query, most probable first, and the most probable one of any other row.
    @F.pandas_udf("array<int>")
    def routed(v: pd.Series, query: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series([r if q else r[:1] for r, q in zip(router.best(_matrix(v), parts).astype(np.int32), query)], index=v.index, dtype=object)

    filed = written(rows.withColumn("_parts", routed("_v", "_query")), "ann-filed")
    # One count for each part: MOST_SAMPLE / PART_SAMPLE rows at most.
    sizes = {r["_part"]: r["n"] for r in filed.groupBy(F.col("_parts")[0].alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = F.array(*[F.lit(sizes.get(p, 0)).cast("long") for p in range(parts)])
    # A part is looked through if it is among the first, or the parts before it hold fewer than k rows besides the query's own.
    before = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0).cast("long"), lambda total, p: total + size[p])
    probed = filed.where("_query").withColumn("_parts", F.filter("_parts", lambda p, i: (i < probes) | (before(i) <= k)))
    asked = {r["_part"]: r["n"] for r in probed.select(F.explode("_parts").alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.array(*[F.lit(-(-sizes.get(p, 0) // BLOCK_ROWS) or 1) for p in range(parts)])
    lots = F.array(*[F.lit(-(-asked.get(p, 0) // BLOCK_QUERIES) or 1) for p in range(parts)])
    numbers = lambda array: F.explode(F.sequence(F.lit(0), array[F.col("_part")] - 1))
    deal = lambda array: F.pmod(F.xxhash64("_id"), array[F.col("_part")]).cast("int")
    held = filed.select("_id", "_v", F.col("_parts")[0].alias("_part")).where(F.col("_part").isin([*asked]))
    held = held.withColumn("_block", deal(blocks)).withColumn("_lot", numbers(lots))
    asking = probed.select("_id", "_v", F.explode("_parts").alias("_part")).where(F.col("_part").isin([*sizes]))
    asking = asking.withColumn("_lot", deal(lots)).withColumn("_block", numbers(blocks))
    key = ["_part", "_block", "_lot"]

    def near(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_block(queries["_id"].to_numpy(), queries["_v"], block["_id"].to_numpy(), block["_v"], k)

    kind = rows.schema["_id"].dataType.simpleString()
    found = asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(near, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_in_block(query_ids: np.ndarray, query_v, ids: np.ndarray, v, k: int) -> pd.DataFrame:
    """Each query's k nearest in a block of rows. Equal vectors are scored once, so their scores are equal to the last bit."""
    empty = pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.empty(0)})
    if not len(query_ids) or not len(ids):
        return empty
    x, member = np.unique(_matrix(v), axis=0, return_inverse=True)
    member = member.ravel()
    order = np.lexsort((ids, member))
    ids, first = ids[order], np.searchsorted(member[order], np.arange(len(x) + 1))
    queries, out = _matrix(query_v), []
    for i in range(0, len(queries), 256):
        part = queries[i : i + 256]
        rough = part @ x.T
        # A query's own id may take one place, so one more vector is looked at.
        t = min(k + 1, len(x))
        least = np.partition(rough, len(x) - t, axis=1)[:, len(x) - t]
        for j, q in enumerate(part):
            own = query_ids[i + j]
            near = np.flatnonzero(rough[j] >= least[j] - 1e-9 * (1 + abs(least[j])))
            score = np.einsum("ij,j->i", x[near], q)
            many = [ids[first[u] : min(first[u] + k + 1, first[u + 1])] for u in near]
            got, of = np.concatenate(many), np.repeat(score, [len(m) for m in many])
            keep = got != own
            got, of = got[keep], of[keep]
            best = np.lexsort((got, -of))[:k]
            out.append(pd.DataFrame({"query_id": np.full(len(best), own), "vec_id": got[best], "score": of[best]}))
    return pd.concat(out, ignore_index=True) if out else empty
