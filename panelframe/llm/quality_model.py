"""Quality classifier: attention-based multiple-instance learning over a document's passages.

Every passage of a document is encoded; gated attention weighs the passages; the weighted mean of their
encodings is scored.  Only whole documents have labels, so the weights are learned from those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import text_column

# Words of a passage.
PASSAGE_WORDS = 64
# The model is fitted on at most so many labelled documents, those first by a hash of their id.
FIT_DOCUMENTS = 4000
# Of each of these documents, at most so many passages, evenly spread over it; scores are of all passages.
FIT_PASSAGES = 128
WIDTH, ATTENTION, ROUNDS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4
# A document is rejected below this score.
THRESHOLD = 0.3

# Bytes are counted by class: lower, upper, digit, line end, other space, high bytes, and each sign by itself.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[10], _CLASS[[9, 11, 12, 13, 32]] = 0, 1, 2, 3, 4
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 6 + len(_SIGNS)
CLASSES = 7 + len(_SIGNS)
FEATURES = CLASSES + 7


def passages(text: str) -> np.ndarray:
    """A row of features for each passage of a text; one row of zeros for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    codes = np.frombuffer(raw, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    n = len(words)
    first = np.arange(0, n, PASSAGE_WORDS)
    k = len(first)
    at = np.append(begins[first], len(codes))
    at[0] = 0
    size = np.diff(at)
    histogram = np.bincount(np.repeat(np.arange(k), size) * CLASSES + _CLASS[codes], minlength=k * CLASSES).reshape(k, CLASSES)
    in_passage = np.arange(n) // PASSAGE_WORDS
    counts = np.bincount(in_passage, minlength=k)
    h = np.fromiter(map(hash, words), np.int64, n)
    distinct = np.bincount(in_passage[np.unique(h ^ (in_passage * np.int64(0x5851F42D4C957F2D)), return_index=True)[1]], minlength=k)
    again = np.bincount(in_passage[1:], h[1:] == h[:-1], minlength=k)
    in_document = len(set(words)) / n
    ends = codes[np.append(begins[1:], len(codes) + 1) - 2] if n > 1 else codes[-1:]
    odd_end = np.bincount(in_passage, ((_CLASS[ends] >= 6) & (ends != 46) & (ends != 44)), minlength=k)
    upper_start = np.bincount(in_passage, _CLASS[codes[begins]] == 1, minlength=k)
    rest = [distinct / counts, again / counts, odd_end / counts, upper_start / counts, np.log(size / counts), np.log(counts) / 4, np.full(k, in_document)]
    return np.column_stack([np.sqrt(histogram / size[:, None]), *rest]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """The fitted weights: an encoder, gated attention (tanh and sigmoid parts), and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        x = (np.concatenate(bags) - self.mean) / self.scale
        start = np.cumsum([0, *map(len, bags)])[:-1]
        return _forward(self.weights, np.clip(x, -6, 6), start)["score"]


def _forward(w: dict, x: np.ndarray, start: np.ndarray) -> dict:
    """start: the first row of each document's passages in x."""
    sizes = np.diff(np.append(start, len(x)))
    encoded = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(encoded @ w["V"]), 1 / (1 + np.exp(-(encoded @ w["U"])))
    logit = (t * g) @ w["a"]
    weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, start), sizes))
    weight = weight / np.repeat(np.add.reduceat(weight, start), sizes)
    pooled = np.add.reduceat(weight[:, None] * encoded, start)
    score = 1 / (1 + np.exp(-(pooled @ w["c"] + w["b"])))
    return {"sizes": sizes, "encoded": encoded, "t": t, "g": g, "weight": weight, "pooled": pooled, "score": score}


def _gradients(w: dict, x: np.ndarray, start: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict:
    f = _forward(w, x, start)
    d = (f["score"] - y) * importance / importance.sum()
    spread = lambda v: np.repeat(v, f["sizes"], axis=0)
    to_pooled = spread(d[:, None] * w["c"])
    through = (to_pooled * f["encoded"]).sum(1)
    d_logit = f["weight"] * (through - spread(np.add.reduceat(f["weight"] * through, start)))
    d_gate = d_logit[:, None] * w["a"]
    d_t, d_g = d_gate * f["g"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["g"] * (1 - f["g"])
    d_encoded = (to_pooled * f["weight"][:, None] + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - f["encoded"] ** 2)
    return {
        "E": x.T @ d_encoded, "e": d_encoded.sum(0), "V": f["encoded"].T @ d_t, "U": f["encoded"].T @ d_g,
        "a": (f["t"] * f["g"]).T @ d_logit, "c": f["pooled"].T @ d, "b": d.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Fit by Adam on all passages of the labelled documents; both classes weigh by the square root of their share.

    Without labels, or with one class alone, the score is that class's share (one half without any).
    """
    rng = np.random.default_rng(seed)
    shape = {"E": (FEATURES, WIDTH), "e": (WIDTH,), "V": (WIDTH, ATTENTION), "U": (WIDTH, ATTENTION), "a": (ATTENTION,), "c": (WIDTH,), "b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "ac" else np.zeros(s) for k, s in shape.items()}
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        w["c"] = np.zeros(WIDTH)
        w["b"] = np.array([np.log((share + 0.01) / (1.01 - share))])
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    x = np.clip((every - mean) / scale, -6, 6)
    start = np.cumsum([0, *map(len, bags)])[:-1]
    importance = np.where(labels == 1, 1 / np.sqrt(share), 1 / np.sqrt(1 - share))
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        g = _gradients(w, x, start, labels, importance)
        rate = RATE * (1 - step / (rounds + 1))
        for k in w:
            d = g[k] + DECAY * w[k] * (k not in "eb")
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.001 * (d * d - v[k])
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(id_column) -> F.Column:
    """Whether a document is kept from fitting: crc32(id as text) mod 5 is 0; null ids are not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_DOCUMENTS, spread: int = FIT_PASSAGES) -> Model:
    """Fit on at most `most` labelled documents that are not held out: those first by a hash of their id.

    The bounds hold for the sample alone: `most` documents, one row of each id (that with the smallest
    features, so equal rows are as good as one), `spread` passages of each, evenly taken from the whole
    text.  Labels are 0 or 1 (others and nulls are left out; repeated ids count once, with their largest
    label); ids without a document are left out.  Passages are encoded on the executors, and at most
    most * spread rows of features are gathered.
    """
    i = F.col(f"`{id_col}`")
    usable = labels.select(i.alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").where(~held_out(F.col("_id")))
    known = docs.select(i.alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("_id is not null")
    # At most `most` rows by the limit, so this side can be broadcast.
    chosen = usable.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)

    def features(texts: list) -> list[bytes]:
        bags = (passages(t or "") for t in texts)
        return [b[np.linspace(0, len(b) - 1, min(len(b), spread)).astype(int)].tobytes() for b in bags]

    bag = text_column(F.col("_text"), T.BinaryType(), features)
    rows = known.join(F.broadcast(chosen), "_id").select("_id", "_label", bag.alias("_bag")).groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_bag").alias("_bag")).collect()
    rows.sort(key=lambda r: (str(r["_id"]), bytes(r["_bag"])))
    bags = [np.frombuffer(r["_bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r["_label"] for r in rows], dtype=float))


def score_column(model: Model, text_col: str = "text") -> F.Column:
    def scored(texts: list) -> list[float]:
        out = []
        for k in range(0, len(texts), 200):
            out += model.scores([passages(t or "") for t in texts[k : k + 200]]).tolist()
        return out

    return text_column(F.col(f"`{text_col}`").cast("string"), T.DoubleType(), scored)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row, over the whole text.

    A null or empty text is scored as one passage without words, a very long one by all its passages; equal
    texts have equal scores.  Null ids stay null and count as not held out; repeated rows each give a row; an
    empty table gives none; other columns are not read.
    """
    out = docs.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), score_column(model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored below threshold; all columns stay."""
    return docs.where(score_column(model, text_col) >= threshold)

