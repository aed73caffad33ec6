"""Order-preserving packing: window cuts that minimise padding plus truncation, by dynamic programming.

Cuts are at ends of documents and of sentences; only a sentence longer than a window is cut within."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import give_back, map_batches, slices, typed
from panelframe.llm.pretokens import VOCABULARY, Words, tokenizer_path, vocabulary

# Tokens of the documents that are cut together; a larger document is a block of its own.
BLOCK_TOKENS = 1 << 20
# What a cut costs, in tokens of padding: after a document, after a sentence, within one.
AFTER_DOCUMENT, AFTER_SENTENCE, WITHIN = 0.0, 100.0, 1000.0
# A sentence longer than the window may be cut after every so many tokens.
STRIDE = 64


# Words in each generation of the table of known ones: fewer than elsewhere, as other stages run in the same workers.
KNOWN_WORDS = 100_000


class Encoder:
    """Texts to ids as little-endian bytes; kept word by word. Ranks file and vocabulary file are the same vocabulary."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        # Not from the cache: of the vocabulary, only what is kept below is needed.
        ids, _, self.special = vocabulary.__wrapped__(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # The library's ids, should they be numbered in another order than the ranks.
        self.id_of = np.zeros(max(ranks.values()) + 1, "<u4")
        for name, r in ranks.items():
            self.id_of[r] = ids[name]
        self.words = Words(lambda piece: self.id_of[core.encode_ordinary(piece)].tobytes() if piece else b"", KNOWN_WORDS)
        self.ends = np.zeros(len(ids) + len(self.special), bool)
        for name, i in ids.items():
            self.ends[i] = name.rstrip(b'"\')')[-1:] in (b".", b"!", b"?", b"\n")

    def __call__(self, text: str) -> bytes:
        for s, i in self.special.items():
            if s in text:
                return i.to_bytes(4, "little").join(self(x) for x in text.split(s))
        return b"".join(self.words(text)) if text else b""


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def candidates(ends: np.ndarray, doc_ends: np.ndarray, window: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(places where a cut may be, what each costs): 0 first, then the ends of documents and sentences.

    Between two that are more than a window apart, and only there, every stride-th token is one too.
    """
    n = int(doc_ends[-1])
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(ends) + 1] = AFTER_SENTENCE
    cost[doc_ends] = AFTER_DOCUMENT
    cost[0] = 0.0
    places = np.flatnonzero(np.isfinite(cost))
    for i in np.flatnonzero(np.diff(places) > window).tolist():
        cost[places[i] + stride : places[i + 1] : stride] = WITHIN
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def cuts(places: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """The cut places of the cheapest division into windows of at most `window` tokens.

    best[j] = cost[j] + the least over i of best[i] + the room that is left, window - (places[j] - places[i]).
    best[i] + places[i] over the reachable i is a sliding-window minimum, held in a monotone queue.  Two places
    in a row are at most a window apart.  A short sequence costs all its empty room, whatever padding it gets.
    """
    at, price, m = places.tolist(), cost.tolist(), len(places)
    back, key = [0] * m, [0.0] * m
    head, queue = 0, [0]
    for j in range(1, m):
        place = at[j]
        low = place - window
        while at[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        # best[j] + places[j]
        key[j] = mine = key[queue[head]] + window + price[j]
        while len(queue) > head and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    out, j = [], m - 1
    while j:
        out.append(at[j])
        j = back[j]
    return np.array([0, *out[::-1]])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack all documents, in the order in which they are stored, into sequences of at most `window` ids.

    Gives one row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ids are the
    piece's token ids as little-endian unsigned 32-bit integers, and a document is its text's ids and
    then end_id.  Each scan partition is packed on its own, block by block, so nothing is shuffled and a
    lost task is redone alone; each block's last sequence may be padded.  sequence_id is the partition's
    number times 2^33 plus a count.

    A null or empty text is a document of end_id alone; null ids stay null; repeated rows are packed
    each; a very long text is a block of its own; of equally cheap divisions the one with the earlier cuts is
    taken; an empty table gives no rows; other columns are not read.  window must be at least STRIDE.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    path = tokenizer or tokenizer_path(VOCABULARY)
    long = T.LongType()
    out = T.StructType([typed(docs, id_col), *(T.StructField(n, k) for n, k in (("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)))])
    arrow = to_arrow_schema(out)

    def pieces(encode, ids: list, found: list[bytes], first: int):
        tokens = np.frombuffer(b"".join(found), "<u4")
        doc_ends = np.cumsum([len(x) // 4 for x in found])
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        cut = cuts(*candidates(encode.ends[tokens], doc_ends, window), window)
        begins = np.union1d(cut[:-1], doc_starts)
        sizes = np.diff(np.append(begins, doc_ends[-1]))
        doc, seq = np.searchsorted(doc_starts, begins, "right") - 1, np.searchsorted(cut, begins, "right") - 1
        step = 20_000
        for k in range(0, len(begins), step):
            b, z, d, s = begins[k : k + step], sizes[k : k + step], doc[k : k + step], seq[k : k + step]
            raw = tokens[b[0] : b[-1] + z[-1]].tobytes()
            body = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.append(b - b[0], b[-1] + z[-1] - b[0]).astype(np.int32) * np.int32(4)), pa.py_buffer(raw)])
            columns = [pa.array([ids[x] for x in d.tolist()], arrow.field(0).type), b - doc_starts[d], z, body, doc_ends[d] - doc_starts[d], first + s, b - cut[s]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=arrow)
        return first + len(cut) - 1

    def batches(source):
        from pyspark import TaskContext

        encode, tail = encoder(path), int(end_id).to_bytes(4, "little")
        first, ids, found, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in slices(source):
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                found.append(encode(text or "") + tail)
                held += len(found[-1]) // 4
                if held >= block_tokens:
                    first = yield from pieces(encode, ids, found, first)
                    ids, found, held = [], [], 0
        if ids:
            yield from pieces(encode, ids, found, first)
        encode.words.forget()
        give_back()

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), batches, out)
