"""Exact byte-pair encoding by backtracking over longest token matches, and decoding by offsets."""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import Memo, map_batches, slices, typed
from panelframe.llm.pretokens import MEMO_ENTRIES, PRETOKEN, Words, tokenizer_path, vocabulary


class Codec:
    """Encodes in time linear in the text: at each place the longest token that an Aho-Corasick automaton
    finds is tried first, then its shorter token prefixes; a token is accepted if byte-pair encoding could
    leave it beside its predecessor.  A place from which no token fits is marked and never reached again."""

    def __init__(self, path: str):
        ids, merges, self.special = vocabulary(path)
        self.ids = ids
        names = sorted([*ids.items(), *((s.encode(), i) for s, i in self.special.items())], key=lambda x: x[1])
        if [i for _, i in names] != list(range(len(names))):
            raise ValueError("token ids must be 0, 1, 2, ... without a gap")
        self.names = [b for b, _ in names]
        # The offset table: token i is blob[offset[i]:offset[i + 1]].
        self.blob = np.frombuffer(b"".join(self.names), np.uint8)
        self.offset = np.cumsum([0, *map(len, self.names)])
        # A token made by the merge of rank r stands r places after all single bytes.
        self.order = {ids[bytes([b])]: b for b in range(256)}
        self.halves, self.pair = {}, {}
        for r, (a, b) in enumerate(merges):
            t = ids[a + b]
            self.order[t], self.halves[t], self.pair[ids[a], ids[b]] = 256 + r, (ids[a], ids[b]), 256 + r
        self.shorter = {}
        for name, t in ids.items():
            k = len(name) - 1
            while k and name[:k] not in ids:
                k -= 1
            self.shorter[t] = ids[name[:k]] if k else None
        self.automaton = ahocorasick.Automaton()
        for name, t in ids.items():
            self.automaton.add_word(name.decode("latin-1"), (t, len(name)))
        self.automaton.make_automaton()
        self.fits = PairTable(self)
        self.pretoken = Memo(self.encode_pretoken, MEMO_ENTRIES // 2)
        self.words = Words(self._known)

    def _known(self, piece: str) -> bytes:
        return b"".join(map(self.pretoken.__getitem__, PRETOKEN.findall(piece)))

    def encode_pretoken(self, pretoken: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = pretoken.encode("utf-8", "surrogatepass")
        whole = self.ids.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        n = len(raw)
        longest = [(0, 0)] * n
        for end, (t, k) in self.automaton.iter(raw.decode("latin-1")):
            if k > longest[end - k + 1][1]:
                longest[end - k + 1] = t, k
        names, shorter, fits = self.names, self.shorter, self.fits
        out, place, dead, token = [], 0, bytearray(n + 1), longest[0][0]
        while True:
            last = out[-1] if out else None
            while token is not None and (dead[place + len(names[token])] or (last is not None and not fits[last, token])):
                token = shorter[token]
            if token is not None:
                out.append(token)
                place += len(names[token])
                if place == n:
                    break
                token = longest[place][0]
            else:
                dead[place] = 1
                out.pop()
                place -= len(names[last])
                token = last  # tried anew: its end is dead now, so a shorter one follows
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        found = self._split(text)
        return np.frombuffer(b"".join(found), "<u4")

    def _split(self, text: str) -> list[bytes]:
        for s, i in self.special.items():
            if s in text:
                out = []
                for k, part in enumerate(text.split(s)):
                    out += [i.to_bytes(4, "little")] * bool(k) + self._split(part)
                return out
        return self.words(text) if text else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the offset table in blocks."""
        out = []
        for k in range(0, len(ids), 1 << 16):
            part = ids[k : k + (1 << 16)]
            start = self.offset[part]
            size = self.offset[part + np.uint32(1)] - start
            ends = np.cumsum(size)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes())
        return b"".join(out)


class PairTable(dict):
    """(left, right) -> whether byte-pair encoding of their joined bytes ends as just these two tokens."""

    LIMIT = 2_000_000

    def __init__(self, codec: Codec):
        super().__init__()
        self.order, self.halves, self.pair = codec.order, codec.halves, codec.pair

    def __missing__(self, key) -> bool:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[key] = self._check(*key)
        return value

    def _check(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, last first: no pair across the border may have merged earlier
        than what is undone. At equal rank the left side's merge comes first."""
        order, halves = self.order, self.halves
        limit = None
        while True:
            made = self.pair.get((left, right))
            if made is not None and (limit is None or (made, 1) < limit):
                return False
            a, b = order[left], order[right]
            if max(a, b) < 256:
                return True
            if a > b:
                limit, left = (a, 1), halves[left][1]
            else:
                limit, right = (b, 2), halves[right][0]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every whole text: (id, ids array<int>, decoded string).

    A null text counts as empty: no ids, an empty decoded text.  Null ids stay null; repeated rows each
    give a row; an empty table gives none; other columns are not read.  No row is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    path = tokenizer or tokenizer_path()
    out = T.StructType([typed(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(out)

    def batches(source):
        c = codec(path)
        for batch in slices(source):
            found = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.empty(0, "<u4"), *found]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat), type=arrow.field(1).type)
            decoded = pa.array([c.decode(x).decode("utf-8", "replace") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], schema=arrow)

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), batches, out)
