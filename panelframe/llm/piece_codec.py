"""SentencePiece encoding that keeps offsets: every piece is projected to the bytes of the text it stands for."""

from __future__ import annotations

import codecs
import functools
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import Memo, map_batches, slices, typed
from panelframe.llm.pretokens import MEMO_ENTRIES, tokenizer_path

MODEL = "piece_bpe_32k.model"
# The visible space, and the piece types of the model file.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# Characters of a long text that are normalised and encoded at once.
STRETCH = 1 << 20
# Parts of at most so many characters merge without a heap.
SHORT = 48


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffers message; values are ints, floats or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            part = data[at : at + size]
            at += size
            yield key >> 3, part if kind == 2 else np.frombuffer(part, "<f8" if kind == 1 else "<f4")[0]


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, each with the place of its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.unit = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.text = blob[4 + size :]
        # Bytes that can begin a rule.
        self.first = bytes(b for b in range(256) if self.unit and self._step(self._base(0), b) is not None)
        self.begins = re.compile(b"[" + re.escape(self.first) + b"]") if self.first else None

    def _base(self, node: int) -> int:
        u = self.unit[node]
        return node ^ ((u >> 10) << ((u & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.unit) and self.unit[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest rule that data has at this place."""
        found, base = None, self._base(0)
        for k in range(at, len(data)):
            node = self._step(base, data[k])
            if node is None:
                break
            base = self._base(node)
            if self.unit[node] >> 8 & 1:
                found = self.unit[base] & 0x7FFFFFFF, k + 1 - at
        return found and (self.text[found[0] : self.text.index(b"\0", found[0])], found[1])


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("piece-bytes", _one_each)


class PieceCodec:
    """Encodes as a SentencePiece model of kind BPE with byte fallback does, and decodes.

    A text is normalised by the longest prefix that the compiled map has, and every byte that comes out keeps
    the place of the character it comes from.  The best-scored neighbours merge first, the leftmost of equal
    ones.  Sums of the pieces' lengths then give places in the normalised text, and through it in the original.
    """

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # Fixed numbers of the file's fields, with their defaults.
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only models of kind BPE with byte fallback")
        self.unknown_text = bytes(trainer.get(44, " ⁇ ".encode())).decode()
        self.suffix_space = bool(trainer.get(24, 0))
        self.map = CharacterMap(bytes(normalizer.get(2, b"")))
        self.dummy, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.names = [bytes(p[1]).decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        score = [float(p.get(2, 0.0)) for p in pieces]
        # Equal scores have equal ranks; the best is 0.
        rank = {s: r for r, s in enumerate(sorted(set(score), reverse=True))}
        kind = lambda *k: [i for i, x in enumerate(self.kinds) if x in k]
        self.ids = {self.names[i]: i for i in kind(NORMAL, USER_DEFINED, UNUSED)}
        self.rank = {self.names[i]: rank[score[i]] for i in kind(NORMAL, USER_DEFINED, UNUSED)}
        self.unused = {self.names[i] for i in kind(UNUSED)}
        self.control = np.array([k == CONTROL for k in self.kinds])
        self.byte_ids = [0] * 256
        for i in kind(BYTE):
            self.byte_ids[int(self.names[i][3:5], 16)] = i
        own = sorted((self.names[i] for i in kind(USER_DEFINED)), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        # What each id stands for when decoded, and how many normalised bytes it covers.
        shown = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else n.replace(BLANK, " ").encode() for n, k in zip(self.names, self.kinds)]
        self.blob, self.offset = np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)])
        self.covers = np.array([1 if k == BYTE else len(n.encode()) for n, k in zip(self.names, self.kinds)], np.int64)
        # Where no piece holds a visible space after another character, no merge crosses that border.
        apart = not self.own and not any(re.search(f"[^{BLANK}]{BLANK}", n) for n in self.ids)
        self.part = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if apart and self.escape else None
        self.cuts = apart and not self.suffix_space and not self.map.unit
        self.memo = Memo(self._encode_part, MEMO_ENTRIES)

    def normalise(self, text: str, first: bool = True, last: bool = True, after_space: bool = False) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and the end the byte of text that it comes from)."""
        data, out, source = text.encode("utf-8", "surrogatepass"), [], []
        if not data:
            return b"", np.zeros(1, np.int64)
        space = self.squeeze and (first or after_space)

        def add(made: bytes, places: np.ndarray, leading: bool) -> None:
            """made, less the spaces that follow a space: all of them, or those that lead."""
            nonlocal space
            if self.squeeze and made:
                blank = np.frombuffer(made, np.uint8) == 32
                if leading:
                    drop = np.logical_and.accumulate(blank) & space
                else:
                    drop = blank & np.concatenate([[space], blank[:-1]])
                made, places = np.frombuffer(made, np.uint8)[~drop].tobytes(), places[~drop]
                space = made.endswith(b" ") if made else space
            if made:
                out.append(made)
                source.append(places)

        def own(a: int, b: int) -> None:
            """data[a:b], whose characters stand for themselves; each byte comes from its character's first."""
            raw = np.frombuffer(data, np.uint8)[a:b]
            add(data[a:b], np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(a, b), a)), False)

        kept = [(m.start(), m.end()) for m in re.finditer(self.own.pattern.encode(), data)] if self.own else []
        kept.append((len(data), len(data)))
        at = 0
        for start, end in kept:
            while at < start:
                m = self.map.begins.search(data, at, start) if self.map.begins else None
                hit = m.start() if m else start
                if hit > at:
                    own(at, hit)
                    at = hit
                if m:
                    rule = self.map.longest(data, at)
                    if rule and at + rule[1] <= start:
                        add(rule[0], np.full(len(rule[0]), at), True)
                        at += rule[1]
                    else:
                        size = 1
                        while at + size < start and data[at + size] & 0xC0 == 0x80:
                            size += 1
                        own(at, at + size)
                        at += size
            if end > start:
                add(data[start:end], np.full(end - start, start), True)
                at = end
        made = np.frombuffer(b"".join(out), np.uint8)
        places = np.concatenate([np.empty(0, np.int64), *source])
        stop = len(data)
        if self.squeeze and last:
            text = made.tobytes()
            keep = len(text)
            while (blank := 1 if text.endswith(b" ", 0, keep) else 3 if self.escape and text.endswith(BLANK.encode(), 0, keep) else 0) > 0:
                keep -= blank
            if keep < len(made):
                stop = int(places[keep])
            made, places = made[:keep], places[:keep]
        if first and self.squeeze and not len(made):
            return b"", np.zeros(1, np.int64)
        begin = int(places[0]) if first and self.squeeze else 0
        sign = np.frombuffer(BLANK.encode() if self.escape else b" ", np.uint8)
        if self.escape:
            width = np.where(made == 32, 3, 1)
            at_end = np.cumsum(width)
            wide = np.repeat(made, width)
            spaces = at_end[made == 32]
            for k in range(3):
                wide[spaces - 3 + k] = sign[k]
            made, places = wide, np.repeat(places, width)
        if self.dummy and (last if self.suffix_space else first):
            extra = np.full(len(sign), stop if self.suffix_space else begin)
            made, places = (np.concatenate(x) for x in (((made, sign), (places, extra)) if self.suffix_space else ((sign, made), (extra, places))))
        return made.tobytes(), np.append(places, stop)

    def _encode_part(self, part: str) -> bytes:
        """The ids of normalised text by itself, as little-endian unsigned 32-bit integers."""
        symbols = list(part)
        fixed = set()
        if self.own:
            symbols, at = [], 0
            for m in self.own.finditer(part):
                symbols += part[at : m.start()]
                fixed.add(len(symbols))
                symbols.append(m.group())
                at = m.end()
            symbols += part[at:]
        n, rank, split = len(symbols), self.rank.get, {}
        if n <= SHORT and not fixed and not self.unused:
            return self._ids_of(self._merge_short(symbols))
        heap = [r * n + i for i in range(n - 1) if i not in fixed and i + 1 not in fixed and (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if symbols[i] is None or j >= n or rank(made := symbols[i] + symbols[j]) != r:
                continue  # one of the two has merged since
            if made in self.unused:
                split[made] = symbols[i], symbols[j]
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if k not in fixed and (r := rank(made + symbols[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and h not in fixed and (r := rank(symbols[h] + made)) is not None:
                heappush(heap, r * n + h)
        last, todo = [], [s for s in reversed(symbols) if s is not None]
        while todo:
            s = todo.pop()
            if s in split:
                todo += reversed(split[s])
            else:
                last.append(s)
        return self._ids_of(last)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same merges, by looking through all neighbours each time: less work than a heap where they are few."""
        rank, never = self.rank.get, len(self.rank)
        ranks = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], never)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], never)
        return symbols

    def _ids_of(self, symbols: list[str]) -> bytes:
        ids, out = self.ids.get, []
        for s in symbols:
            i = ids(s)
            out += (i.to_bytes(4, "little"),) if i is not None else [self.byte_ids[b].to_bytes(4, "little") for b in s.encode("utf-8", "surrogatepass")]
        return b"".join(out)

    def _stretches(self, text: str):
        """text in parts cut before a space that follows another character, where nothing reaches over such a border: no piece and no rule."""
        at = 0
        while self.cuts and len(text) - at > STRETCH:
            cut = at + STRETCH
            while (cut := text.find(" ", cut)) > 0 and text[cut - 1] in f" {BLANK}":
                cut += 1
            if cut < 0:
                break
            yield text[at:cut], at == 0, False
            at = cut
        yield text[at:], at == 0, True

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, byte after the last) of the pieces, bytes of the UTF-8 text."""
        every, begins, ends, base = [], [], [], 0
        for part, first, last in self._stretches(text):
            made, source = self.normalise(part, first, last)
            raw = made.decode("utf-8", "surrogatepass")
            ids = np.frombuffer(b"".join(map(self.memo.__getitem__, self.part.findall(raw))) if self.part else self._encode_part(raw), "<u4")
            stop = np.cumsum(self.covers[ids])
            every.append(ids)
            begins.append(source[np.concatenate([[0], stop[:-1]])] + base if len(ids) else stop)
            ends.append(source[stop] + base if len(ids) else stop)
            base += int(len(part.encode("utf-8", "surrogatepass"))) if not last else 0
        return np.concatenate(every), np.concatenate(begins), np.concatenate(ends)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: an offset table gives the bytes; the first visible space goes if the model adds or strips it."""
        lead, k = "", 0
        while (self.dummy or self.squeeze) and k < len(ids):
            i = int(ids[k])
            if self.kinds[i] == BYTE:
                break
            k += 1
            if self.kinds[i] == CONTROL:
                continue
            name = self.names[i]
            lead = self.unknown_text if self.kinds[i] == UNKNOWN else name.removeprefix(BLANK).replace(BLANK, " ")
            if lead or not self.squeeze:
                break
        rest = np.asarray(ids[k:], np.int64)
        # Bytes on either side of a control piece are no one character.
        return lead + "".join(self._shown(part) for part in np.split(rest, np.flatnonzero(self.control[rest])))

    def _shown(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            start = self.offset[part]
            size = self.offset[part + 1] - start
            stop = np.cumsum(size)
            out.append(self.blob[np.arange(stop[-1]) + np.repeat(start - (stop - size), size)].tobytes())
        return b"".join(out).decode("utf-8", "piece-bytes")


@functools.cache
def codec(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode and decode every whole text: (id, ids array<int>, starts array<long>, ends array<long>, decoded string).

    Piece k stands for the bytes starts[k] to ends[k] (exclusive) of the UTF-8 text; of the byte pieces of one
    character the last has its span and the others are empty, and so is a space that the model puts in front.
    A null text counts as empty: no pieces, an empty decoded text.  Null ids stay null; repeated rows each give a
    row; an empty table gives none; other columns of any name are not read.  A very long text is taken in stretches
    cut at spaces that no piece reaches over; with a map that
    has rules, it is taken whole.  No row is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    path = model or tokenizer_path(MODEL)
    longs = T.ArrayType(T.LongType())
    out = T.StructType([typed(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", longs), T.StructField("ends", longs), T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(out)

    def batches(source):
        c = codec(path)
        for batch in slices(source):
            found = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            edges = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.empty(0, kind), *(x[k] for x in found)]).astype(kind)), type=arrow.field(k + 1).type) for k, kind in enumerate((np.int32, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([c.decode(x[0]) for x in found], pa.string())], schema=arrow)

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), batches, out)
