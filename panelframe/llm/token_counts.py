"""Token counts by byte-pair merging on a heap and a linked list, with no identifiers emitted."""

from __future__ import annotations

import functools
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelframe.llm.common import Memo, map_rows, typed
from panelframe.llm.pretokens import MEMO_ENTRIES, PRETOKEN, Words, tokenizer_path, vocabulary

_WIDE = 1 << 20


class MergeCounter:
    """Counts the tokens of a text: the initial symbols less the merges that byte-pair encoding makes."""

    def __init__(self, path: str):
        ids, merges, special = vocabulary(path)
        self.symbol = [ids[bytes([b])] for b in range(256)]
        self.rank = {ids[a] * _WIDE + ids[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.special = list(special)
        self.pretoken = Memo(self.count_pretoken, MEMO_ENTRIES // 2)
        self.words = Words(lambda piece: sum(map(self.pretoken.__getitem__, PRETOKEN.findall(piece))))

    def count_pretoken(self, pretoken: str) -> int:
        symbols = [self.symbol[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        rank, merged = self.rank.get, self.merged
        # A heap entry is rank * n + place of the pair's left symbol: ties go to the leftmost.
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbols[i] * _WIDE + symbols[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank(symbols[i] * _WIDE + symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merged[r], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] * _WIDE + symbols[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] * _WIDE + symbols[i])) is not None:
                heappush(heap, r * n + h)
        return n - merges

    def __call__(self, text: str) -> int:
        parts, n = [text], 0
        for s in self.special:
            n += text.count(s)
            parts = [x for p in parts for x in p.split(s)]
        return n + sum(sum(self.words(p)) for p in parts if p)


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every whole text: one output row (id, n_bytes, n_tokens, over_limit) for each input row.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a
    row; an empty table gives no rows; other columns of any name are not read.  No row is shuffled.
    """
    path = tokenizer or tokenizer_path()

    def rows(ids, texts):
        count = counter(path)
        for i, text in zip(ids, texts):
            n = count(text) if text else 0
            yield i, len(text.encode("utf-8", "surrogatepass")) if text else 0, n, n > limit

    out = T.StructType([typed(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return map_rows(docs, {"i": id_col, "t": text_col}, out, rows)
