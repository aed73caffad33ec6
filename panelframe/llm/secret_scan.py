"""Secret scans: a keyword automaton finds the places, an anchored pattern reads each, checksums confirm."""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import map_rows, text_column, typed

BASE_KINDS = ["assign", "access", "hex"]
# The kinds that the checksum step adds.
CHECKED_KINDS = ["github", "npm", "jwt", "card"]
KINDS = BASE_KINDS + CHECKED_KINDS

# Keywords (lower case) that begin a candidate, by kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
}
# What is read at a hit.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
RUN = re.compile(r"[A-Za-z0-9_-]+")
CARD = re.compile(r"(?<![0-9A-Za-z.-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,4}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_suffix_fits(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, mark = token[4:-6], token[-6:]
    n = 0
    for c in mark:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body.encode())


def header_decodes(token: str) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def luhn_fits(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = (sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 16 and sum(doubled) % 10 == 0


READ = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: crc_suffix_fits(m[0])),
    "npm": (NPM, lambda m: crc_suffix_fits(m[0])),
    "jwt": (JWT, lambda m: header_decodes(m[0])),
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed in KINDS."""
    found, taken = [], {}
    for end, (kind, n) in automaton().iter(text.translate(_LOWER)):
        start = end - n + 1
        if start < taken.get(kind, 0):
            continue  # within an earlier match of this kind
        pattern, passes = READ[kind]
        if m := pattern.match(text, start):
            taken[kind] = m.end()
            if passes(m):
                found.append((start, m.end(), kind))
        elif kind == "jwt" and (run := RUN.match(text, start)):
            # All hits of one run have the same part after it, so none of them matches.
            taken[kind] = run.end()
    # Runs of digits have no keyword: a pattern of their own class finds them.
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if luhn_fits(m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets array<struct<kind, start, end>>) for each input row, over the whole text.

    start and end are code points, end exclusive.  A null or empty text has no secrets (an empty
    array); a very long one is read whole, in time that grows with its length; null ids stay null; repeated
    rows each give a row; an empty table gives none; other columns are not read.  Matches of one kind never
    overlap; those of different kinds may, and of two that start together the kind listed first in KINDS comes
    first.  No row is shuffled.
    """
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([typed(docs, id_col), T.StructField("secrets", T.ArrayType(item))])

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            yield i, [{"kind": k, "start": a, "end": b} for a, b, k in spans(text)] if text else []

    return map_rows(docs, {"i": id_col, "t": text_col}, out, rows)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret of its text masked; overlapping secrets become one mask. Nulls stay null.

    All columns stay as they are but for the text; no row goes.  No shuffle: each row is scanned in place.
    """

    masked = text_column(F.col(f"`{text_col}`"), T.StringType(), lambda texts: [_mask(t, mask) if t else t for t in texts])
    return docs.withColumn(text_col, masked)


def _mask(text: str, mask: str) -> str:
    out, done = [], 0
    for start, end, _ in spans(text):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind and the joined spans of find_secrets() output."""
    s = F.col("secrets")
    line = lambda kinds: F.array_join(F.transform(F.filter(s, lambda x: x["kind"].isin(kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(line(BASE_KINDS), 256).alias("base_sha256"), line(KINDS).alias("spans"))
