"""Logs, keys and model responses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelframe.functions.text import STOP_WORDS, let, text

# What marks limits, passing faults, credentials and cut-off responses.
RATE_LIMIT = "429|rate_limit|resource_exhausted|quota|too many requests"
TRANSIENT = "connection reset|connection aborted|timed out|timeout|temporarily|try again|overloaded|unavailable|500|502|503|504"
SENSITIVE_WORDS = ["key", "token", "password", "passwd", "secret", "credential", "credentials", "bearer", "auth", "apikey", "apisecret", "authorization", "accesstoken", "refreshtoken"]
SENSITIVE_PARTS = "apikey|token|password|passwd|secret|credential|bearer|auth"
INNOCENT = ["author", "authors", "authored", "authorname"]
KEY_SHAPES = [
    r"sk-[A-Za-z0-9_\-]{8,}",
    r"AIza[A-Za-z0-9_\-]{20,}",
    r"(?i)(?:api[_-]?key|token|authorization)(?:[\"'\s:=]{1,3})[A-Za-z0-9_\-\.]{8,}",
    r"(?i)bearer\s+[A-Za-z0-9_\-\.]{8,}",
    r"(?i)(?:key|token)=([A-Za-z0-9_\-]{8,})",
]
REDACTED = "***REDACTED***"
TRUNCATED = "max_tokens length max_output_tokens".split()


def is_rate_limit(message: Column) -> Column:
    return F.lower(text(message)).rlike(RATE_LIMIT)


def is_transient(message: Column) -> Column:
    return F.lower(text(message)).rlike(TRANSIENT)


def duration_seconds(raw: Column) -> Column:
    """Seconds of '51s', '1.5s', '2m', '250ms' or a bare number; null for anything else."""
    n = F.regexp_extract(F.trim(raw), r"^(-?\d+(?:\.\d+)?)(ms|s|m)?$", 1).try_cast("double")
    unit = F.regexp_extract(F.trim(raw), r"^(-?\d+(?:\.\d+)?)(ms|s|m)?$", 2)
    return F.when(unit == "ms", n / 1000.0).when(unit == "m", n * 60.0).otherwise(n)


def retry_delay(message: Column) -> Column:
    """The delay that a limit's message asks for: its retryDelay field, else its 'retry in N s'."""
    named = F.nullif(F.regexp_extract(message, r'"retryDelay"\s*:\s*"([^"]+)"', 1), F.lit(""))
    said = F.regexp_extract(message, r"[Rr]etry [Ii]n (\d+(?:\.\d+)?)\s*s", 1).try_cast("double")
    return F.coalesce(duration_seconds(named), said)


def is_sensitive_key(key: Column) -> Column:
    """Whether a field's name says that it holds a credential: by a whole word, or a part, of it."""
    bare = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    words = F.transform(F.regexp_extract_all(key, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1), F.lower)
    return ~bare.isin(INNOCENT) & (F.arrays_overlap(words, F.array(*map(F.lit, SENSITIVE_WORDS))) | bare.rlike(SENSITIVE_PARTS))


def redacted_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(is_sensitive_key(k), F.lit(REDACTED)).otherwise(v))


def redacted(c: Column) -> Column:
    """Text without key-shaped parts."""
    for p in KEY_SHAPES:
        c = F.regexp_replace(c, p, REDACTED)
    return c


def finish_label(reason: Column) -> Column:
    return F.lower(F.trim(F.substring_index(reason, ".", -1)))


def is_truncated(reason: Column) -> Column:
    return F.coalesce(finish_label(reason).isin(TRUNCATED), F.lit(False))


def json_part(response: Column) -> Column:
    """The JSON of a response that wraps it in prose or a fence: the longer of its outermost object and array, as text."""
    t = F.regexp_replace(F.regexp_replace(F.trim(response), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")

    def cut(s: Column) -> Column:
        at = lambda a, b: F.struct(F.instr(s, a).alias("i"), (F.length(s) - F.instr(F.reverse(s), b) + 1).alias("j"), (F.instr(s, b) > 0).alias("ok"))
        o, a = at("{", "}"), at("[", "]")
        part = lambda p: F.substr(s, p["i"], p["j"] - p["i"] + 1)
        has = lambda p: (p["i"] > 0) & p["ok"]
        return F.when(has(o) & (~has(a) | (o["j"] - o["i"] >= a["j"] - a["i"])), part(o)).when(has(a), part(a))

    return let(t, cut)


def thread_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9']+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))


def thread_match(hint: Column, summary: Column, least: float = 0.6) -> Column:
    """Whether a summary has enough of a hint's words; a hint of one word never matches."""
    return let(F.struct(thread_words(hint).alias("h"), thread_words(summary).alias("s")), lambda p: (F.size(p["h"]) >= 2) & (F.size(p["s"]) > 0) & (F.size(F.array_intersect(p["h"], p["s"])) / F.size(p["h"]) >= least))


def config_hash(fields: dict[str, Column], style: set[str] = frozenset()) -> Column:
    """A hash of a configuration's essential fields, whatever their order; style fields do not count."""
    names = sorted(k for k in fields if k not in style)
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in names])), 256)


def sanitised(c: Column, most: int = 300) -> Column:
    """One line of at most so many characters, without fences and line ends."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text(c), r"```", ""), r"[\r\n]+", " ")), 1, most)


def bare_name(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def accepted_name(raw: Column, names: dict[str, list[str]], prefix: str) -> Column:
    """The accepted name that raw means: itself if it has the accepted ones' prefix, the one whose own or other spelling it is, else raw."""
    spelling = {"".join(ch for ch in s.lower() if ch.isalnum()): name for name, others in names.items() for s in (name, *others)}
    known = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
    return F.when(raw.startswith(prefix), raw).otherwise(F.coalesce(F.try_element_at(known, bare_name(raw)), raw))
