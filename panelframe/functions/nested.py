"""JSON documents of any depth, merged and redacted in place of a map's one level; a narrow pass of Arrow batches, no shuffle.

Depth is a matter of the document: values are walked with a list of what is still to do, not by calls, and a text
that is no JSON, or nested deeper than the parser goes, counts as broken and gives null.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelframe.functions.batches import small_batches
from panelframe.functions.logs import INNOCENT, KEY_SHAPES, REDACTED, SENSITIVE_PARTS, SENSITIVE_WORDS

# The memory that a series begins with, and the newest version of it that is understood.
VERSION = 2
SCAFFOLD = {"series_title": "", "chapter": None, "characters": {}, "locations": {}, "story_threads": [], "key_events": [], "_meta": {"last_panel": 0, "seed_built": False, "image_seed_built": False, "version": VERSION}}
_WORDS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SHAPES = [re.compile(p) for p in KEY_SHAPES]


class _BROKEN:
    """Stands for a text that is no JSON; a class, since functions go to workers with copies of other objects."""




def _read(text: str | None):
    try:
        return _BROKEN if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return _BROKEN


def _write(value) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return None


def merge(base: dict, own: dict) -> dict:
    """base with own laid over it: objects join key by key at every depth, anything else of own takes the place of base's."""
    out = dict(base)
    todo = [(out, own)]
    while todo:
        into, over = todo.pop()
        for k, v in over.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                into[k] = dict(into[k])
                todo.append((into[k], v))
            else:
                into[k] = v
    return out


@functools.lru_cache(10_000)
def is_sensitive(name: str) -> bool:
    """logs.is_sensitive_key for one name."""
    bare = re.sub("[^a-z0-9]", "", name.lower())
    return bare not in INNOCENT and (any(w.lower() in SENSITIVE_WORDS for w in _WORDS.findall(name)) or re.search(SENSITIVE_PARTS, bare) is not None)


def redact(value):
    """value without what sensitive keys hold, at every depth; a bare text without key-shaped parts."""
    if isinstance(value, str):
        for p in _SHAPES:
            value = p.sub(REDACTED, value)
        return value
    out = [value]
    todo = [(out, 0)]
    while todo:
        into, at = todo.pop()
        v = into[at]
        if isinstance(v, dict):
            into[at] = new = {k: REDACTED if is_sensitive(k) else x for k, x in v.items()}
            todo += [(new, k) for k, x in new.items() if isinstance(x, dict | list)]
        elif isinstance(v, list):
            into[at] = new = list(v)
            todo += [(new, k) for k, x in enumerate(new) if isinstance(x, dict | list)]
    return out[0]


def blank(config: dict) -> dict:
    """config with its own sensitive fields emptied."""
    return {k: "" if v and is_sensitive(k) else v for k, v in config.items()}


def load(value) -> tuple[dict, str]:
    """(a stored memory over the scaffold, loaded, reset or broken): one of a newer version, or none, gives the scaffold alone."""
    if value is _BROKEN or not isinstance(value, dict):
        return SCAFFOLD, "broken"
    meta = value.get("_meta") or {}
    if not isinstance(meta, dict):
        return SCAFFOLD, "broken"
    version = meta.get("version", 0)
    if isinstance(version, int) and not isinstance(version, bool) and version > VERSION:
        return SCAFFOLD, "reset"
    out = merge(SCAFFOLD, value)
    if not isinstance(out["_meta"], dict):
        return SCAFFOLD, "broken"
    return merge(out, {"_meta": {"version": VERSION}}), "loaded"


def _mapped(function: Callable, kind: str, *columns: Column) -> Column:
    small_batches()
    arrow = {"string": pa.string(), "struct<context:string,state:string>": pa.struct([("context", pa.string()), ("state", pa.string())])}[kind]

    @F.arrow_udf(kind)
    def over(*batch: pa.Array) -> pa.Array:
        return pa.array([function(*row) for row in zip(*(c.to_pylist() for c in batch))], arrow)

    return over(*columns)


def merged_json(base: Column, own: Column) -> Column:
    """JSON objects as one, own over base; null if base is no object, base if own is none."""

    def one(a, b):
        a, b = _read(a), _read(b)
        return None if not isinstance(a, dict) else _write(merge(a, b) if isinstance(b, dict) else a)

    return _mapped(one, "string", base, own)


def redacted_json(document: Column) -> Column:
    """The document without what it holds under sensitive keys, at any depth; null if it is no JSON."""
    return _mapped(lambda t: None if (v := _read(t)) is _BROKEN else _write(redact(v)), "string", document)


def blanked_config(document: Column) -> Column:
    """A configuration's own sensitive fields emptied, as it is stored; null if it is no object."""
    return _mapped(lambda t: _write(blank(v)) if isinstance(v := _read(t), dict) else None, "string", document)


def loaded_context(document: Column) -> Column:
    """struct(context, state): a stored story memory laid over the scaffold. state is loaded; reset for a version beyond VERSION, which the caller keeps aside; broken."""

    def one(text):
        context, state = load(_read(text))
        return {"context": _write(context), "state": state}

    return _mapped(one, "struct<context:string,state:string>", document)
