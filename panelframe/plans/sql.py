"""The fixed patterns as DuckDB string literals, and SQL fragments that several queries share."""

from __future__ import annotations

from panelframe.functions import text as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPACE, LATIN, LETTER, FOREIGN, WORD, CJK = (lit(p) for p in (X.SPACE, X.LATIN, X.LETTER, X.FOREIGN, X.WORD, X.CJK))
DOMAIN, PROMO, CALL, NON_LEXICAL = (lit("(?i)" + p) for p in (X.DOMAIN, X.PROMO, X.CALL_TO_ACTION, X.NON_LEXICAL))
ACTION, REVEAL, SFX = (lit("(?i)" + p) for p in (X.ACTION_WORDS, X.REVEAL_WORDS, X.SFX_WORDS))
ENDS = lit(X.TERMINAL + "$")


def count(e: str, p: str) -> str:
    return f"len(regexp_extract_all({e}, {p}))"


def words(e: str) -> str:
    return f"({count(e, WORD)} + {count(e, CJK)})"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^{X.SPACE}+|{X.SPACE}+$')}, '', 'g')"


def tidy(e: str) -> str:
    e = f"regexp_replace({e}, {lit(X.SPACE + '{2,}')}, ' ', 'g')"
    e = f"regexp_replace({e}, {lit(X.SPACE + '+([,.!?])')}, '\\1', 'g')"
    return f"trim(regexp_replace({e}, '([,.!?]){{2,}}', '\\1', 'g'), ' ,;')"


def strip_non_latin(e: str) -> str:
    return tidy(f"regexp_replace({e}, {FOREIGN}, ' ', 'g')")


def normalise(e: str) -> str:
    s = f"trim(regexp_replace({e}, {lit(X.SPACE + '+')}, ' ', 'g'))"
    return f"(CASE WHEN {s} <> '' AND NOT regexp_matches({s}, {ENDS}) THEN {s} || '.' ELSE {s} END)"


def ratio(e: str) -> str:
    return f"coalesce({count(e, LATIN)}::DOUBLE / nullif({count(e, LETTER)}, 0), 1.0)"


def panel_class(n: str, d: str) -> str:
    both = f"lower({n}) || ' ' || lower({d})"
    return (
        f"CASE WHEN regexp_matches({both}, {ACTION}) THEN 'action' WHEN regexp_matches({both}, {REVEAL}) THEN 'reveal' "
        f"WHEN {count(d, lit('!+'))} + {count(n, lit('!+'))} >= 2 THEN 'action' WHEN {strip(d)} <> '' THEN 'dialogue' ELSE 'calm' END"
    )


def ms_up(e: str) -> str:
    return f"ceil(round_even(({e}) * 1000.0, 6)) / 1000.0"
