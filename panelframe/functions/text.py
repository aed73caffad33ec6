"""Text hygiene as column expressions: language share, promo detection, captions, speech windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and vocabularies that results depend on.
LETTER = r"\p{L}"
LATIN = r"[A-Za-z\x{130}\x{212a}]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FOREIGN = (
    r"[^A-Za-z0-9\t-\r\x1c-\x20\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
    r"\x{2018}\x{2019}\x{201a}\x{201c}\x{201d}\x{201e}\x{2013}\x{2014}\x{2026}\x{b7}\x{2022}"
    r"\x{a0}\x{b0}\x{b1}\x{d7}\x{f7}\x{2122}\x{2190}-\x{21ff}]"
)
DOMAIN = (
    r"\b[a-z0-9][a-z0-9-]{1,60}\.(?:com|net|org|io|gg|me|tv|cc|to|sh|app|site|online|club|xyz|top|one|pro|life|world|plus)\b"
)
PROMO = (
    r"(?:\bfastest releases\b|\b(?:re-read|reread)\s+(?:it\s+)?(?:at|on|for)\b|\bcontinue reading\b|\bends on novel chapter\b"
    r"|\bpatreon\b|\bko-?fi\b|\bpaypal\b|\bnovelupdates\b|\bmanga(?:dex|fox|anelo|zobo)\b|\breelise\b|\bneox\b|\basurascans\b"
    r"|\bscanlation\b|\bscanlator\b|\braw (?:and|&) ?translation\b|\btypesetter\b|\bproofreader\b|\bredraw(?:er)?\b"
    r"|\bclean(?:er)? ?by\b|\b(?:tl|tc|ts|pr|cl|rd|qc|ed)\s*[:|]|\bdiscord(?: server)?\b|\btelegram (?:channel|group)\b"
    r"|\bsupport (?:us|this group)\b|\bad-?free\b|\bno ads\b|\bpremium (?:release|access)\b|\bearly access\b"
    r"|\bhosted (?:at|by)\b|\bchannel (?:name|logo)\b|\bwatermark\b)"
)
CALL_TO_ACTION = (
    r"(?:\basura\s*scans?\b|\breaper\s*scans?\b|\bread\s+more\b|\bread\s+(?:more|first|it|them|ahead)\s+(?:at|on|to)\b"
    r"|\bsmash\s+(?:the\s+)?(?:like\s+and\s+)?subscribe\b|\bsubscrib(?:e|ing)\b|\bhit\s+(?:the\s+)?(?:bell|like)\b"
    r"|\bfollow\s+(?:me|us|him|her)\b|\b(?:check|head)\s+(?:out|over)\s+to\b)"
)
ACTION_WORDS = (
    r"\b(attack|strike|punch|kick|slash|explode|blast|clash|dodge|fight|charge|rush|power|death|kills?|destroy|roar|scream"
    r"|shatter|break|rage|fury|impact|smash|crush|battle|war|blood|win|lose|fist|sword|magic|spell|fire|lightning|thunder"
    r"|burst|explodes?)\b"
)
REVEAL_WORDS = (
    r"\b(reveal|shock|sudden|appear|transform|reborn|awakens?|level up|returns?|true form|realized?|discovered?|secret|emerges?)\b"
)
SFX_WORDS = (
    r"\b(swung|swing|swings|drew|draws|unsheathe|unsheathed|unsheathes|slash|slashes|slashed|stab|stabs|stabbed|punch|punches"
    r"|punched|slam|slams|slammed|smash|smashes|smashed|crash|crashes|crashed|shatter|shatters|shattered|exploded|explosion"
    r"|blast|blasted|boom|thunder|roar|roared|scream|screamed|shriek|shrieked|clang|clanged|struck|strike|impact)\b"
)
NON_LEXICAL = r"^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.\x{b7}\x{2022}\x{2014}\x{2013}\-_*~\x{2026}!?]*$"
WORD = r"[A-Za-z0-9']+"
CJK = r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{4e00}-\x{9fff}]"
TERMINAL = r"[.!?\x{2026}\"'\x{201d}\x{2019}]"
LEAST_RATIO, LEAST_LETTERS = 0.6, 2
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "and", "or", "for", "his", "her", "their", "its", "with", "at", "by", "on", "as", "be", "been", "this", "that", "it"]

# Java reads \b, \w and \s as ASCII unless told otherwise.
UNICODE, ANY_CASE = "(?U)", "(?iU)"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Without white space at either end, of any script."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def latin_ratio(c: Column) -> Column:
    """Share of the letters that are ASCII letters when lower-cased; 1.0 without letters."""
    return F.coalesce(count(text(c), LATIN) / F.nullif(count(text(c), LETTER), F.lit(0)), F.lit(1.0))


def tidy(c: Column) -> Column:
    c = F.regexp_replace(c, f"{SPACE}{{2,}}", " ")
    c = F.regexp_replace(c, f"{SPACE}+([,.!?])", "$1")
    return F.btrim(F.regexp_replace(c, r"([,.!?]){2,}", "$1"), F.lit(" ,;"))


# FOREIGN for Java, which asks every part of a class for every character: those outside ASCII alone are asked for the rest.
_FOREIGN = r"[^\t-\r\x1c-\x7e](?<![" + "".join(re.findall(r"\\x\{\w+\}(?:-\\x\{\w+\})?", FOREIGN)) + "])"


def strip_non_latin(c: Column) -> Column:
    return tidy(F.regexp_replace(text(c), _FOREIGN, " "))


def english_bubbles(c: Column) -> Column:
    """struct(kept, dropped): the segments between slashes that have enough Latin letters, and how many do not."""
    pieces = F.filter(F.transform(F.split(text(c), "/"), strip), lambda p: p != "")
    good = lambda p: (count(p, LATIN) >= LEAST_LETTERS) & (latin_ratio(p) >= LEAST_RATIO)
    cleaned = F.transform(pieces, lambda p: F.when(good(p), strip_non_latin(p)))
    kept = lambda k: F.array_join(F.filter(k, lambda p: p != ""), " / ")
    return let(cleaned, lambda k: F.struct(kept(k).alias("kept"), F.size(F.filter(k, F.isnull)).cast("long").alias("dropped")))


def clean_text(narration: Column, dialogue: Column) -> Column:
    bubbles = english_bubbles(dialogue)
    return F.struct(strip_non_latin(narration).alias("narration"), bubbles["kept"].alias("dialogue"), bubbles["dropped"].alias("dropped"))


def _hoisted(pattern: str) -> str:
    """An alternation whose branches all begin at a word's boundary, with that looked for once."""
    return pattern.replace(r"(?:\b", r"\b(?:", 1).replace(r"|\b", "|")


# What every domain name has, which is found faster than the name.
_ENDING = r"(?iu)\." + DOMAIN[DOMAIN.index("(?:") : DOMAIN.rindex(")") + 1]
_DOMAIN, _PROMO, _CALL_TO_ACTION = ANY_CASE + DOMAIN, ANY_CASE + _hoisted(PROMO), ANY_CASE + _hoisted(CALL_TO_ACTION)
# The same with the words, borders and spaces of ASCII alone, as RE2 has them.
_ASCII_BORDER = "(?-i:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_ASCII_DOMAIN, _ASCII_PROMO = ("(?iu)" + p.replace(r"\b", _ASCII_BORDER).replace(r"\s", r"[\t\n\f\r ]") for p in (DOMAIN, _hoisted(PROMO)))
_PLAIN_ENDING, _PLAIN_DOMAIN, _PLAIN_PROMO = ("(?i)" + p.replace(r"\s", r"[\t\n\f\r ]") for p in (_ENDING.removeprefix("(?iu)"), DOMAIN, _hoisted(PROMO)))


def promo_reason(c: Column) -> Column:
    """The first domain name, else the first promo wording; null for a story text."""
    found = lambda t, p: let(F.regexp_extract(t, p, 0), lambda x: F.when(x != "", x))
    return let(text(c), lambda t: strip(F.coalesce(F.when(t.rlike(_ENDING), found(t, _DOMAIN)), found(t, _PROMO))))


def is_promo(c: Column, ascii_words: bool = False) -> Column:
    """Whether promo_reason() gives one; with ascii_words, a letter outside ASCII is no part of a word."""
    named = lambda t, ending, domain, promo: (t.rlike(ending) & t.rlike(domain)) | t.rlike(promo)
    if not ascii_words:
        return let(text(c), lambda t: named(t, _ENDING, _DOMAIN, _PROMO))
    # Letters that are those of ASCII in other case are rare: all else outside ASCII is as good as one mark.
    plain = lambda t: let(F.regexp_replace(t, r"[^\x00-\x7f]+", "\x01"), lambda p: named(p, _PLAIN_ENDING, _PLAIN_DOMAIN, _PLAIN_PROMO))
    return let(text(c), lambda t: F.when(t.rlike(r"[\x{17f}\x{212a}]"), named(t, _ENDING, _ASCII_DOMAIN, _ASCII_PROMO)).otherwise(plain(t)))


def strip_promo(c: Column) -> Column:
    """Domains go before bare names, or a removed name would leave its suffix behind."""
    without = let(text(c), lambda t: F.when(t.rlike(_ENDING), F.regexp_replace(t, _DOMAIN, " ")).otherwise(t))
    for p in (_PROMO, _CALL_TO_ACTION):
        without = F.regexp_replace(without, p, " ")
    return tidy(without)


def is_non_lexical(c: Column) -> Column:
    return text(c).rlike(NON_LEXICAL)


def normalise(c: Column) -> Column:
    """White space collapsed, and a full stop if no mark ends the text."""
    open_end = lambda s: (s != "") & ~s.rlike(f"{TERMINAL}$")
    return let(F.btrim(F.regexp_replace(text(c), f"{SPACE}+", " ")), lambda s: F.when(open_end(s), F.concat(s, F.lit("."))).otherwise(s))


def word_count(c: Column) -> Column:
    """Latin words, and one for each CJK character."""
    return (count(text(c), WORD) + count(text(c), CJK)).cast("long")


def speech_seconds(c: Column, wpm: int = 140) -> Column:
    return F.when(strip(text(c)) == "", 0.0).otherwise(word_count(c) / F.lit(wpm) * 60.0)


def _leading(words: int, then: str = "") -> str:
    """A pattern of a text's beginning with so many words in the sense of word_count(), and what follows."""
    other = WORD.replace("[", "[^", 1).replace("]+", CJK[1:-1] + "]*+")
    return rf"(?s)^(?:{other}(?:{WORD}+|{CJK})){{{words}}}+{then}"


def fit_speech(c: Column, wpm: int = 140, target: float = 4.0, most: float = 4.6, hold: float = 12.0) -> Column:
    """Leading whole sentences within a word budget; a run-on past the holding time is cut at words."""
    budget = lambda s: max(1, int(s * wpm / 60))
    max_words, target_words = budget(most), budget(target)
    hold_words = max(max_words, int(hold * wpm / 60))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        s, words = s["s"], a["words"] + s["n"]
        full = (a["kept"] != "") & (words > target_words)
        more = F.struct(F.when(a["kept"] == "", s).otherwise(F.concat(a["kept"], F.lit(" "), s)).alias("kept"), words.alias("words"), (words >= target_words).alias("done"))
        stop = F.struct(a["kept"].alias("kept"), a["words"].alias("words"), F.lit(True).alias("done"))
        return F.when(a["done"] | full, stop).otherwise(more)

    def trimmed(c: Column) -> Column:
        marked = F.regexp_replace(strip(c), f"({TERMINAL}){SPACE}+", "$1\u0001")
        sentences = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.struct(s.alias("s"), word_count(s).alias("n"))), lambda s: strip(s["s"]) != "")
        cut = lambda t: F.array_join(F.slice(F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""), 1, max_words), " ")
        short = let(F.aggregate(sentences, start, step), lambda f: normalise(F.when(f["words"] > hold_words, cut(f["kept"])).otherwise(f["kept"])))
        return let(short, lambda t: F.when(is_non_lexical(t), "").otherwise(t))

    # The fold ends at the first end of a sentence that has enough words before it: no more of a text is looked at.
    enough = _leading(target_words, rf".*?(?:{TERMINAL}(?={SPACE})|$)")
    return let(text(c), lambda t: F.when(t.rlike(_leading(hold_words + 1)), trimmed(F.regexp_extract(t, enough, 0))).otherwise(t))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(f"({WORD}|{CJK})"), 1))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0 without tokens."""
    return F.coalesce(F.size(F.array_intersect(tokens(a), tokens(b))) / F.nullif(F.size(tokens(a)), F.lit(0)), F.lit(0.0))


def script_text(narration: Column, dialogue: Column, least: float = 0.8) -> Column:
    """The narration, and the dialogue where that adds words."""
    n = F.when(is_non_lexical(narration), "").otherwise(normalise(narration))
    d = F.when(strip(text(dialogue)) == "", "").otherwise(normalise(dialogue))
    same = lambda p: (p["d"] == "") | ((p["n"] != "") & (overlap_ratio(p["d"], p["n"]) >= least))
    return let(F.struct(n.alias("n"), d.alias("d")), lambda p: F.when(same(p), p["n"]).otherwise(strip(F.concat(p["n"], F.lit(" "), p["d"]))))


def panel_class(narration: Column, dialogue: Column) -> Column:
    """action, reveal, dialogue or calm: wording first, then shouting, then speech."""
    n, d = F.lower(text(narration)), F.lower(text(dialogue))
    both = F.concat(n, F.lit(" "), d)
    shouts = count(d, "!+") + count(n, "!+")
    return (
        F.when(both.rlike(ANY_CASE + ACTION_WORDS), "action")
        .when(both.rlike(ANY_CASE + REVEAL_WORDS), "reveal")
        .when(shouts >= 2, "action")
        .when(strip(d) != "", "dialogue")
        .otherwise("calm")
    )


def round_ms_up(seconds: Column) -> Column:
    """Rounded up to milliseconds; binary noise below a nanosecond is dropped first."""
    return F.ceil(F.bround(seconds * 1000.0, 6)) / F.lit(1000.0)


def progress_seconds(line: Column) -> Column:
    """Finished seconds of an encoder's status line, '... time=00:01:23.45 ...'; null without such a time."""
    part = lambda k: F.regexp_extract(line, r"time=(\d+):(\d{2}):(\d{2}(?:[.,]\d+)?)", k)
    return part(1).try_cast("bigint") * 3600.0 + part(2).try_cast("bigint") * 60 + F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")


def srt_time(seconds: Column) -> Column:
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda over, of: F.floor(ms / over) % of if of else F.floor(ms / over)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)
