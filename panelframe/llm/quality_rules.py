"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import text_column, written

# The characters that count as symbols, those that end a sentence, and what a list item starts with.
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]")
_UPPER = re.compile(r"[A-Z]")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile(r"[.!?](?=\s|$)")
_PLAIN = re.compile(rb"(?<![^\x20\x09-\x0D])[^A-Za-z\x80-\xff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
# On good documents a rule that votes is right so often; on bad ones at most so often, and it says bad there
# no less often than on good ones, so that no vote speaks against its own meaning.
LEAST_ACCURACY, MOST_ACCURACY = 0.55, 0.999
# Where the estimates start, and the votes that stand behind that.
PRIOR, START_GOOD, START_BAD, BEHIND_GOOD, BEHIND_BAD, ROUNDS = 0.85, 0.95, 0.3, 20, 2, 100

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_letters", "n_distinct", "n_sentences", "n_lines", "n_plain"]


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text, the first one too."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n + 2).view(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    doubtful = np.zeros(n, bool)
    doubtful[order[1:][same]] = doubtful[order[:-1][same]] = True
    # Equal keys are looked at word by word.
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(doubtful).tolist():
        seen.setdefault((words[i], words[i + 1], words[i + 2]), []).append(i)
    covered = np.zeros(n + 2, bool)
    for at in seen.values():
        if len(at) > 1:
            for k in range(3):
                covered[np.array(at) + k] = True
    return int(covered.sum())


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly space and 0x09-0x0D
    lines = [x for x in raw.split(b"\n") if x.split()]
    space = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\v", b"\f")))
    return (len(words), len(text) - space, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(text), len(_UPPER.findall(text)) if not text.islower() else 0, len(raw) - len(_NO_LETTER.findall(raw)), len(set(words)), len(_SENTENCE.findall(text)), len(lines), len(_PLAIN.findall(raw)))


def votes(s: pd.DataFrame) -> np.ndarray:
    """A column for each rule: 1 good, -1 bad, 0 abstains."""
    w, c = s.n_words.clip(lower=1), s.n_chars.clip(lower=1)
    vote = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    mean, symbols, plain, dup, repeat = s.word_chars / w, s.n_symbols / w, s.n_plain / w, s.n_dup_lines / s.n_lines.clip(lower=1), s.n_repeat_words / w
    upper, letters, sentences = s.n_upper / s.n_letters.clip(lower=1), s.n_letters / c, s.n_sentences / w
    # Distinct words by the root of all: unlike their share, it does not fall as a text goes on.
    rich = s.n_distinct / np.sqrt(w)
    return np.stack(
        [
            vote(s.n_words < 20, s.n_words >= 100),
            vote((mean < 3) | (mean > 10), (mean >= 4) & (mean <= 7)),
            vote(symbols > 0.1, symbols < 0.01),
            vote(plain > 0.2, plain < 0.05),
            vote(dup > 0.4, (dup < 0.05) & (s.n_lines >= 3)),
            vote(repeat > 0.2, repeat < 0.05),
            vote(upper > 0.3, upper < 0.1),
            vote(letters < 0.7, letters > 0.75),
            vote((rich < 4) & (s.n_words >= 50), rich > 6),
            vote(((sentences < 0.01) & (s.n_words >= 50)) | (sentences > 0.4), (sentences > 0.02) & (sentences < 0.25)),
        ],
        axis=1,
    )


RULES = 10


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over vote patterns with counts: each rule's accuracy on good and on bad
    documents when it votes, and the share of good ones. Rules are taken as independent given quality.

    A rule that looks for one defect votes good on most bad documents, which have another one: its accuracy
    on bad documents may be small, so that its good votes count for little and its rare bad ones for much.
    """
    good, bad = patterns == 1, patterns == -1
    share, right_good, right_bad = PRIOR, np.full(patterns.shape[1], START_GOOD), np.full(patterns.shape[1], START_BAD)
    for _ in range(rounds):
        p = posterior(patterns, {"share": share, "good": right_good, "bad": right_bad})
        w1, w0 = counts * p, counts * (1 - p)
        share = float(np.clip(w1.sum() / max(counts.sum(), 1), 0.05, 0.99))
        # The start's votes keep the estimate defined for rules that never vote.
        right_good = np.clip((w1 @ good + START_GOOD * BEHIND_GOOD) / (w1 @ (good | bad) + BEHIND_GOOD), LEAST_ACCURACY, MOST_ACCURACY)
        right_bad = np.clip((w0 @ bad + START_BAD * BEHIND_BAD) / (w0 @ (good | bad) + BEHIND_BAD), 1 - right_good, MOST_ACCURACY)
    return {"share": share, "good": right_good, "bad": right_bad}


def posterior(patterns: np.ndarray, model: dict) -> np.ndarray:
    """The probability that a document with this pattern of votes is good."""
    good, bad = patterns == 1, patterns == -1
    x = math.log(model["share"] / (1 - model["share"]))
    x = x + good @ np.log(model["good"] / (1 - model["bad"])) + bad @ np.log((1 - model["good"]) / model["bad"])
    return 1 / (1 + np.exp(-x))


_MEASURED = T.StructType([*(T.StructField(n, T.LongType()) for n in STATS), T.StructField("votes", T.StringType())])


def _measures(text_col: str):
    def measured(texts: list) -> list[dict]:
        s = pd.DataFrame([measure(t or "") for t in texts], columns=STATS)
        marks = ["".join("-0+"[v + 1] for v in row) for row in votes(s).tolist()]
        return [r | {"votes": v} for r, v in zip(s.to_dict("records"), marks)]

    return text_column(F.col(f"`{text_col}`").cast("string"), _MEASURED, measured)


def judge(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with two more columns: _rules, a struct of its measures, votes, base_failed, good_probability, kept.

    Every document is measured once, over its whole text, into a table in the shared folder (lost
    executors cost no more than unwritten rows).  The counts of all vote patterns, at most 3^RULES rows
    whatever the input, go to the driver for expectation-maximisation, and their probabilities come
    back as a table of that size.

    A null or empty text has no words, so it fails the base rule; a very long one is measured whole, like any
    other; equal texts have equal verdicts.  Nulls elsewhere, repeated rows and other columns stay as they are,
    but for a column named _rules, which is replaced; an empty table gives no rows.
    """
    measured = written(docs.drop("_rules").withColumn("_rules", _measures(text_col)), "quality-rules")
    return _verdicts(measured, least)


def judge_narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """As judge(), for (id, _rules) alone: the texts are not written again."""
    return _verdicts(written(docs.select(F.col(f"`{id_col}`"), _measures(text_col).alias("_rules")), "quality-rules"), least)


def _verdicts(measured: DataFrame, least: float) -> DataFrame:
    spark = measured.sparkSession
    counted = measured.groupBy(F.col("_rules.votes").alias("v")).count().collect()  # at most 3^RULES rows
    counted.sort(key=lambda r: r["v"])
    patterns = np.array([["-0+".index(c) - 1 for c in r["v"]] for r in counted], dtype=int).reshape(-1, RULES)
    p = posterior(patterns, fit(patterns, np.array([r["count"] for r in counted], dtype=float)))
    table = spark.createDataFrame([(r["v"], float(x)) for r, x in zip(counted, p)], "_votes string, _p double")
    failed = (F.col("_rules.n_words") < 50) | (100 * F.col("_rules.n_repeat_words") > 50 * F.col("_rules.n_words"))
    row = F.struct(*[F.col(f"`{c}`") for c in measured.columns if c != "_rules"]).alias("_row")  # so that no name clashes
    joined = measured.select(row, "_rules").join(F.broadcast(table), F.col("_rules.votes") == F.col("_votes"), "left")  # at most 3^RULES rows
    rules = F.col("_rules").withField("base_failed", failed).withField("good_probability", F.col("_p")).withField("kept", ~failed & (F.col("_p") >= least))
    return joined.select("_row.*", rules.alias("_rules"))
