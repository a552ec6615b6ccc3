"""Operator 2, quality rules with risk-controlled thresholds.

Every rule is a signal and a fixed ladder of cutoffs from lax to strict; a
document beyond the cutoff is rejected. Which cutoff holds is decided per stratum
(language) on labelled rows of good quality: a cutoff is certified when the exact
binomial tail says that it rejects at most ``risk / rules`` of the good documents,
at confidence 1 - delta over all tests together. Delta is divided by strata and
rules (Bonferroni); within a rule the ladder is walked from its lax end and stops
at the first cutoff that fails (fixed-sequence testing), which costs no further
correction. Of the certified cutoffs, the one with the largest gain is used
(rejected bad documents less ``good_weight`` times rejected good ones), or none.

The counts come from one aggregate over all labelled rows, so they are exact at
any size; the table of cutoffs has one row per stratum.

Cases: null text has no word and fails the base; a null language shares the
stratum of the empty one; strata with too few labels get no cutoff; documents
labelled more than once are good only if every label says so; rows repeat as they
come; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, table, with_small, written

# Characters counted as symbols, and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: So many words are looked at together; a longer text is taken alone.
CHUNK_WORDS = 400_000

# Rule -> ladder of cutoffs from lax to strict; a document beyond one is rejected.
LADDERS = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_ratio": [0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
    "mean_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}


@dataclass(frozen=True)
class QualityConfig:
    risk: float = 0.05
    delta: float = 0.05
    good_weight: float = 3.0


class Numbers(dict):
    """Numbers for new words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def repeated_words(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document, its words in windows that it has twice or more.

    ``words`` are the word numbers of several documents on end, ``ends`` where each document ends.
    """
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.zeros(len(ends), dtype=np.int64)
    if len(words) < WINDOW:
        return counts
    document = np.repeat(np.arange(len(ends)), ends - starts)
    code = words
    for width in range(1, WINDOW):
        joined = code[:-1] * (int(words.max()) + 1) + words[width:]
        code = np.unique(joined, return_inverse=True)[1]
    inside = np.flatnonzero(document[: len(code)] == document[WINDOW - 1 :])
    if not len(inside):
        return counts
    window = code[inside] * len(ends) + document[inside]
    _, where, often = np.unique(window, return_inverse=True, return_counts=True)
    hit = inside[often[where] > 1]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(document[covered], minlength=len(ends)).astype(np.int64)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def counts_of(texts: pd.Series) -> pd.DataFrame:
    """The columns of COUNTS for whole texts."""
    rows, repeats, waiting, ends, numbers = [], [], [], [], Numbers()

    def flush() -> None:
        nonlocal numbers
        if ends:
            repeats.append(repeated_words(np.concatenate(waiting), np.array(ends)))
        waiting.clear()
        ends.clear()
        numbers = Numbers()

    for text in texts:
        text = text if isinstance(text, str) else ""
        raw = text.encode()
        words = raw.split()
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        rows.append(
            (
                len(words),
                len(text) - sum(map(text.count, BLANKS)),
                sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)),
                0,
                len(lines),
                len(raw) - len(raw.translate(None, UPPER)),
            )
        )
        if ends and ends[-1] + len(words) > CHUNK_WORDS:
            flush()
        waiting.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        ends.append((ends[-1] if ends else 0) + len(words))
    flush()
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])
    if len(frame):
        frame["n_repeat_words"] = np.concatenate(repeats)
    return frame


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", identifier: str = "doc_id") -> DataFrame:
    """One written row per document: identifier, stratum, counts, base verdict and signals."""

    @F.pandas_udf(COUNTS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield counts_of(batch)

    bounded_batches(docs.sparkSession)
    stratum = F.coalesce(F.col(lang), F.lit("")).alias("stratum")
    found = docs.select(F.col(identifier).alias("doc_id"), stratum, counted(text).alias("found"))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return written(
        found.select("doc_id", "stratum", "found.*").select(
            "*",
            failed.alias("base_failed"),
            (F.col("n_symbols") / chars).alias("symbol_ratio"),
            (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
            (F.col("n_repeat_words") / words).alias("repeat_ratio"),
            (F.col("n_upper") / chars).alias("upper_ratio"),
            (F.col("word_chars") / words).alias("mean_word"),
        ),
        "measured",
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at probability p, exactly as the sum of its terms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=float)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(p / (1 - p))
    terms = n * math.log1p(-p) + np.concatenate(([0.0], np.cumsum(steps)))
    return float(min(1.0, np.exp(terms).sum()))


def ladder_steps(rule: str) -> Column:
    """How many cutoffs of the rule's ladder a document is beyond."""
    return sum((F.col(rule) > c).cast("int") for c in LADDERS[rule])


def certified_cutoffs(counts: pd.DataFrame, tests: int, config: QualityConfig) -> dict[str, float | None]:
    """Rule -> cutoff of one stratum; ``counts`` has (rule, steps, good, bad).

    A document beyond a cutoff is beyond all stricter ones, so ``steps`` counts from the strict end.
    """
    chosen: dict[str, float | None] = {}
    allowed, level = config.risk / len(LADDERS), config.delta / tests
    for rule, ladder in LADDERS.items():
        own = counts[counts["rule"] == rule]
        good, bad = (np.bincount(own["steps"], own[c], len(ladder) + 1) for c in ("good", "bad"))
        n, best, gain = int(good.sum()), None, 0.0
        for place, cutoff in enumerate(ladder):
            wrong, right = int(good[len(ladder) - place :].sum()), int(bad[len(ladder) - place :].sum())
            if wrong > allowed * n or binomial_tail(wrong, n, allowed) > level:
                break
            if right - config.good_weight * wrong > gain:
                best, gain = cutoff, right - config.good_weight * wrong
        chosen[rule] = best
    return chosen


def cutoffs(rows: DataFrame, labels: DataFrame, config: QualityConfig) -> DataFrame:
    """One row per stratum with labels: its cutoff of every rule, or null."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    signals = [F.struct(F.lit(r).alias("rule"), ladder_steps(r).alias("steps")) for r in LADDERS]
    tested = rows.where(~F.col("base_failed")).join(known, "doc_id").select("stratum", "quality", F.inline(F.array(*signals)))
    counts = written(
        tested.groupBy("stratum", "rule", "steps").agg(
            F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
        ),
        "label_counts",
    )
    tests = max(1, counts.select("stratum").distinct().count()) * len(LADDERS)

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"stratum": own["stratum"].iloc[0], **certified_cutoffs(own, tests, config)}])

    schema = "stratum string, " + ", ".join(f"{rule} double" for rule in LADDERS)
    chosen = counts.groupBy("stratum").applyInPandas(choose, schema)
    return written(chosen.withColumnsRenamed({rule: f"{rule}_cutoff" for rule in LADDERS}), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per document: counts, base verdict and the verdict of the certified rules."""
    rows = measured(docs)
    chosen = cutoffs(rows, labels, config)
    beyond = [F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in LADDERS]
    broken = F.array_compact(F.array(*[F.when(b, F.lit(rule)) for b, rule in zip(beyond, LADDERS)]))
    return with_small(rows, chosen, ["stratum"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"),
        F.array_join(broken, ",").alias("broken_rules"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return judged(docs, table(spark, folder, "labels").select("doc_id", "quality"))
