"""Operator 1, language identification by compression.

For every language a raw-content dictionary for zstandard is cut from a bounded
sample of labelled rows. A text, reduced to its lower-cased letters, is cut into
pieces; every piece is compressed with every dictionary, and the language with
the smallest sum wins. Pieces keep the dictionary at work over a whole long text.
The score comes from the bytes by which the next language is behind; where that
margin is narrow, the prediction is rejected (a best guess is still given).

Only text and non-null language labels are learned from; a prediction sees only
the text.

Cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; without any labelled row every text is; ties go to the first language
in order; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, give_back, held_out, table

UNKNOWN = "und"
#: Anything between letters, also digits and low lines.
BETWEEN = re.compile(r"[\W\d_]+")
#: Behind a short piece; else the library stores it as it is, at the same size for every dictionary.
FILLER = b"\0" * 256


@dataclass(frozen=True)
class LanguageConfig:
    """At most ``sample_rows`` texts per language, of ``sample_chars`` characters at most, are fitted on.

    ``bytes_per_nat``: how many bytes of difference count as one nat in the score.
    A prediction is rejected when the next language needs less than ``margin`` more bytes.
    """

    sample_rows: int = 600
    sample_chars: int = 2_000
    dictionary_bytes: int = 80_000
    piece_chars: int = 6_000
    short_bytes: int = 500
    level: int = 6
    bytes_per_nat: float = 2.0
    margin: float = 0.005
    seed: int = 11


def letters(text: str) -> str:
    return BETWEEN.sub(" ", text.lower()).strip()


def labelled_sample(training: DataFrame, config: LanguageConfig) -> dict[str, list[str]]:
    """The ``sample_rows`` texts of every language whose hashes are least, each a piece from a place that the hash names.

    Rows with one text count once, so repeated texts, and ids of any kind, change nothing. The first pass looks at
    hashes only; it gives the largest one of every language that is still drawn.
    """
    mark = F.xxhash64(F.lit(config.seed), "text").alias("mark")
    marked = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", mark)
    order = Window.partitionBy("lang").orderBy("mark")
    least = marked.select("lang", "mark").distinct().withColumn("place", F.row_number().over(order))
    drawn_marks = least.where(F.col("place") <= config.sample_rows)
    cuts = {r.lang: r.cut for r in drawn_marks.groupBy("lang").agg(F.max("mark").alias("cut")).collect()}
    if not cuts:
        return {}
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col("lang")]
    place = F.pmod("mark", F.greatest(F.lit(1), F.char_length("text") - config.sample_chars + 1)).cast("int") + 1
    drawn = marked.where(F.col("mark") <= cut).select("lang", "mark", F.substring("text", place, F.lit(config.sample_chars)).alias("text"))
    texts: dict[str, list[str]] = {lang: [] for lang in cuts}
    for row in drawn.distinct().collect():
        texts[row.lang].append(letters(row.text))
    return texts


def dictionaries(texts: dict[str, list[str]], config: LanguageConfig) -> dict[str, bytes]:
    """Raw content per language: as much of every sampled text as gives all the same room."""
    contents = {}
    for lang, samples in sorted(texts.items()):
        samples = sorted(x.encode() for x in samples if x)
        room = config.dictionary_bytes // max(1, len(samples))
        spare = sum(max(0, room - len(x)) for x in samples)
        longer = sum(len(x) > room for x in samples)
        room += spare // max(1, longer)
        contents[lang] = b" ".join(x[:room] for x in samples)[: config.dictionary_bytes]
    return {lang: x for lang, x in contents.items() if len(x) >= 8}


class Coders:
    """One compressor per language."""

    def __init__(self, contents: dict[str, bytes], config: LanguageConfig) -> None:
        self.config = config
        self.langs = list(contents)
        self.coders = []
        for content in contents.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=config.level)
            self.coders.append(
                zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False)
            )

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)"""
        plain = letters(text) if isinstance(text, str) else ""
        if not plain or not self.coders:
            return UNKNOWN, 0.0, 0.0, True
        step = self.config.piece_chars
        pieces = [plain[i : i + step].encode() for i in range(0, len(plain), step)]
        if len(pieces[-1]) < self.config.short_bytes:
            pieces[-1] += FILLER
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        least = min(sizes)
        behind = sorted(s - least for s in sizes)[1:]
        score = 1.0 / (1.0 + sum(math.exp(-b / self.config.bytes_per_nat) for b in behind))
        margin = behind[0] / (least + behind[0]) if behind else 1.0
        return self.langs[sizes.index(least)], score, margin, margin < self.config.margin


def with_language(docs: DataFrame, training: DataFrame, name: str, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """The documents with a struct column (lang_pred, score, margin, rejected) of that name, predicted from ``text``."""
    bounded_batches(docs.sparkSession)
    contents = docs.sparkSession.sparkContext.broadcast(dictionaries(labelled_sample(training, config), config))

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = Coders(contents.value, config)
        for batch in texts:
            yield pd.DataFrame([coders.predict(x) for x in batch], columns=["lang_pred", "score", "margin", "rejected"])
        del coders
        give_back()

    return docs.withColumn(name, predicted("text"))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 4, 2)
    found = with_language(docs, docs.where(~apart), "found")
    return found.select("doc_id", apart.alias("held_out"), "found.*")
