"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word
backs off to its longest character n-gram that was seen, at each place: first
n-grams of LONGEST characters, then shorter ones, down to single letters. All
frequencies are counted by Spark over every labelled row; the model keeps the
most frequent WORDS words and GRAMS n-grams of each length (fewer beyond WIDTH
languages), a size that does not grow with the corpus, and is broadcast.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.llm.common import bound_batches, frees, fresh, settle

WORDS, GRAMS, LONGEST = 100_000, 20_000, 4
#: All languages are learned; beyond this many, tables have fewer keys, so that their cells stay as many.
WIDTH = 200
#: Added to every count.
SMOOTHING = 0.5
#: A word says at most this much (nats) for one language over another: no single word decides a long text.
STEP = 6.0
UNKNOWN = "und"
#: A prediction of this score or more replaces a label that disagrees with it.
SURE = 0.9

#: Bytes of lower-case text: ASCII other than letters to a space; other characters are looked at in unseen words only.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def _beyond_ascii() -> str:
    """A character class of the letters and marks beyond ASCII."""
    out, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        own = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in "LM"
        if own and start is None:
            start = c
        elif not own and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_WORD = re.compile(f"[a-z{_beyond_ascii()}]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[bytes, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    prior: np.ndarray


def letters(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and the marks on them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), lambda w: w != "")


def _scores(rows: pd.DataFrame, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Smoothed log frequencies: a row for each key, a column for each language, relative to their mean."""
    codes, keys = pd.factorize(rows["key"])
    counts = np.full((len(keys), len(languages)), SMOOTHING)
    np.add.at(counts, (codes, pd.Index(languages).get_indexer(rows["lang"])), rows["n"].to_numpy())
    logs = np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))
    logs -= logs.mean(axis=1, keepdims=True)
    return list(keys), np.clip(logs, -STEP, STEP).astype(np.float32)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, grams: int = GRAMS, longest: int = LONGEST) -> Model:
    """Counts over all rows with a non-null language; rows with no letter or null text add nothing.

    Word counts are aggregated before they are shuffled, and n-grams are
    counted from the word counts. What comes to the driver is bounded by the
    sizes of the model. With no labelled rows the model has no languages.
    """
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), letters(F.col(f"`{text_col}`")).alias("words"))
    counts = rows.select("lang", F.explode("words").alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    counts = settle(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()  # one row for each language
    languages = sorted(r["lang"] for r in totals)
    words, grams = (max(1, size * WIDTH // max(WIDTH, len(languages))) for size in (words, grams))
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))

    def most_frequent(table: DataFrame, limit: int) -> pd.DataFrame:
        top = table.groupBy("key").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "key").limit(limit)
        return table.join(top, "key").select("key", "lang", "n").toArrow().to_pandas()  # at most limit x languages rows

    known, word_scores = _scores(most_frequent(counts, words), languages)
    gram_rows = []
    # As arrays of characters: a place in a long string is only found from its start.
    padded = settle(counts.select("lang", "n", F.split(F.concat(F.lit(" "), "key", F.lit(" ")), "").alias("word")), "padded")
    # A function of its own: a lambda's second parameter, default or not, would be the index.
    grams_of = lambda size: F.transform(F.sequence(F.lit(1), F.size("word") - (size - 1)), lambda i: F.array_join(F.slice("word", i, size), ""))
    for size in range(1, longest + 1):
        gram = F.explode(grams_of(size))
        of_size = padded.where(F.size("word") >= size).select("lang", "n", gram.alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        of_size = settle(of_size, "grams")
        gram_rows.append(most_frequent(of_size, grams))
    tables = [_scores(r, languages) for r in gram_rows]
    all_grams = {k: i for i, k in enumerate(k for keys, _ in tables for k in keys)}
    share = np.array([next(r["n"] for r in totals if r["lang"] == x) for x in languages], dtype=float)
    return Model(languages, {w.encode(): i for i, w in enumerate(known)}, all_grams, word_scores, np.concatenate([t for _, t in tables]), np.log(share / share.sum()).astype(np.float32))


def longest_grams(grams: dict[str, int], word: str, longest: int = LONGEST) -> list[int]:
    """Rows of the longest n-gram seen at each place of a word."""
    text, found, get = f" {word} ", [], grams.get
    for at in range(len(text) - 1):
        for end in range(at + longest, at, -1):
            row = get(text[at:end])
            if row is not None:
                found.append(row)
                break
    return found


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, share of its posterior); (und, 0) for null, no letter or a model of no languages.

        An unseen run is cut at what is no letter; it scores the mean over its
        places, as one word or as one for every LONGEST of them: scripts without
        spaces have a sentence in a run.
        """
        model = self.model
        if not text or not model.languages or not any(map(str.isalpha, text)):  # letters are the Unicode categories L; numerals are none
            return UNKNOWN, 0.0
        counts = Counter(text.lower().encode().translate(_FOLD).split())
        get, rows, times, grams, shares, weight = model.words.get, [], [], [], [], 0.0
        for run, n in counts.items():
            row = get(run)
            if row is not None:
                rows.append(row)
                times.append(n)
                weight += n
                continue
            for word in (run.decode(),) if run.isascii() else _WORD.findall(run.decode()):
                row = get(word.encode())
                if row is not None:
                    rows.append(row)
                    times.append(n)
                    weight += n
                elif found := longest_grams(model.grams, word):
                    own = n * max(1.0, len(found) / LONGEST)
                    grams += found
                    shares += [own / len(found)] * len(found)
                    weight += own
                else:
                    weight += n
        total = np.zeros(len(model.languages))
        if rows:
            total += np.array(times, dtype=np.float32) @ model.word_scores[rows]
        if grams:
            total += np.array(shares, dtype=np.float32) @ model.gram_scores[grams]
        # Words of a text depend on each other: their evidence grows with the root of their number beyond a few.
        total = total * min(1.0, math.sqrt(25 / max(1.0, weight))) + model.prior * 0.1
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return model.languages[best], float(odds[best] / odds.sum())


def labeller(spark: SparkSession, model: Model):
    """A vectorised function text -> (lang_pred, score) that carries the model."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @frees
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame([score(t) for t in batch], columns=["lang_pred", "score"])

    return label


def held_out(id_col: Column) -> Column:
    """True for the quarter of rows that nothing is learned from; null identifiers are never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out; predicts all: id, held_out, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0. A tie goes to
    the language that is first by code point. Whole texts are read; repeated
    rows and extra columns change nothing but the counts.
    """
    out = held_out(F.col(f"`{id_col}`"))
    label = labeller(docs.sparkSession, train(docs.where(~out), text_col, lang_col))
    found = docs.select(F.col(f"`{id_col}`").alias(id_col), out.alias("held_out"), label(F.col(f"`{text_col}`")).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told: null text, no letter, or no language learned at all.

    All columns stay as they were, whatever their names; repeated rows are
    judged each, and an empty table stays empty.
    """
    label = labeller(docs.sparkSession, train(docs.where(~held_out(F.col(f"`{id_col}`"))), text_col, lang_col))
    (name,) = fresh(docs, "_lang")
    return docs.withColumn(name, label(F.col(f"`{text_col}`"))["lang_pred"]).where(F.col(name) != UNKNOWN).drop(name)


def label_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sure: float = SURE) -> DataFrame:
    """``docs`` without the rows that drop_unidentified drops, and with the language that their texts are in.

    A null label becomes the prediction; so does a label that disagrees with
    a prediction of score ``sure`` or more. Other labels and all other columns
    stay as they were, whatever their names; repeated rows are judged each,
    and an empty table stays empty.
    """
    label = labeller(docs.sparkSession, train(docs.where(~held_out(F.col(f"`{id_col}`"))), text_col, lang_col)).asNondeterministic()  # so that the filter below does not run it again
    (name,) = fresh(docs, "_found")
    judged = docs.withColumn(name, label(F.col(f"`{text_col}`"))).where(F.col(name)["lang_pred"] != UNKNOWN)
    own, found = F.col(f"`{lang_col}`"), F.col(name)["lang_pred"].cast(docs.schema[lang_col].dataType)
    return judged.withColumn(lang_col, F.when(own.isNull() | (F.col(name)["score"] >= sure), found).otherwise(own)).drop(name)
