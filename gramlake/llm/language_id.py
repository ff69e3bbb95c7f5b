"""Language identification (operator 4): rank-order n-gram profiles compared by out-of-place distance.

A language's profile is the ranking of its most frequent letter n-grams (1 to 3 letters, words padded by a space). A
document's own ranking is compared to each profile: every n-gram adds the distance between its two ranks, one that the
profile lacks adds the greatest distance. The language with the smallest sum wins; ties go to the first language by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, hash_sample, id_crc, lean, table

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Labelled rows that the profiles are fitted on, at most about this many.
FIT_ROWS = 20_000
PROFILE = 600


def ngrams(text: str | None) -> np.ndarray:
    """The keys of all n-grams of one to three characters; none for a text without letters.

    A key holds up to three 20-bit codes. An n-gram is inside one word, padded by one space on each side."""
    flat = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not flat.isascii() and not flat.replace(" ", "").isalpha():  # numerals that are no digits, such as fractions
        flat = " ".join("".join(c if c.isalpha() else " " for c in flat).split())
    if not flat:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {flat} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & 0xFFFFF
    letter = c != 32
    pairs = (c[:-1] << 20) | c[1:]
    triples = (pairs[:-1] << 20) | c[2:]
    return np.concatenate([c[letter], pairs[letter[:-1] | letter[1:]], triples[letter[1:-1]]])


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    found, counts = np.unique(keys, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:size]
    return found[order]


@dataclass
class Profiles:
    languages: list[str]
    keys: np.ndarray  # sorted
    ranks: np.ndarray  # languages x keys; `size` where the profile lacks the key
    size: int

    def distances(self, text: str | None) -> tuple[np.ndarray, int] | None:
        keys = ngrams(text)
        if not len(keys):
            return None
        mine = ranked(keys, self.size)
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == mine if len(self.keys) else np.zeros(len(mine), bool)
        place = np.arange(len(mine))
        lost = (len(mine) - int(known.sum())) * self.size
        apart = np.abs(self.ranks[:, at[known]] - place[known])
        apart[self.ranks[:, at[known]] == self.size] = self.size
        return apart.sum(axis=1) + lost, len(mine) * self.size

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, confidence from 0 to 1); ("und", 0.0) without letters. A text that shares no n-gram with any profile
        gets the first language and 0.0."""
        got = self.distances(text)
        if got is None or not self.languages:
            return UNKNOWN, 0.0
        d, most = got
        best = int(np.argmin(d))
        if d[best] >= most:
            return self.languages[best], 0.0
        near = np.exp(-(d - d[best]) / (0.03 * most))
        return self.languages[best], float(1 / near.sum())


def fit_profiles(docs: DataFrame, rows: int = FIT_ROWS, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from labelled rows: a hash sample of at most about `rows` of them (null languages or texts are left out).

    n-grams are counted in each partition, the counts summed by Spark, and only the `size` leaders of a language reach the
    driver: at most `rows` languages, as the sample has no more."""
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sample = hash_sample(labelled, "doc_id", rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    counts = sample.mapInArrow(lean(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    leaders = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), (-F.col("key")).alias("k"))), asc=False), 1, size).alias("top")).collect()
    tops = {r["lang"]: np.array([-x["k"] for x in r["top"]], np.int64) for r in sorted(leaders, key=lambda r: r["lang"])}
    keys = np.unique(np.concatenate(list(tops.values()))) if tops else np.zeros(0, np.int64)
    ranks = np.full((len(tops), len(keys)), size, np.int64)
    for k, top in enumerate(tops.values()):
        ranks[k, np.searchsorted(keys, top)] = np.arange(len(top))
    return Profiles(list(tops), keys, ranks, size)


def language(text: Column, profiles: Profiles) -> Column:
    """struct<lang, score> of each whole text."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        give_back()
        return pd.DataFrame([profiles.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per input row, also of repeated ones; null, empty and letterless texts are `und` with
    score 0; an empty table gives no rows; other columns are left out, whatever their names."""
    out = docs.select(F.col(id_col).alias("doc_id"), language(F.col(text_col), profiles).alias("p"))
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The documents with a language, columns of any name as they are: rejected are those without letters and those sharing no
    n-gram with any profile. Where no language is known at all, only those without letters are."""
    if not profiles.languages:
        return docs.where(F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    return docs.where(language(F.col(text_col), profiles)["score"] > 0)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_crc() % 3 != 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_profiles(training_rows(docs)))
    return found.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")
