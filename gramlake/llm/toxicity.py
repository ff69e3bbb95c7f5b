"""Toxicity (operator 9): a weighted finite-state pattern grammar over clauses.

Each word becomes a symbol by the lexicon: insult, threat, target, negation, report or other. Five transducers read a clause's
symbols from left to right, each the output of the one before it: negation and reported speech weaken what they reach, a
target strengthens what stands near it, a threat holds until a target follows within reach, an insult adds its weight. They
are composed once into one machine, whose arcs carry a factor for the lexicon's weight and a weight of their own. A clause's
weight is the sum along its path; a document's score comes from its clauses' weights. The lexicon holds fixed cue words of
grammar and, for insults, only words and word beginnings learned with their weights (log odds) from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, give_back, hash_sample, id_crc, lean, table, written

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
#: Labelled rows that the lexicon is fitted on, at most about this many (a parameter of labelled_rows).
FIT_ROWS = 20_000
STEMS = range(3, 9)

# Cue words of the grammar.
THREATS = "kill hurt destroy beat shoot stab burn punish töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours youre u he she they them him du dich dir ihr euch sie tu toi te vous elle ils él ella usted ustedes ti".split()
NEGATIONS = "not no never neither nor without isn aren don doesn nicht kein keine nie niemals ne pas jamais sans nunca sin jamás".split()
REPORTS = "said says say saying wrote writes claimed claims quoted called reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED_THREAT, REPORTED_THREAT, WEAK_THREAT = range(9)
READ = range(6)  # the lexicon's symbols; the others stand between transducers
NEGATION_REACH, TARGET_REACH = 3, 3
WEIGHT = {"threat": 1.5, "target": 1.25, "negated": 0.5, "reported": 0.7}


@dataclass(frozen=True)
class Arc:
    to: Hashable
    out: int
    factor: float = 1.0
    weight: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """arc(state, symbol): where a symbol leads, what it becomes, its weight's factor and a weight of the arc itself."""

    start: Hashable
    arc: Callable[[Hashable, int], Arc]

    def then(self, other: Transducer) -> Transducer:
        """Their composition: `other` reads what this one puts out; factors multiply, weights add."""

        def arc(state: Hashable, symbol: int) -> Arc:
            a = self.arc(state[0], symbol)
            b = other.arc(state[1], a.out)
            return Arc((a.to, b.to), b.out, a.factor * b.factor, a.weight + b.weight)

        return Transducer((self.start, other.start), arc)

    def table(self) -> list[list[tuple[int, float, float]]]:
        """(next, factor, weight) by state and symbol, for all states that can be reached; state 0 is the start."""
        number, todo, rows = {self.start: 0}, [self.start], []
        for state in todo:
            row = []
            for symbol in READ:
                a = self.arc(state, symbol)
                if a.to not in number:
                    number[a.to] = len(todo)
                    todo.append(a.to)
                row.append((number[a.to], a.factor, a.weight))
            rows.append(row)
        return rows


def cue(on: int, reach: int, factor: float, threats: dict[int, int]) -> Transducer:
    """From a cue word on, for `reach` words (0: to the clause's end), an insult's weight has a factor and threats become others."""

    def arc(left: int, symbol: int) -> Arc:
        now = (reach or 1) if symbol == on else left if not reach else max(0, left - 1)
        if not now:
            return Arc(now, symbol)
        return Arc(now, threats.get(symbol, symbol), factor if symbol == INSULT else 1.0)

    return Transducer(0, arc)


def threat_arc(state: tuple[float, int], symbol: int) -> Arc:
    """A threat waits TARGET_REACH words for its target, then it counts; what it becomes is no threat any more."""
    value, left = state
    strength = {THREAT: 1.0, NEGATED_THREAT: WEIGHT["negated"], REPORTED_THREAT: WEIGHT["reported"], WEAK_THREAT: WEIGHT["negated"] * WEIGHT["reported"]}
    if symbol in strength:
        return Arc((strength[symbol], TARGET_REACH), OTHER)
    if symbol == TARGET and left:
        return Arc((0.0, 0), symbol, weight=WEIGHT["threat"] * value)
    return Arc((value, left - 1) if left > 1 else (0.0, 0), symbol)


NEGATING = cue(NEGATION, NEGATION_REACH, WEIGHT["negated"], {THREAT: NEGATED_THREAT})
REPORTING = cue(REPORT, 0, WEIGHT["reported"], {THREAT: REPORTED_THREAT, NEGATED_THREAT: WEAK_THREAT})
AIMING = cue(TARGET, TARGET_REACH, WEIGHT["target"], {})
THREATENING = Transducer((0.0, 0), threat_arc)
INSULTING = Transducer(None, lambda state, symbol: Arc(state, symbol, 1.0 if symbol == INSULT else 0.0))
#: The composition of all five.
MACHINE = NEGATING.then(REPORTING).then(AIMING).then(THREATENING).then(INSULTING)


def trie(heads: list[str]) -> str:
    """A pattern for any of these heads that branches by letter; the longest is preferred. A head that ends in a space ends its word."""
    tree: dict = {}
    for h in heads:
        node = tree
        for c in h:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if " " in node and "" in node[" "]:
            node = {**{c: n for c, n in node.items() if c != " "}, "(?![^\\W\\d_])": {"": {}}}
        ways = [(c if len(c) > 1 else re.escape(c)) + pattern(n) for c, n in sorted(node.items()) if c]
        return "" if not ways else f"(?:{'|'.join(ways)})" + "?" * ("" in node)

    return pattern(tree)


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cues = {w: s for words, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
        self.table = MACHINE.table()
        heads = sorted([*(w + " " for w in {*self.insults, *THREATS}), *self.stems])
        self.anchor = re.compile(r"(?<![^\W\d_])" + trie(heads)) if heads else None

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.insults:
            return INSULT, self.insults[word]
        for n in STEMS:
            if len(word) >= n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return self.cues.get(word, OTHER), 0.0

    def clause(self, words: list[str]) -> float:
        """The machine's weight of one clause."""
        state, total = 0, 0.0
        for w in words:
            s, value = self.symbol(w)
            state, factor, weight = self.table[state][s]
            total += value * factor + weight
        return total

    def matches(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each clause with a weight."""
        text = text or ""
        low = text.lower()
        if self.anchor is None or (hit := self.anchor.search(low)) is None:
            return []
        # Where lower-casing makes a character longer, offsets are counted back to the original.
        origin = None if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        out, at = [], 0
        while hit is not None:  # only clauses that hold an anchor can have a weight
            a = max((low.rfind(c, at, hit.start()) for c in ".!?;:\n"), default=-1) + 1 or at
            end = CLAUSE.match(low, a)
            b = max(end.end() if end else a, hit.end())
            if value := self.clause(WORD.findall(low, a, b)):
                out.append((a, b, value) if origin is None or len(origin) <= b else (origin[a], origin[b], value))
            at = b
            hit = self.anchor.search(low, b)
        return out

    def score(self, text: str | None) -> float:
        """0 without matched clauses; rises to 1 with the weight of the strongest clause and, less, of the others."""
        found = sorted((v for _, _, v in self.matches(text)), reverse=True)
        if not found:
            return 0.0
        total = found[0] + 0.25 * sum(found[1:])
        return 1.0 - math.exp(-0.35 * total)


def copy_key(text: str | None) -> int:
    """The least hash of a text's three-word runs: near copies mostly share it, so they count as one text in the fit."""
    w = (text or "").lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0) >> 1


def fit_grammar(labelled: DataFrame, certainty: float = 14.0, purity: float = 0.9) -> Grammar:
    """Insults learned from (doc_id, text, toxic) rows, a bounded sample (see labelled_rows).

    A word or word beginning enters with its smoothed log odds when the log likelihood ratio of its counts against the base
    rate reaches `certainty` and a share of `purity` of the texts that hold it are toxic. Copies count once. Partitions
    pre-aggregate; what reaches the driver is bounded with the sample, as each entry stands in several of its toxic texts.
    Without toxic or without other rows, or on an empty table, the lexicon has no insults."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([copy_key(t) for t in texts], pa.int64())], ["text", "toxic", "key"])

    one = labelled.where("toxic is not null and text is not null").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(keyed), "text string, toxic int, key long")
    sample = written(one.groupBy("key", "toxic").agg(F.min("text").alias("text")), "labelled")
    totals = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n, m = totals.get(1, 0), totals.get(0, 0)
    if not n or not m:
        return Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in set(WORD.findall(text.lower())):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["f", "toxic", "other"])

    base = n / (n + m)

    def leaders(counts: DataFrame) -> DataFrame:
        """From (f, t, o): those whose counts are far from the base rate beyond chance."""
        t, o = F.col("t"), F.col("o")
        rate = t / (t + o)
        sure = t * F.log(rate / base) + F.when(o > 0, o * F.log((1 - rate) / (1 - base))).otherwise(0.0)
        weight = F.log((t + 0.1) / (n + 0.2)) - F.log((o + 0.1) / (m + 0.2))
        found = counts.where(t > 0).select("f", "t", weight.alias("w"), sure.alias("sure"), rate.alias("rate"))
        return found.where((F.col("rate") >= purity) & (F.col("sure") >= certainty))

    words = written(sample.select("text", "toxic").mapInArrow(lean(count), "f string, toxic long, other long").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")), "words")
    # A beginning has to stand without its commonest word: else that word alone says it.
    begun = words.select(F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.col("f").substr(F.lit(1), n)))).alias("b"), "f", "t", "o").where(F.length("b") >= min(STEMS)).groupBy("b").agg((F.sum("t") - F.max("t")).alias("t"), F.sum("o").alias("o"))
    stems: dict[str, float] = {}
    for r in sorted(leaders(begun.withColumnRenamed("b", "f")).collect(), key=lambda r: (len(r["f"]), r["f"])):
        if not any(r["f"][:k] in stems for k in STEMS if k < len(r["f"])):  # a shorter beginning says it already
            stems[r["f"]] = r["w"]
    found = {r["f"]: r["w"] for r in leaders(words).collect()}
    return Grammar({w: v for w, v in found.items() if not any(w[:k] in stems for k in STEMS if k <= len(w))}, stems)


def toxicity(text: Column, grammar: Grammar) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series([grammar.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted: one row per input row, also of repeated ones; null and empty texts score 0;
    other columns are left out, whatever their names."""
    return docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col), grammar).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, all columns as they are."""
    return docs.where(toxicity(F.col(text_col), grammar) < threshold)


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the training fold: crc32 of the id mod 4 is not 2, and a hash of it chooses about `rows` ids at
    most. A label that contradicts itself counts as toxic; rows that share an id are all taken."""
    marks = labels.where("doc_id is not null and toxic is not null").where(id_crc() % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(marks, "doc_id", rows)  # before the join: only these texts are shuffled
    return docs.select("doc_id", "text").join(bounded_broadcast(chosen, chosen.count(), 4 * rows), "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit_grammar(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, grammar).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", "predicted")
