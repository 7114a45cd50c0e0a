"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of symbols (insult, threat, target, negation, reported speech, other).
Five small transducers describe what matters about it: an insult emits its weight; a target close by
raises it; a negation shortly before lowers it; reported speech lowers it to the end of the clause; a
threat counts once it reaches a target. They are composed into one deterministic machine, which scores
whole clauses: the same word weighs differently in "you idiot", "not an idiot" and "she said: idiot".

Insult entries (word prefixes, so inflections share one) and their weights are log ratios of rates in
toxic and other texts, learned from at most ``sample`` labelled training rows (a documented bound; the
rows are those with the smallest hash of doc_id). No insult is built in: without toxic training rows there is none,
and the closed word classes of the grammar are all it knows. A logistic model on the clause sums and their density turns them
into a score. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null, empty and blank texts have no clause and get the score of a text without any
match; texts of any length are read clause by clause; several labels of one doc_id count as toxic if
any is; null labels and null doc_ids teach nothing; equal training texts count once; an empty labels
table leaves the grammar alone; an empty documents table gives an empty result; only doc_id and
text are read, so other columns never collide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.session import cut

SAMPLE = 20_000
SHORTEST, LONGEST = 4, 8
MOST_ENTRIES = 200
RATIO = 8.0
THRESHOLD = 0.3

# Closed word classes of the grammar.
TARGETS = frozenset("you your yours yourself he him she her they them their people everyone everybody tu toi vous du dich ihr euch usted ustedes".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says say called calls claimed claims wrote reported quoted alleged sagte schrieb nannte dit disait dijo llamó".split())
THREATS = frozenset("kill hurt destroy burn shoot stab beat strangle hang punish crush murder".split())
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;\n]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Machine:
    """A transducer: ``step(state, symbol)`` gives the next state and the factor or amount it emits."""

    name: str
    step: Callable[[int, int], tuple[int, float]]
    neutral: float


def _insult(state: int, symbol: int) -> tuple[int, float]:
    return 0, 1.0 if symbol == INSULT else 0.0


def _target_before(state: int, symbol: int) -> tuple[int, float]:
    return (4 if symbol == TARGET else max(0, state - 1)), (1.3 if state and symbol == INSULT else 1.0)


def _target_after(state: int, symbol: int) -> tuple[int, float]:
    if symbol == INSULT:
        return 3, 0.0
    return (0, 0.3) if symbol == TARGET and state else (max(0, state - 1), 0.0)


def _negation(state: int, symbol: int) -> tuple[int, float]:
    return (3 if symbol == NEGATION else max(0, state - 1)), (0.4 if state and symbol == INSULT else 1.0)


def _report(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == REPORT else state), (0.5 if state and symbol in (INSULT, TARGET, THREAT) else 1.0)


def _threat(state: int, symbol: int) -> tuple[int, float]:
    if symbol == THREAT:
        return 3, 0.0
    return (0, 1.0) if symbol == TARGET and state else (max(0, state - 1), 0.0)


MACHINES = (
    Machine("insult", _insult, 0.0),
    Machine("target before", _target_before, 1.0),
    Machine("target after", _target_after, 0.0),
    Machine("negation", _negation, 1.0),
    Machine("reported speech", _report, 1.0),
    Machine("threat", _threat, 0.0),
)


@lru_cache(maxsize=1)
def composed() -> tuple[tuple[tuple[int, float, float, float], ...], ...]:
    """The product machine: per state and symbol (next state, insult factor, late factor for the last insult, threat)."""
    start = (0,) * len(MACHINES)
    number, order, table = {start: 0}, [start], []
    for state in order:
        row = []
        for symbol in range(6):
            moves = [m.step(s, symbol) for m, s in zip(MACHINES, state)]
            after = tuple(s for s, _ in moves)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            insult, before, late, negated, reported, threat = (w for _, w in moves)
            row.append((number[after], insult * before * negated * reported, late * reported, threat * reported))
        table.append(tuple(row))
    return tuple(table)


@dataclass
class Model:
    """Insult prefixes with weights, the weight of a threat, and the logistic coefficients."""

    entries: dict[str, float] = field(default_factory=dict)
    threat: float = 1.0
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.8, 0.4, 0.0)

    def __post_init__(self) -> None:
        self._find: re.Pattern | None = None

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "threat": self.threat, "coefficients": self.coefficients, "_find": None}

    def _pattern(self) -> re.Pattern:
        if self._find is None:
            words = sorted(self.entries, key=len, reverse=True)
            insults = "|".join(map(re.escape, words)) or "(?!)"
            self._find = re.compile(rf"(?<![^\W\d_])(?:({insults})|(?:{'|'.join(sorted(THREATS))})(?![^\W\d_]))")
        return self._find

    def clause(self, words: list[str]) -> float:
        """The composed machine's score of one clause."""
        table, state, total, last, find = composed(), 0, 0.0, 0.0, self._pattern()
        for word in words:
            weight, symbol = 0.0, OTHER
            if word in TARGETS:
                symbol = TARGET
            elif word in NEGATIONS or word.endswith("n't"):
                symbol = NEGATION
            elif word in REPORTS:
                symbol = REPORT
            elif word in THREATS:
                symbol = THREAT
            elif (m := find.match(word)) and m[1]:
                weight, symbol = self.entries[m[1]], INSULT
            state, factor, late, threat = table[state][symbol]
            total += weight * factor + last * late + self.threat * threat
            if symbol == INSULT:
                last = weight * factor
        return total

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Any match, log of the clause sum, log of its density, log of the length."""
        low = text.lower()
        n = low.count(" ") + low.count("\n") + 1
        total = 0.0
        if self._pattern().search(low):
            for clause in CLAUSE_END.split(low):
                if self._pattern().search(clause):
                    total += self.clause(WORD.findall(clause))
        return float(total > 0), math.log1p(total), math.log1p(1000 * total / n), math.log1p(n)

    def score(self, text: str) -> float:
        z = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _text(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


def _prefixes(word: str) -> Iterator[str]:
    return (word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """(t, toxic) of at most ``sample`` labelled rows that satisfy ``train``, equal texts once."""
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # 16 bytes a row: bounded by `sample`
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(chosen), "doc_id")
    return cut(texts.groupBy(F.xxhash64("t").alias("h"), F.length("t").alias("n")).agg(F.max(F.struct("toxic", "t")).alias("x")).select("x.t", "x.toxic"))


def mine_entries(rows: DataFrame) -> dict[str, float]:
    """Prefixes whose rate in toxic texts is far above that in others, with the log ratio as weight."""
    n_toxic = rows.where("toxic = 1").count()
    least = max(8, math.ceil(0.02 * n_toxic))

    def in_toxic(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in it:
            for value in batch.column(0):
                seen.update({p for w in set(WORD.findall(_text(value.as_py()).lower())) for p in _prefixes(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])

    found = rows.where("toxic = 1").select("t").mapInArrow(in_toxic, "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    candidates = frozenset(r.p for r in found.collect())  # of at most `sample` texts, in 2 % of the toxic ones
    if not candidates:
        return {}

    def rates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, texts, words = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
        for batch in it:
            for value, toxic in zip(batch.column(0), batch.column(1)):
                k, all_words = int(toxic.as_py() == 1), WORD.findall(_text(value.as_py()).lower())
                words[k] += len(all_words)
                own = Counter(p for w in all_words for p in _prefixes(w) if p in candidates)
                uses[k].update(own)
                texts[k].update(own.keys())
        out = [("", k, words[k], 0) for k in (0, 1)] + [(p, k, n, texts[k][p]) for k in (0, 1) for p, n in uses[k].items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["p", "k", "n", "d"])

    counted = rows.mapInArrow(rates, "p string, k bigint, n bigint, d bigint").groupBy("p", "k").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()
    uses = {(r.p, r.k): r.n for r in counted}
    spread = {(r.p, r.k): r.d for r in counted}
    words = [max(1, uses.pop(("", k), 0)) for k in (0, 1)]
    rated = []
    for p in candidates:
        a, b = uses.get((p, 1), 0), uses.get((p, 0), 0)
        ratio = ((a + 0.5) / words[1]) / ((b + 0.5) / words[0])
        if ratio >= RATIO and spread.get((p, 1), 0) >= least:
            expected = (a + b) * words[1] / (words[0] + words[1])
            rated.append((a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0), len(p), p, math.log(ratio)))
    chosen: dict[str, float] = {}
    for _, _, p, weight in sorted(rated, reverse=True):
        if len(chosen) < MOST_ENTRIES and not any(p.startswith(c) or c.startswith(p) for c in chosen):
            chosen[p] = min(6.0, weight)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn entries and coefficients; what reaches the driver is bounded by ``sample``."""
    rows = training_rows(docs, labels, F.lit(True) if train is None else train, sample)
    model = Model(mine_entries(rows))

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [model.features(_text(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in range(4)), batch.column(1).cast(pa.int64())], names=["a", "b", "c", "d", "y"])

    seen = rows.mapInArrow(features, "a double, b double, c double, d double, y bigint").collect()
    y = np.array([r.y for r in seen], dtype=float)
    if len(seen) and 0 < y.sum() < len(y):
        model.coefficients = _logistic(np.array(sorted([r.a, r.b, r.c, r.d, r.y] for r in seen))[:, :4], np.array(sorted([r.a, r.b, r.c, r.d, r.y] for r in seen))[:, 4])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted; one row per input row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = [model.score(_text(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("t")).mapInArrow(batches, "doc_id bigint, score double, predicted int")
