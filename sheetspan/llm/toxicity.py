"""Toxicity of texts by a weighted finite-state pattern grammar over their clauses.

Five transducers each read the words of a clause and change what they pass on: *negation* and
*reported speech* mark the words in their scope, *target* remembers whether a person is meant, *insult* and
*threat* put weights on the words that the marks leave.  They are composed into one machine before
any text is read, so a clause is scored in one walk; a walk from its end tells that one at each word whether a person or
a report is still to come.  Its output is a vector: how much insult and
threat it holds in each setting (plain, negated, reported, aimed at a person).  What each of these is worth is learned
from labelled texts, and so is which words insult and how much.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from ..workspace import stage
from .batches import with_columns
from .sampling import bounded_sample

_WORDS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Words of the closed classes, in the languages of the corpus.
CLOSED = {
    "threat": "kill hurt destroy beat burn shoot stab töten schlagen tuer frapper matar golpear",
    "target": "you your yourself he she they him her them people du dich dir ihr sie tu te toi vous tú usted ustedes",
    "negation": "not never no nobody nicht nie kein keine ne pas jamais nunca jamás ningún",
    "report": "said says wrote writes claimed quoted told sagte schrieb dit écrit dijo escribió",
}
#: Input symbols: a word's class.  An insult is any other word with a learned weight.
SYMBOLS = ("other", "insult", *CLOSED)
#: What a symbol that stands later in the clause means for a word before it, as marks; a word's column in the tables is its symbol's, plus
#: ``len(SYMBOLS)`` times the sum of the places (1, 2) of those that are to come.
LATER = {"target": (1, "aimed"), "report": (2, "reported")}
#: How many words after a negation it reaches.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """A deterministic finite-state transducer over (symbol, marks): ``step(state, symbol, marks)``
    gives the next state and the marks that it passes on."""

    start: int
    step: callable

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one passes on, the other one reads."""

        def step(state, symbol, marks):
            one, marks = self.step(state[0], symbol, marks)
            two, marks = other.step(state[1], symbol, marks)
            return (one, two), marks

        return Transducer((self.start, other.start), step)


def _negation(state, symbol, marks):
    reach = REACH if symbol == "negation" else max(0, state - 1)
    return reach, marks | {"negated"} if state and symbol != "negation" else marks


def _report(state, symbol, marks):
    return int(state or symbol == "report"), marks | {"reported"} if state else marks


def _target(state, symbol, marks):
    state = int(state or symbol == "target")
    return state, marks | {"aimed"} if state else marks


def _insult(state, symbol, marks):
    """An insult counts where it stands, in the setting that the marks tell."""
    return state, marks | {"insult"} if symbol == "insult" else marks


def _threat(state, symbol, marks):
    """A threat needs a person, named before or after it in the same clause.  Read without the walk from the end, it counts at the
    person that follows."""
    if symbol == "threat":
        return (state, marks | {"threat"}) if "aimed" in marks else (1, marks)
    if symbol == "target" and state:
        return 0, marks | {"threat"}
    return state, marks


MACHINES = [Transducer(0, f) for f in (_negation, _report, _target, _insult, _threat)]
#: The settings that an output is told apart by.
SETTINGS = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat damped")


def setting(marks: frozenset[str]) -> int | None:
    """The place in SETTINGS of a word's marks; negation and report outweigh being aimed."""
    if "threat" in marks:
        return SETTINGS.index("threat damped" if marks & {"negated", "reported"} else "threat")
    if "insult" not in marks:
        return None
    for mark in ("negated", "reported", "aimed"):
        if mark in marks:
            return SETTINGS.index(f"insult {mark}")
    return SETTINGS.index("insult")


def compiled(machines: Iterable[Transducer] = MACHINES) -> tuple[np.ndarray, np.ndarray]:
    """The composed machine as tables: next state and setting (-1: none) by (state, symbol and what is to come)."""
    first, *rest = machines
    for other in rest:
        first = first.then(other)
    number, queue, arcs = {first.start: 0}, [first.start], []
    for state in queue:
        row = []
        for later, symbol in ((later, symbol) for later in range(4) for symbol in SYMBOLS):
            to, marks = first.step(state, symbol, frozenset(mark for bit, mark in LATER.values() if later & bit))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            at = setting(marks)
            row.append((number[to], -1 if at is None else at))
        arcs.append(row)
    table = np.array(arcs, np.int64)
    return table[:, :, 0], table[:, :, 1]


@dataclass
class Grammar:
    """Learned weights: of words and word beginnings (natural logs), of the settings, and a bias."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lengths: tuple[int, ...] = (4, 5)
    settings: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.2, 0.5, 0.6, 3.0, 1.5]))
    bias: float = -3.0

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best


class Scorer:
    """Walks clauses through the composed machine; remembers the symbols of words it has seen."""

    def __init__(self, grammar: Grammar, keep: int = 300_000):
        to, at = compiled()
        self.to, self.at, self.grammar, self.keep = to.tolist(), at.tolist(), grammar, keep
        self.closed = {w: SYMBOLS.index(kind) for kind, ws in CLOSED.items() for w in ws.split()}
        self.later = {SYMBOLS.index(s): bit for s, (bit, _) in LATER.items()}
        self.seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        if (known := self.seen.get(word)) is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            w = self.grammar.weight(word)
            known = self.seen[word] = (self.closed[word], 1.0) if word in self.closed else (1, w) if w else (0, 0.0)
        return known

    def clause(self, words: list[str]) -> np.ndarray:
        """The clause's output by setting: summed insult weights, and 1 for each threat."""
        out, state, read = np.zeros(len(SETTINGS)), 0, [self.symbol(w) for w in words]
        later, to_come = 0, []
        for symbol, _ in reversed(read):
            to_come.append(later * len(SYMBOLS))
            later |= self.later.get(symbol, 0)
        for (symbol, weight), more in zip(read, reversed(to_come), strict=True):
            if (at := self.at[state][symbol + more]) >= 0:
                out[at] += weight
            state = self.to[state][symbol + more]
        return out

    def text(self, text: str | None) -> np.ndarray:
        """The output of the clause that weighs most (the first of equals), and half of each further one's in order of
        weight: 1, 1/2, 1/4 ...; so the strongest clauses decide and length alone does not add up."""
        low, outs = (text or "").lower(), []
        for clause in _CLAUSE.split(low):
            words = _WORDS.findall(clause)
            if any(self.symbol(w)[0] for w in words) and (out := self.clause(words)).any():
                outs.append(out)
        outs.sort(key=lambda o: -float(o @ self.grammar.settings))
        return 0.5 ** np.arange(len(outs)) @ np.array(outs) if outs else np.zeros(len(SETTINGS))

    def score(self, text: str | None) -> float:
        """1 / (1 + exp(-(bias + weighted output))): 0 to 1; no matched clause scores the bias alone."""
        z = self.grammar.bias + float(self.text(text) @ self.grammar.settings)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def train(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = 20_000, least: int = 4, odds: float = 20.0, share: float = 0.15
) -> Grammar:
    """Learn the grammar's weights from labelled rows.

    Of each label about ``documents`` rows, drawn by hash, teach, so the fit is bounded; whole texts count.  A
    word, or the first 4 or 5 letters of longer words, is an insult if at least ``least`` toxic
    texts hold it and its share of toxic texts, less a standard error, is ``odds`` times that of the
    others (one added to their count); its weight is the log of that ratio.  The weights of the settings and the bias
    are a logistic regression of the label on the machine's outputs, the weights kept at or above 0,
    with toxic texts weighing ``share`` of all, whatever their number.
    Null texts are empty, rows that repeat teach each; without rows of both labels the
    lexicon is empty and the score the same for all texts.
    """
    known = labelled.where(F.col(label).isNotNull()).select((F.col(label) == 1).cast("int").alias("y"), F.coalesce(text, F.lit("")).alias("text"), F.col(key).cast("string").alias("id"))
    rows = stage(bounded_sample(known, F.col("y"), F.concat_ws(":", "id", F.xxhash64("text")), documents), "labelled")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Grammar()

    def features(batches):
        for batch in batches:
            ys, fs = [], []
            for y, t in zip(batch["y"], batch["text"], strict=True):
                words = set(_WORDS.findall(t.lower()))
                own = {"=" + w for w in words} | {w[:n] for w in words for n in (4, 5) if len(w) > n}
                ys += [y] * len(own)
                fs += own
                if len(fs) > 50_000:
                    yield pd.DataFrame({"y": np.array(ys, np.int64), "f": np.array(fs, dtype=object)})
                    ys, fs = [], []
            yield pd.DataFrame({"y": np.array(ys, np.int64), "f": np.array(fs, dtype=object)})

    counts = rows.mapInPandas(features, "y long, f string").groupBy("f").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    ratio = ((F.col("c1") - F.sqrt("c1")) / n1) / ((F.col("c0") + 1) / n0)
    found = counts.where((F.col("c1") >= least) & (ratio >= odds)).select("f", F.log(ratio).alias("w")).collect()
    grammar = Grammar({r["f"][1:]: r["w"] for r in found if r["f"][0] == "="}, {r["f"]: r["w"] for r in found if r["f"][0] != "="}, bias=-2.0)

    def outputs(batches):
        scorer = Scorer(grammar)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [scorer.text(t) for t in batch["text"]]})

    seen = rows.mapInPandas(outputs, "y int, x array<double>").groupBy("y", "x").count().toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(SETTINGS))
    y, n = seen["y"].to_numpy(float), seen["count"].to_numpy(float)
    n = n * np.where(y == 1, share / max(1.0, n[y == 1].sum()), (1 - share) / max(1.0, n[y == 0].sum()))
    w = np.array([*grammar.settings, grammar.bias])
    z = np.column_stack([x, np.ones(len(x))])
    prior, rate = w.copy(), 1.0 / (0.25 * float((n[:, None] * z * z).sum(axis=0).sum()) + 0.01)
    for _ in range(3000):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - rate * (z.T @ (n * (p - y)) + 0.01 * (w - prior))
        w[:-1] = np.maximum(w[:-1], 0.0)
    grammar.settings, grammar.bias = w[:-1], float(w[-1])
    return grammar


def train_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = 20_000) -> Grammar:
    """``train`` on a labels table beside the documents: the rows to learn from are chosen among
    the labels by the hashes of their keys, so about ``documents`` keys of each label are sent to the scan."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    picked = bounded_sample(known, F.col(label), F.col(key).cast("string"), documents)
    return train(docs.select(key, text).join(F.broadcast(picked), key), key, text, label, documents)


def score(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The input with score and predicted (1 from ``threshold`` on).  Null and empty texts have no
    clause; rows that repeat are scored each by itself, whole texts count however long, an empty table gives
    an empty one.  Columns of the input with these names are replaced, all others stay as they are."""

    def compute():
        scorer = Scorer(grammar)

        def of(texts):
            s = np.array([scorer.score(t) for t in texts], np.float64)
            return [s, (s >= threshold).astype(np.int32)]

        return of

    return with_columns(docs, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], text, compute)
