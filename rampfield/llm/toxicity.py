"""Toxicity scores from a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, quotation mark,
other). Five weighted transducers rewrite the symbols of a clause: insults and threats become
hits, insults in a row weigh more, a target before or behind a hit aims it, a negation near it
negates it, and reported speech takes it from the writer. What stands behind a word is known
from a machine that reads the clause from its end; the others are composed into one machine.
A document is scored by a logistic model over the weights of its clauses' hits. Insults are
learned from labelled rows as word stems with log-odds as weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed, stored

#: fixed values: words of the grammar in English, German, French and Spanish
TARGETS = (
    "you your yours yourself he she they them her him his their du dich dir ihr euch dein deine sie tu toi te vous "
    "ton ta tes votre vos tú ti usted ustedes vosotros tus"
).split()
NEGATIONS = "not no never neither nor don't isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco".split()
REPORTING = (
    "said says say told wrote writes claimed claims reported reports quoted quotes sagte sagt schrieb behauptete "
    "berichtet dit disait écrit affirme dijo dice escribió afirma"
).split()
#: stems: a word that starts with one is a threat, unless another word than an ending follows it
THREATS = "kill murder hurt beat destroy shoot stab umbring töte verprügel tuer frapp matar mataré golpea".split()
ENDINGS = ("", "s", "ed", "ing", "er", "ers", "en", "n", "bed", "bing", "t", "te", "ten", "est", "ai", "ez", "ons", "é", "r", "ré", "rte", "rlo")
INSULTS = "idiot moron stupid pathetic worthless scum loser trash disgusting".split()

#: symbols of words, and the modes of a hit
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
MODES = ("plain", "aimed", "negated", "reported")
#: words that a negation reaches
REACH = 3
STEM = (3, 8)
#: what an insult right behind another one weighs
IN_A_ROW = 1.25
#: weight of a threat, and of threats of each mode in a document's score; labelled rows may hold none
THREAT_WEIGHT, THREAT_PRIOR = 2.0, (0.0, 1.5, 0.0, 0.0)

Step = dict[tuple[int, int], tuple[int, int, float]]


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (state, symbol, weight), starting in state 0."""

    steps: Step
    symbols: int

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: the other machine reads what this one writes; weights multiply."""
        names, todo, steps = {(0, 0): 0}, [(0, 0)], {}
        for a, b in todo:
            for s in range(self.symbols):
                a2, mid, w = self.steps[a, s]
                b2, out, v = other.steps[b, mid]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                steps[names[a, b], s] = names[a2, b2], out, w * v
        return Transducer(steps, self.symbols)

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        state, out = 0, []
        for s in symbols:
            state, wrote, weight = self.steps[state, s]
            out.append((wrote, weight))
        return out


#: symbols 7 and 8 are insults and threats with a target behind them; hits by kind and mode follow
BEHIND = {INSULT: 7, THREAT: 8}
FIRST_HIT = 9
ALL = FIRST_HIT + 8


def hit(kind: int, mode: int) -> int:
    return FIRST_HIT + 4 * (kind - INSULT) + mode


HITS = {hit(kind, mode): (kind, mode) for kind in (INSULT, THREAT) for mode in range(4)}


def _machine(states: int, step) -> Transducer:
    """From step(state, symbol), which gives the new state, the symbol written and its weight."""
    return Transducer({(q, s): step(q, s) for q in range(states) for s in range(ALL)}, ALL)


def target_behind() -> Transducer:
    """Read from the end of a clause: marks what has a target behind it."""
    return _machine(2, lambda q, s: (int(q or s == TARGET), BEHIND[s] if q and s in BEHIND else s, 1.0))


def insults() -> Transducer:
    """Insults become hits; those right behind another weigh more."""
    def step(q: int, s: int):
        mode = {INSULT: 0, BEHIND[INSULT]: 1}.get(s)
        return (0, s, 1.0) if mode is None else (1, hit(INSULT, mode), IN_A_ROW if q else 1.0)

    return _machine(2, step)


def threats() -> Transducer:
    """Threats become hits, aimed where a target stands behind."""
    modes = {THREAT: 0, BEHIND[THREAT]: 1}
    return _machine(1, lambda q, s: (0, hit(THREAT, modes[s]) if s in modes else s, 1.0))


def targets() -> Transducer:
    """A target before a hit aims it."""
    def step(q: int, s: int):
        kind, mode = HITS.get(s, (None, None))
        return int(q or s == TARGET), hit(kind, 1) if q and mode == 0 else s, 1.0

    return _machine(2, step)


def negations() -> Transducer:
    """A negation negates the hits among the next words."""
    def step(q: int, s: int):
        left = REACH if s == NEGATION else max(0, q - 1)
        return left, hit(HITS[s][0], 2) if q and s in HITS else s, 1.0

    return _machine(REACH + 1, step)


def reported_speech() -> Transducer:
    """Everything behind a reporting verb, and what stands between quotation marks, is reported."""
    def step(q: int, s: int):  # bit 0: reporting verb seen, bit 1: inside quotation marks
        new = q | 1 if s == REPORT else q ^ 2 if s == QUOTE else q
        return new, hit(HITS[s][0], 3) if q and s in HITS else s, 1.0

    return _machine(4, step)


def grammar() -> Transducer:
    """All but the machine that reads from the end."""
    return insults() @ threats() @ targets() @ negations() @ reported_speech()


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult stems (a word starting with one is an insult) and of threat words."""

    insults: dict[str, float]

    def pattern(self) -> re.Pattern:
        stems = sorted({*self.insults, *THREATS}, key=lambda s: (-len(s), s))
        return re.compile("|".join(map(re.escape, stems)))


TOKEN = re.compile(r"[\w'’-]+|[\"“”„«»]")
BREAK = re.compile(r"[.!?;:,\n]")


class Reader:
    """Runs the machines over the clauses of texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.insults, self.find = lexicon.insults, lexicon.pattern()
        self.behind, self.machine = target_behind(), grammar()
        self.classes = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING)) for w in words}
        self.longest = max((len(s) for s in self.insults), default=0)

    def symbol(self, token: str) -> tuple[int, float]:
        if token in "\"“”„«»":
            return QUOTE, 0.0
        for k in range(min(len(token), self.longest), 0, -1):
            w = self.insults.get(token[:k])
            if w is not None:
                return INSULT, w
        known = self.classes.get(token)
        if known is None and any(token.startswith(s) and token[len(s) :] in ENDINGS for s in THREATS):
            return THREAT, THREAT_WEIGHT
        return (OTHER if known is None else known), 1.0

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of the clauses that hold an insult or threat, each once."""
        at = 0
        while (m := self.find.search(text, at)) is not None:
            k = m.start()
            if k and (text[k - 1].isalnum() or text[k - 1] == "_"):
                at = k + 1
                continue
            start = max(text.rfind(c, 0, k) for c in ".!?;:,\n") + 1
            stop = BREAK.search(text, m.end())
            at = stop.start() if stop else len(text)
            yield start, at

    def clause(self, clause: str) -> np.ndarray:
        """Weight of every kind and mode of hit in a clause."""
        out = np.zeros(8)
        read = [self.symbol(t) for t in TOKEN.findall(clause)]
        marked = [s for s, _ in self.behind.run([s for s, _ in reversed(read)])][::-1]
        for (wrote, factor), (_, weight) in zip(self.machine.run(marked), read):
            if wrote >= FIRST_HIT:
                out[wrote - FIRST_HIT] += weight * factor
        return out

    def features(self, text: str) -> np.ndarray:
        """log(1 + weight) of each kind and mode over all clauses, the heaviest clause, and clauses hit."""
        text = text.lower()
        total, top, n = np.zeros(8), 0.0, 0
        for a, b in self.clauses(text):
            w = self.clause(text[a:b])
            total += w
            # threats count there only where they are aimed
            strong = float(w[:4].sum() + w[5])
            top = max(top, strong)
            n += strong > 0
        return np.concatenate([np.log1p(total), [math.log1p(top), math.log1p(n)]])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    bias: float
    weights: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.bias, -30, 30)))


#: used where labels of both kinds are missing
UNTRAINED = ToxicityModel(Lexicon({w: 2.0 for w in INSULTS}), -2.5, (1.0, 1.5, 0.2, 0.2, 1.0, 1.5, 0.2, 0.2, 1.0, 0.5))


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many labelled texts a word starts with the stem."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from collections import Counter

        seen = Counter(), Counter()
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
                seen[label].update({w[:k] for w in words for k in range(STEM[0], min(len(w), STEM[1]) + 1)})
        # a stem that this task saw in clean texts alone cannot become an insult by itself, but counts elsewhere
        stems = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), pa.array([seen[1][s] for s in stems], pa.int64()), pa.array([seen[0][s] for s in stems], pa.int64())],
            ["stem", "toxic", "clean"],
        )

    rows = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(count, "stem string, toxic bigint, clean bigint")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, size: int) -> Lexicon:
    """Stems whose log-odds are surely high; of nested stems the best, and of equal ones the longest."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic - F.col("toxic") + 0.5)) - F.log(c / (n_clean - F.col("clean") + 0.5))
    sure = odds - 1.65 * F.sqrt(1 / t + 1 / c + 1 / (n_toxic - t + 1) + 1 / (n_clean - c + 1))
    least = max(4, math.ceil(0.02 * n_toxic))
    rows = (
        stem_counts(sample).filter(F.col("toxic") >= least).withColumns({"sure": F.round(sure, 9)})
        .filter(F.col("sure") > 1.5).orderBy(F.desc("sure"), F.desc(F.length("stem")), "stem").limit(size).collect()
    )
    chosen: dict[str, float] = {}
    for r in rows:
        s = r["stem"]
        if not any(s.startswith(o) or o.startswith(s) for o in chosen):
            chosen[s] = float(r["sure"])
    return Lexicon(chosen)


def fit(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.1) -> tuple[float, np.ndarray]:
    """Weighted logistic regression by Newton steps; the bias is not shrunk.

    Weights of threats are drawn to ``THREAT_PRIOR``, all others to zero.
    """
    x = np.hstack([np.ones((len(features), 1)), features])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    prior = np.zeros(x.shape[1])
    prior[5:9] = THREAT_PRIOR
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weights * (labels - p)) - penalty * (beta - prior)
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), beta[1:]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_toxic: int = 4_000, most_clean: int = 8_000, lexicon_size: int = 2_000,
) -> ToxicityModel:
    """A model from labelled documents.

    It is fitted on at most ``most_toxic`` and ``most_clean`` rows, those with the smallest
    hash of their id; so the sample, the lexicon and the features are bounded. Null ids and
    labels are left out; an id labelled twice is toxic if one label says so. Without labels
    of both kinds the built-in lexicon and weights are used.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna()
    known = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return UNTRAINED
    order = [F.xxhash64("id"), F.col("id")]
    some = known.filter("toxic = 1").orderBy(*order).limit(most_toxic).union(
        known.filter("toxic = 0").orderBy(*order).limit(most_clean)
    )
    # at most most_toxic + most_clean ids
    sample = stored(
        packed(docs, id_col, text_col).select("id", "text").join(F.broadcast(some), "id").select("id", "toxic", "text")
    )
    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not got.get(0) or not got.get(1):
        return UNTRAINED
    lexicon = learn_lexicon(sample, got[1], got[0], lexicon_size)
    if not lexicon.insults:
        return UNTRAINED
    rows = featured(sample, lexicon, "toxic int").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    # weights undo that toxic and clean rows are sampled at different rates
    rate = np.where(y > 0, sizes[1] / got[1], sizes[0] / got[0])
    bias, weights = fit(x, y, rate / rate.mean())
    return ToxicityModel(lexicon, bias, tuple(weights))


def featured(rows: DataFrame, lexicon: Lexicon, first: str) -> DataFrame:
    """(first, features) of rows (first, text)."""
    name = first.split()[0]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(lexicon)
        for b in batches:
            f = [reader.features(t or "").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], [name, "features"])

    return rows.select(name, "text").mapInArrow(read, f"{first}, features array<double>")


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, score): the toxicity of every document between 0 and 1.

    Null and empty texts hold no clause and get the score of a text without hits. Every row
    is scored by itself, so repeated rows get equal scores; extra columns stay in ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value.lexicon)
        for t in texts:
            x = [reader.features(v or "") for v in t]
            yield pd.Series(shared.value.score(np.array(x)) if x else [], dtype=float)

    # only the texts go to Python
    rows = packed(docs, id_col, text_col)
    return rows.select("row", "id", score(F.col("text").cast("string")).alias("score"))
