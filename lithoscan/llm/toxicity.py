"""Toxicity: a weighted finite-state grammar over clauses.

Words are read by a lexicon transducer as insults (with a weight), threats,
targets, negations or reporting words; the last four word classes are fixed, but
weights of insults and threats are learnt from labelled rows, in any language: of
insults as words and as beginnings of words, of threats as words before a target.
Two cascades of transducers then rewrite the clause. One reads it from its end, so
that a target or a reporting word reaches back; the other reads what the first
has written from its beginning. In each, a transducer reads the symbols that the
one before it writes: a denied insult is no insult to those after it. Each cascade
is composed into one deterministic weighted automaton, so a clause is read once in
each direction; only clauses with an insult or a threat score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_text_batches, table
from .labels import held_out, sigmoid, training_sample

#: Labelled rows learnt from, at most; all that they teach is kept.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Least documents an insult is learnt from, and its least log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 1.5
PREFIXES = (4, 5, 6, 7, 8)
REMEMBERED = 500_000

# Word classes of the grammar in English, German, French and Spanish.
TARGETS = "you your yourself he she they him her them his their du dich dir ihr euch sie tu toi te vous votre ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never nor n't isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún".split()
REPORTS = "said says say told quoted quote reported reports called wrote writes claimed according sagte sagt schrieb laut dit disait selon écrit dijo dice según escribió".split()
THREATS = "kill hurt destroy beat attack shoot burn crush töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()

TOKEN = re.compile(r"[.!?;:\n]|[^\W_]+(?:'\w+)?")
END = frozenset(".!?;:\n")
#: Symbols: what the lexicon writes, then what only the grammar writes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, DENIED, QUOTED = range(9)
SYMBOLS = 9
#: Symbols that scopes and repetition act on; denied and quoted ones are done with.
LIVE = (INSULT, THREAT, AIMED)
TARGET_SET = frozenset(TARGETS)
#: Weight of a word of ``THREATS`` before a target where the sample doesn't teach one.
UNLEARNT = 1.0


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``moves[state, symbol] = (state, symbol written, factor)``. Missing: stay, the same symbol, 1."""

    name: str
    states: int
    moves: dict[tuple[int, int], tuple[int, int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.moves.get((state, symbol), (state, symbol, 1.0))


def _scope(name: str, opener: int, writes: int, factor: float, length: int | None = None) -> Transducer:
    """Live insults and threats up to ``length`` words after ``opener``, or to the clause's end, are written as ``writes``."""
    moves: dict[tuple[int, int], tuple[int, int, float]] = {}
    last = length or 1
    for state, symbol in product(range(last + 1), range(SYMBOLS)):
        after = last if symbol == opener or (state and length is None) else max(state - 1, 0)
        hit = state > 0 and symbol in LIVE and symbol != writes
        moves[state, symbol] = (after, writes if hit else symbol, factor if hit else 1.0)
    return Transducer(name, last + 1, moves)


#: Read from the clause's end: a reporting word or a target that follows.
BACKWARD = (
    _scope("report behind", REPORT, QUOTED, 0.5, 4),
    _scope("target behind", TARGET, AIMED, 1.25, 3),
)
#: Read from the clause's beginning, after the former.
FORWARD = (
    _scope("negation", NEGATION, DENIED, 0.4, 3),
    _scope("report", REPORT, QUOTED, 0.5),
    _scope("target", TARGET, AIMED, 1.5, 6),
    Transducer("repeat", 3, {(s, c): (min(s + 1, 2), c, (1.0, 1.1, 1.2)[s]) for s in range(3) for c in LIVE}),
)


def compose(parts: tuple[Transducer, ...]) -> Transducer:
    """One transducer that does what ``parts`` do in turn, each reading what the one before it writes.

    Its states are the tuples of theirs that can be reached; state 0 begins a clause.
    """
    names: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
    moves: dict[tuple[int, int], tuple[int, int, float]] = {}
    todo = list(names)
    for state in todo:
        for symbol in range(SYMBOLS):
            written, factor, to = symbol, 1.0, []
            for part, own in zip(parts, state, strict=True):
                moved, written, weight = part.step(own, written)
                to.append(moved)
                factor *= weight
            if tuple(to) not in names:
                names[tuple(to)] = len(names)
                todo.append(tuple(to))
            moves[names[state], symbol] = (names[tuple(to)], written, factor)
    return Transducer(" . ".join(p.name for p in parts), len(names), moves)


def tables(t: Transducer) -> list[list[tuple[int, int, float]]]:
    """``t`` as rows of moves, ``[state][symbol]``."""
    return [[t.step(s, c) for c in range(SYMBOLS)] for s in range(t.states)]


BACKWARD_MOVES, FORWARD_MOVES = tables(compose(BACKWARD)), tables(compose(FORWARD))


def features_of(word: str) -> list[str]:
    """A word's features: itself, ending in ``$``, and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if k < len(word))]


def threat_of(word: str) -> str:
    """The feature of a word that stands before a target."""
    return word + ">"


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """Sum of a clause's weights after both cascades have rewritten it."""
    total, state = 0.0, 0
    written, factors = [], []
    for symbol in reversed(symbols):
        state, out, factor = BACKWARD_MOVES[state][symbol]
        written.append(out)
        factors.append(factor)
    state = 0
    for symbol, factor, weight in zip(reversed(written), reversed(factors), weights, strict=True):
        state, _, own = FORWARD_MOVES[state][symbol]
        if weight:
            total += weight * factor * own
    return total


class Reader:
    """Scores texts by a lexicon of features with weights, and the grammar."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, float, float] | None] = dict.fromkeys(END)
        self.fixed = {w: symbol for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

    def read(self, word: str) -> tuple[int, float, float]:
        """A word's symbol and weight, and its weight as a threat where a target follows."""
        threat = self.lexicon.get(threat_of(word), UNLEARNT if word in THREATS else 0.0)
        symbol = self.fixed.get(word)
        if symbol is not None:
            return symbol, 0.0, 0.0
        weight = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
        return (INSULT if weight > 0 else OTHER), max(weight, 0.0), threat

    def summary(self, text: str) -> tuple[float, float, float, float]:
        """Logs of the sum and of the best clause's score, of matched clauses, and of words."""
        tokens = TOKEN.findall(text.lower())
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = dict.fromkeys(END)
        for w in set(tokens).difference(known):
            known[w] = self.read(w)
        read = list(map(known.__getitem__, tokens))
        total = best = 0.0
        matched, done, n = 0, -1, len(read)
        for i in [i for i, r in enumerate(read) if r is not None and (r[1] or r[2])]:
            if i <= done:
                continue
            aimed = lambda k: k + 1 < n and read[k + 1] is not None and read[k + 1][0] == TARGET  # noqa: B023, E731
            if not read[i][1] and not aimed(i):
                continue
            start = i
            while start and read[start - 1] is not None:
                start -= 1
            done = i
            while done + 1 < n and read[done + 1] is not None:
                done += 1
            symbols, weights = [], []
            for k in range(start, done + 1):
                symbol, weight, threat = read[k]
                if threat > weight and aimed(k):
                    symbol, weight = THREAT, threat
                symbols.append(symbol)
                weights.append(weight)
            clause = clause_score(symbols, weights)
            total += clause
            best = max(best, clause)
            matched += 1
        return float(np.log1p(total)), float(np.log1p(best)), float(np.log1p(matched)), float(np.log1p(n))


def row_features(text: str) -> set[str]:
    """The features that a text has: of its words, and of those before a target in a clause."""
    tokens = TOKEN.findall(text.lower())
    found = {f for w in set(tokens) if w not in END for f in features_of(w)}
    found.update(threat_of(a) for a, b in pairwise(tokens) if b in TARGET_SET and a not in END)
    return found


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Features that toxic rows of ``sample(text, y)`` have more often, with their log-odds less a standard error.

    Rows are counted in tasks and summed by feature; those of at least
    ``LEAST_ODDS`` that ``LEAST_DOCS`` toxic rows have reach the driver, so their
    number is bounded by the sample's. Eager.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y] += 1
                counts[y].update(row_features(text or ""))
        names = [*counts[1], *(f for f in counts[0] if f not in counts[1])]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(["", *names]), pa.array([n[1], *(counts[1][f] for f in names)]), pa.array([n[0], *(counts[0][f] for f in names)])], names=["feature", "p", "n"]
            )

    sums = sample.select("text", "y").mapInArrow(run, "feature string, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = sums.where(f"feature = '' or p >= {LEAST_DOCS}")
    whole = sums.where("feature = ''").first()
    if whole is None or not whole["p"] or not whole["n"]:
        return {}
    rate_p, rate_n = (F.col("p") + 0.5) / (whole["p"] + 1.0), (F.col("n") + 0.5) / (whole["n"] + 1.0)
    odds = F.log(rate_p / rate_n) - F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    ranked = sums.where("feature <> ''").select("feature", odds.alias("odds")).where(f"odds >= {LEAST_ODDS}")
    return {r["feature"]: r["odds"] for r in ranked.collect()}


def summaries(docs: DataFrame, lexicon: dict[str, float], extra: str) -> DataFrame:
    """``(doc_id, <extra>, total, best, matched, words)`` of every row of ``docs``."""
    small_text_batches(docs.sparkSession)
    kind = docs.schema[extra].dataType.simpleString() if extra else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in batches:
            rows = np.array([reader.summary(t or "") for t in b.column(2).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(rows[:, i]) for i in range(4))], names=["doc_id", extra, "total", "best", "matched", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), extra, "text").mapInArrow(run, f"doc_id long, {extra} {kind}, total double, best double, matched double, words double")


PARTS = ["total", "best", "matched", "words"]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights of the clause summaries by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        w[0] = np.log(share / (1 - share))
        return w
    keep = ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(rounds):
        p = sigmoid(z @ w)
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Half of the sample teaches the lexicon, the other half the weights of clause
    scores, which so aren't fitted on the words' own rows. Null and empty texts
    match no clause; a null doc_id counts as an empty one in the fold; without
    usable labels every row has one score; repeated rows get equal scores; an
    empty table gives an empty result; other columns are ignored. Eager in the fit.
    """
    rows = training_sample(docs, labels, "toxic", sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    lexicon = learn_lexicon(rows.where(~half))
    seen = summaries(rows.where(half), lexicon, "y").orderBy("doc_id").toPandas()
    w = fit(seen[PARTS].to_numpy(float), seen["y"].to_numpy(float))
    fold = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    total = F.lit(float(w[0]))
    for name, v in zip(PARTS, w[1:], strict=True):
        total = total + F.col(name) * float(v)
    scored = summaries(fold, lexicon, "held_out").select("doc_id", "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
