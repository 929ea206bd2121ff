"""Toxicity by a weighted grammar: transducers find insults, threats, targets, negation and reported speech in clauses."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold, prepare, text_pass, training_rows
from starloom.llm.linear import logistic, probability

#: Labelled documents of each class that lexicon and weights are learned from, those with the smallest md5 of their id.
TRAIN_DOCS = 2_000
#: A stem is learned if toxic documents have it so many times as often as others, in so many contexts at least, and if
#: that is no chance: its log likelihood ratio exceeds the logarithm of the number of beginnings looked at by a margin.
STEM_ODDS = 12.0
STEM_CONTEXTS = 4
STEM_MARGIN = 3.0
STEM_LETTERS = (4, 12)
THRESHOLD = 0.5
CACHE_WORDS = 500_000

#: What a directed insult counts, as a multiple of a plain one.
DIRECTED = 1.5
#: What a negated or reported insult leaves, as a share of a plain one; only the heaviest of a text counts, and never
#: more than half of what the threshold takes.
REST = 0.1
#: What a threat counts, as a multiple of what the threshold takes; unless at least so many training texts with a threat and
#: no insult say otherwise by their labels.
THREAT_COUNTS = 1.5
THREAT_EVIDENCE = 20

# Closed word classes of the grammar in four languages.
THREATS = (
    "kill killed killing murder murdered hurt destroy strangle shoot stab beat burn "
    "töten töte umbringen umbringe schlagen schlage vernichten vernichte erwürgen erschießen verprügeln "
    "tuer tue tuerai frapper frapperai détruire détruirai étrangler poignarder brûler "
    "matar mataré mato golpear golpearé destruir destruiré estrangular quemar"
).split()
TARGETS = (
    "you your yours he she him her they them du dich dir dein deine euch euer ihr sie er ihn ihm "
    "tu toi te ton ta vous votre il elle ils elles lui leur tú ti usted ustedes él ella ellos ellas"
).split()
NEGATIONS = (
    "not never no nobody isn't aren't wasn't weren't don't doesn't didn't won't cannot nicht nie niemals kein keine keinen niemand "
    "ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco"
).split()
REPORTS = (
    "said says say saying told wrote called calls quoted claimed sagte sagt sagten schrieb nannte behauptete "
    "dit disait disent écrit appelé prétend dijo dice decía escribió llamó afirmó"
).split()

# Symbols that the lexicon writes and the clause transducer reads.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
#: Kinds of matches that the clause transducer writes.
KINDS = ("insult", "directed", "negated", "reported", "threat")

_CLAUSE = re.compile(r"[.!?;:\n]+")
_ASCII_OTHER = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() or chr(i) == "'" else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_OTHER).split()


class Transducer:
    """States, arcs (state, input) -> (next state, output, weight), and a default arc for inputs without one."""

    def __init__(self, arcs: dict[tuple, tuple], default):
        self.arcs, self.default = arcs, default

    def step(self, state, symbol) -> tuple:
        found = self.arcs.get((state, symbol))
        return found if found is not None else self.default(state, symbol)

    def after(self, first: Transducer) -> Transducer:
        """The composition: ``first`` reads the input, this one reads what ``first`` writes. Weights add up."""

        def step(state, symbol):
            one, two = state
            one, middle, weight = first.step(one, symbol)
            if middle is None:
                return (one, two), None, weight
            two, out, more = self.step(two, middle)
            return (one, two), out, weight + more

        return Transducer({}, step)

    def run(self, symbols, state):
        """Outputs (not None) of the path through ``symbols``, with the weight of each arc that wrote one."""
        written = []
        for symbol in symbols:
            state, out, weight = self.step(state, symbol)
            if out is not None:
                written.append((out, weight))
        return written


def lexicon(stems: dict[bytes, float]) -> Transducer:
    """Words to symbols: learned stems are insults with their weight, the closed classes as they are.

    A word that starts with a stem belongs to it; the longest stem counts. Words are looked up once and kept.
    """
    closed = {w.encode(): s for s, names in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in names}
    sizes = sorted({len(s) for s in stems}, reverse=True)
    arcs: dict[tuple, tuple] = {}

    def look(state, word):
        found = next((stems[word[:n]] for n in sizes if word[:n] in stems), None)
        arc = (state, INSULT, found) if found is not None else (state, closed.get(word, OTHER), 0.0)
        if len(arcs) >= CACHE_WORDS:
            arcs.clear()
        arcs[state, word] = arc
        return arc

    return Transducer(arcs, look)


def clause_grammar(reach: int = 3) -> Transducer:
    """Symbols of a clause to kinds of matches.

    The state is what was read before: whether a report, and how many words ago a negation, a target or a threat. An
    insult after a report is reported, within ``reach`` words of a negation negated, of a target directed; a threat within
    reach of a target is a threat. Every arc is written down here, so the default never sees another input.
    """
    span = range(reach + 1)  # 0: none in reach, else words of reach that are left
    arcs: dict[tuple, tuple] = {}
    for report in (False, True):
        for negation in span:
            for target in span:
                for threat in span:
                    state = (report, negation, target, threat)
                    less = (report, max(negation - 1, 0), max(target - 1, 0), max(threat - 1, 0))
                    kind = "reported" if report else "negated" if negation else "directed" if target else "insult"
                    arcs[state, INSULT] = (less, kind, 0.0)
                    arcs[state, NEGATION] = ((less[0], reach, less[2], less[3]), None, 0.0)
                    arcs[state, REPORT] = ((True, *less[1:]), None, 0.0)
                    threatened = "reported" if report else "negated" if negation else "threat"
                    arcs[state, TARGET] = ((less[0], less[1], reach, 0), threatened if threat else None, 0.0)
                    arcs[state, THREAT] = ((less[0], less[1], less[2], reach), threatened if target else None, 0.0)
                    arcs[state, OTHER] = (less, None, 0.0)
    return Transducer(arcs, lambda state, symbol: (state, None, 0.0))


START = (0, (False, 0, 0, 0))


class ToxicityModel:
    """Learned stems, what a threat counts, and how the strength of a text's matches becomes a score.

    A text's strength adds up its insults, each with the weight of its stem; a directed one counts DIRECTED times, a
    negated or reported one leaves REST. The score is a logistic function of the logarithm of the strength and never falls
    where that rises, so labels set how much evidence it takes, and the grammar what counts as evidence.
    """

    def __init__(self, rows: list[tuple[str, int]]):
        """From (text, label) rows; label 1 is toxic."""
        self.stems = learned_stems(rows)
        labels = np.array([y for _, y in rows], dtype=np.float64)
        self.rate = float(labels.mean()) if len(rows) else 0.0
        self.line: tuple[float, float] | None = None
        self.enough = self.threat = 0.0
        if not 0 < self.rate < 1:
            return
        found = [self.matches(t) for t, _ in rows]
        self.enough = math.inf  # while fitting, what a negated insult leaves is not bounded by the threshold
        strength = np.log1p([self.strength(x) for x in found])
        slope, level = logistic(strength[:, None], labels, penalty=1e-4)
        # Without insults to learn from, threats still have to reach the threshold.
        self.line = (float(slope), float(level)) if slope > 0 else (1.0, float(level))
        self.enough = math.expm1(max(math.log(THRESHOLD / (1 - THRESHOLD)) - self.line[1], 0.0) / self.line[0])
        alone = [y for x, (_, y) in zip(found, rows, strict=True) if {k for k, _ in x} == {"threat"}]
        harmless = len(alone) >= THREAT_EVIDENCE and 2 * sum(alone) < len(alone)
        self.threat = 0.0 if harmless else THREAT_COUNTS * self.enough

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "_grammar")}

    def matches(self, text: str) -> list[tuple[str, float]]:
        """(kind, weight of the stem) of every match in every clause."""
        if not hasattr(self, "_grammar"):
            self._words = lexicon(self.stems)
            self._grammar = clause_grammar().after(self._words)
        step = self._words.step
        # Most texts have no word of the lexicon's open classes; their clauses write nothing.
        if not any(step(0, w)[1] in (INSULT, THREAT) for w in set(words_of(text))):
            return []
        return [x for clause in _CLAUSE.split(text) for x in self._grammar.run(words_of(clause), START)]

    def strength(self, matches: list[tuple[str, float]]) -> float:
        """What all matches of a text amount to."""
        total = left = 0.0
        for kind, weight in matches:
            weight = max(weight, 1.0)
            if kind == "insult":
                total += weight
            elif kind == "directed":
                total += DIRECTED * weight
            elif kind == "threat":
                total += self.threat
            else:
                left = max(left, REST * weight)
        return total + min(left, self.enough / 2)

    def score(self, text: str | None) -> float:
        if self.line is None:
            return self.rate
        slope, level = self.line
        return float(probability(np.float64(slope * math.log1p(self.strength(self.matches(text) if text else [])) + level)))


def learned_stems(rows: list[tuple[str, int]]) -> dict[bytes, float]:
    """Word beginnings that toxic documents have and others hardly ever, with their log odds.

    Documents are counted for every beginning of every word, toxic ones once for each word before it: copies of one
    document repeat the context, so they count once. Of beginnings in the same documents the longest is taken, which is the
    whole word if the word does not vary; none is taken below one that is.
    """
    low, high = STEM_LETTERS
    contexts: dict[bytes, set[bytes]] = defaultdict(set)
    docs = {0: Counter(), 1: Counter()}
    number = Counter(y for _, y in rows)
    if not number[0] or not number[1]:
        return {}
    for text, label in rows:
        words = words_of(text)
        begun = {w[:n] for w in set(words) if not w.isdigit() for n in {*range(low, min(len(w), high) + 1), max(low, len(w))} if len(w) >= low}
        docs[label].update(begun)
    share = number[1] / (number[0] + number[1])
    able = {s for s, n in docs[1].items() if n >= STEM_CONTEXTS and (n + 0.25) / number[1] >= STEM_ODDS * (docs[0][s] + 0.25) / number[0]}
    for text, label in rows:
        if label:
            words = words_of(text)
            for before, w in zip([b"", *words], words, strict=False):
                for n in range(low, len(w) + 1):
                    if w[:n] in able:
                        contexts[w[:n]].add(before)
    least = math.log(len(docs[1]) + 1) + STEM_MARGIN

    def sure(s: bytes) -> bool:
        toxic, other = min(len(contexts[s]), docs[1][s]), docs[0][s]
        every = toxic + other
        ratio = toxic * math.log(toxic / every / share) + (other * math.log(other / every / (1 - share)) if other else 0)
        return toxic >= STEM_CONTEXTS and ratio >= least

    able = {s for s in able if sure(s)}
    closed = {s for s in able if not any(docs[1][t] == docs[1][s] for t in _longer(s, able))}
    out: dict[bytes, float] = {}
    for s in sorted(closed, key=lambda s: (len(s), s)):
        if not any(s[:n] in out for n in range(low, len(s))):
            out[s] = math.log((docs[1][s] + 0.25) / number[1]) - math.log((docs[0][s] + 0.25) / number[0])
    return out


def _longer(s: bytes, able: set[bytes]) -> list[bytes]:
    return [t for c in range(256) if (t := s + bytes([c])) in able]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """A model from at most ``train_docs`` documents of each label outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", train_docs).select("text", F.col("label").cast("int").alias("label")).collect()
    return ToxicityModel(sorted((r.text, r.label) for r in rows))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row by its whole text alone.

    Null and empty texts have no match and get the score of texts without one. Without labels of both classes every text
    gets the share of toxic rows (0 without any). Rows are independent of each other, so repeated rows and null ids
    (held_out is then null) give rows like any other. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scores = [held.value.score(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    found = text_pass(docs, columns, "doc_id long, score double", work)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
