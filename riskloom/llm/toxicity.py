"""Toxicity by a weighted finite-state clause grammar.

A text is cut into clauses.  A clause becomes a string of symbols: I (an
insult stem), H (a threat word), T (a target), N (a negation), R (reported
speech: a saying verb or a quotation mark), and ``.`` for any other word.
Five small transducers read it in lockstep: insult and threat announce their
finding, target says whether it is aimed at somebody near by, negation and
reported speech whether it is denied or only quoted.  Their joint output is
the clause's pattern, such as ``insult+target`` or ``insult+negated``; only
clauses in which insult or threat fires are scored.

Learned from labelled rows: the insult stems and the weight of every pattern
(the log-odds of documents with such a clause, shrunk towards the pattern
without its modifiers).  A stem is a prefix that marks toxic documents and
hardly any others once it begins at least ``k`` (1 to 3) different words of
the text, so that a stem which innocent words share by chance still counts
where it piles up.  Training uses at most about ``max_rows`` labelled rows, taken
by hash of the doc_id; the scoring pass reads every whole text in one narrow
map.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import crc_mod5, written

# Cue words of the grammar, in English, French, German and Spanish.
TARGETS = set("""you your yours yourself u he him his she her they them their these those people everyone
tu toi te vous votre vos il elle ils elles eux du dich dir dein deine ihr euch euer sie er
tú ti usted ustedes vosotros él ella ellos ellas su""".split())
NEGATIONS = set("""not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't hardly
ne pas jamais aucun aucune sans nicht kein keine keinen nie niemals ohne nunca jamás sin ningún ninguna tampoco""".split())
REPORTED = set("""said says say saying told tells called calls wrote writes claimed claims quoted quote reported
dit disent disait écrit appelé appelle cite sagt sagte sagen schrieb nannte nennt zitiert
dijo dice dicen escribió llamó llama cita""".split())
THREATS = set("""kill killing murder shoot stab hang burn hurt beat destroy
tuer tuerai frapper crever brûler töten umbringen schlagen erschießen verbrennen sterben
matar mataré golpear quemar morir""".split())
QUOTES = "\"“”„«»"
CLAUSE_END = re.compile(r"[.;:!?\n]")
TOKEN = re.compile(rf"[\w'’]+|[{QUOTES}]")
WORD = re.compile(r"\w+")
NEAR = 4  # words between a finding and its target, negation


# -- transducers ---------------------------------------------------------------

class Marker:
    """Fires when its symbol is read."""

    def __init__(self, symbol: str):
        self.symbol = symbol

    def run(self, symbols: str) -> bool:
        return self.symbol in symbols


class Near:
    """Fires when the cue is at most ``gap`` words before a finding or, if
    ``after``, behind one.  The states are two countdowns, which every symbol
    lowers and a cue or a finding sets back."""

    def __init__(self, cue: str, after: bool, gap: int = NEAR):
        self.cue, self.after, self.gap = cue, after, gap

    def run(self, symbols: str) -> bool:
        cue = found = 0
        for s in symbols:
            cue, found = max(cue - 1, 0), max(found - 1, 0)
            if s == self.cue:
                if self.after and found:
                    return True
                cue = self.gap + 1
            elif s in "IH":
                if cue:
                    return True
                found = self.gap + 1
        return False


class Before:
    """Fires when a finding follows the cue anywhere in the clause."""

    def __init__(self, cue: str):
        self.cue = cue

    def run(self, symbols: str) -> bool:
        seen = False
        for s in symbols:
            if s == self.cue:
                seen = True
            elif seen and s in "IH":
                return True
        return False


FINDINGS = (("insult", Marker("I")), ("threat", Marker("H")))
MODIFIERS = (("target", Near("T", after=True)), ("negated", Near("N", after=False)), ("reported", Before("R")))


def pattern(symbols: str) -> str | None:
    """The joint output of the transducers; None when nothing is found.  A
    threat word counts only when it is aimed at somebody."""
    found = [name for name, t in FINDINGS if t.run(symbols)]
    more = [name for name, t in MODIFIERS if t.run(symbols)]
    if found == ["threat"] and "target" not in more:
        return None
    return "+".join(found + more) if found else None


# -- model -----------------------------------------------------------------------

@dataclass
class Model:
    stems: dict[str, int]  # stem -> different words it must begin
    weights: dict[str, float]
    bias: float
    default: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for s in {*self.stems, *THREATS}:
            a.add_word(s, len(s))
        if len(a):
            a.make_automaton()
        return a

    def score(self, text: str | None, automaton) -> float:
        """The log-odds of the most telling clause, or of texts without any;
        further clauses add theirs divided by their rank, if toxic by themselves."""
        ranked = sorted((self.weights.get(p, self.default) for p in patterns(text, self.stems, automaton)), reverse=True)
        if not ranked:
            return sigmoid(self.bias)
        return sigmoid(ranked[0] + sum(max(w, 0) / k for k, w in enumerate(ranked[1:], 2)))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def symbol(token: str, stems: set[str]) -> str:
    if token in NEGATIONS:
        return "N"
    if token in TARGETS:
        return "T"
    if token in REPORTED or token in QUOTES:
        return "R"
    if token in THREATS:
        return "H"
    return "I" if any(token[:k] in stems for k in range(MIN_STEM, min(len(token), MAX_STEM) + 1)) else "."


def patterns(text: str | None, stems: dict[str, int], automaton) -> list[str]:
    """Patterns of the clauses of a whole text that hold a finding.  The
    automaton proposes places; only their clauses are parsed."""
    if not text or not len(automaton):
        return []
    low = text.lower()
    places, words = [], {}
    for last, size in automaton.iter(low):
        start = last + 1 - size
        if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
            continue
        stem = low[start:last + 1]
        places.append((start, last, stem))
        if stem in stems:
            words.setdefault(stem, set()).add(WORD.match(low, start).group())
    active = {s for s, w in words.items() if len(w) >= stems[s]}
    out, done = [], -1
    for start, last, stem in places:
        if start < done or stem not in active and stem not in THREATS:
            continue
        begin = max(done, 0)
        for m in CLAUSE_END.finditer(low, begin, start):
            begin = m.end()
        m = CLAUSE_END.search(low, last + 1)
        done = m.end() if m else len(low)
        found = pattern("".join(symbol(t, active) for t in TOKEN.findall(low[begin:done])))
        if found:
            out.append(found)
    return out


# -- learning --------------------------------------------------------------------

MIN_STEM, MAX_STEM = 3, 8


def stems_of(text: str) -> set[str]:
    """(stem, k) for every stem that begins at least k different words, k to 3;
    written as the stem, a tab and k."""
    words = set(WORD.findall(text.lower()))
    counts = Counter(w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1))
    return {f"{s}\t{k}" for s, c in counts.items() for k in range(1, min(c, 3) + 1)}


def training_sample(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int) -> DataFrame:
    """_y and text of the labelled training rows, one row per distinct text; by
    hash of the doc_id, so that about ``max_rows`` rows are taken at any size.
    A document labelled both ways counts as toxic."""
    own = (labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
           .where("_y IN (0, 1)").where(train))
    n = own.count()
    share = max(1, math.ceil(1_000_000 * min(1.0, max_rows / max(n, 1))))
    taken = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    picked = rows.where(taken & train).join(own.where(taken), "_id").where("text IS NOT NULL")
    return written(picked.groupBy("text").agg(F.max("_y").alias("_y")), "toxic-sample")


def _counted(sample: DataFrame, stems: frozenset[str] | None) -> DataFrame:
    """stem, number of texts; counted per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for text in b.column(0).to_pylist():
                own = stems_of(text)
                counts.update(own if stems is None else own & stems)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

    return sample.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _held(sample: DataFrame, stems: frozenset[str]) -> list[list[str]]:
    """Per toxic text of the sample the pure stems it holds (bounded by the sample)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(stems_of(t) & stems) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["s"])

    return [r["s"] for r in sample.select("text").mapInArrow(run, "s array<string>").collect()]


def cover(held: list[list[str]], times: int = 3, least: int = 5) -> list[str]:
    """Greedy cover of the toxic texts, each up to ``times`` times, by stems;
    the longest of stems that mark the same number of texts."""
    where: dict[str, set[int]] = {}
    for i, own in enumerate(held):
        for s in own:
            where.setdefault(s, set()).add(i)
    need, chosen = [times] * len(held), []
    while where:
        gain = {s: sum(need[i] > 0 for i in ids) for s, ids in where.items()}
        best = max(gain, key=lambda s: (gain[s], -int(s[-1]), len(s), s))
        if gain[best] < least:
            break
        chosen.append(best)
        for i in where[best]:
            need[i] -= 1
        # prefixes and extensions of a chosen stem say the same
        where = {s: ids for s, ids in where.items() if not (s[:-2].startswith(best[:-2]) or best.startswith(s[:-2]))}
    return chosen


def learn_stems(sample: DataFrame, min_texts: int = 5, purity: float = 0.9) -> dict[str, int]:
    toxic, clean = sample.where("_y = 1"), sample.where("_y = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    # what the cover asks of a stem at least; a text of S stems leaves at most 100 S candidates
    least = max(min_texts, math.ceil(0.01 * n_toxic))
    rows = _counted(toxic, None).where(F.col("n") >= least).collect()
    n1 = {r["stem"]: r["n"] for r in rows}
    n0 = {r["stem"]: r["n"] for r in _counted(clean, frozenset(n1)).collect()}
    pure = frozenset(s for s, n in n1.items() if n / n_toxic >= purity * (n / n_toxic + n0.get(s, 0) / n_clean) and n >= purity * (n + n0.get(s, 0)))
    chosen = cover(_held(toxic, pure), least=least)
    return {s[:-2]: int(s[-1]) for s in chosen}


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = 20_000, prior_texts: float = 5.0) -> Model:
    """Stems, pattern weights and bias from the training rows.

    ``train`` selects them by the column ``_id``; by default rows whose
    crc32(doc_id) modulo 5 is not 0.  Without rows of both labels the model
    finds nothing and scores every text alike."""
    sample = training_sample(docs, labels, crc_mod5(F.col("_id")) != 0 if train is None else train, max_rows)
    stems = learn_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Model(stems, {}, 0, 0).automaton()
        for b in batches:
            found = [sorted(set(patterns(t, stems, automaton))) or [""] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], names=["p", "y"])

    counts = {(r["p"], r["y"]): r["count"] for r in sample.select("text", "_y").mapInArrow(run, "p array<string>, y int")
              .select(F.explode("p").alias("p"), "y").groupBy("p", "y").count().collect()}
    n = [sum(r["count"] for r in sample.groupBy("_y").count().collect() if r["_y"] == y) for y in (0, 1)]
    if not n[0] or not n[1]:
        return Model({}, {}, math.log((n[1] + 1) / (n[0] + 1)), 0.0)
    bias = math.log((counts.get(("", 1), 0) + 0.5) / (counts.get(("", 0), 0) + 0.5))

    def odds(names: Iterable[str], base: float) -> float:
        a, b = (sum(counts.get((p, y), 0) for p in names) for y in (1, 0))
        p = sigmoid(base)
        return math.log((a + prior_texts * p + 1e-3) / (b + prior_texts * (1 - p) + 1e-3))

    seen = {p for p, _ in counts if p}
    overall = odds([p for p in seen if p.startswith("insult")], 0.0)
    weights = {}
    for p in seen:
        # a denied or quoted finding is taken for half as telling until the labels say otherwise
        base = (overall if p.startswith("insult") else 0.0) * (0.5 if "negated" in p or "reported" in p else 1.0)
        weights[p] = odds([p], base)
    return Model(stems, weights, bias, 0.5 * overall)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (crc32 of the id, modulo 5, is 0), score, predicted.

    A null or empty text scores the bias; a null doc_id is not held out; repeated
    rows are scored each; extra columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            scores = [model.score(t, automaton) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("long")
    return (docs.select(key.alias("doc_id"), F.coalesce(crc_mod5(key) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))


def is_toxic(text: Column, model: Model) -> Column:
    """Boolean column for filters; the same score as ``score_texts``."""
    @F.arrow_udf("boolean")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.automaton()
        for t in texts:
            yield pa.array([model.score(x, automaton) >= 0.5 for x in t.to_pylist()], pa.bool_())

    return toxic(text.cast("string"))
