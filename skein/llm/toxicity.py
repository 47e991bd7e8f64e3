"""Toxicity by a weighted finite-state pattern grammar.

Words are classes: insult, threat, target, negation, reported speech, other; a clause ends with an end symbol. Five
weighted transducers rewrite this tape: reported speech and negation change the insults and threats in their reach;
threat looks for a target after it; target joins insults to targets on either side, nearer ones with more weight; insult
turns what is left into events. compose() makes one machine of them, which reads a clause once. A document's score is
logistic in its events' weighted counts, weighted also by how telling the matched stem is. Stems (word beginnings) come
from a short list and from a bounded sample of labelled rows, as do the weights.

Cases: null and empty texts have no clauses and get the base score; texts and clauses of any length are scored whole, from
a clause's true start; labels of other values than 0 and 1 and rows without a text teach nothing; of an id with several
labels the toxic one counts, of one with several texts the least; without labels the built-in weights hold; of stems that
fit a word the weightiest counts; equal rows each give their row, and teach once; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, table, trimmed
from skein.llm.samples import bounded_texts, fold, picked_ids

#: At most so many labelled documents of each kind to learn from, and so many bytes of texts of each.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 2000, 4000, 32 << 20
FOLDS = 5
#: Stems have so many letters at least and at most; a learnt one this G statistic, and this ratio of shares.
STEM, LEAST_G, LEAST_RATIO = (3, 9), 30.0, 60.0
#: Word lists of the grammar.
INSULTS = "idiot stupid scum trash loser worthless pathetic moron clown disgusting dumb imbecile dummkopf trottel connard salaud estupid imbécil".split()
THREATS = "kill hurt destroy beat stab shoot umbringen töten tuer frapper matar golpear".split()
TARGETS = "you your he she they him her them people du dich ihr euch sie tu toi vous il elle ils usted tú ustedes él ella".split()
NEGATIONS = "not never no isn't aren't nicht kein keine nie pas jamais nunca jamás".split()
REPORTED = "said says claimed wrote quoted sagte schrieb dit écrit dijo escribió".split()
EVENTS = ("insult", "insult at target", "insult negated", "insult reported", "threat at target", "threat negated or reported")
#: Weights before any label is seen, with the base score's log odds first.
PRIOR = (-3.0, 5.0, 5.5, 1.5, 1.5, 4.0, 1.0)
#: Of texts that share so many of their least run hashes only the first teaches.
RUNS, SHARED = 12, 3
#: A stem grows to a longer one that this share of its texts hold.
SHARE = 0.97
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
#: Words that a negation, threat, target or insult reaches, and the weight of a target so many words away.
REACH = 3
NEARNESS = {1: 1.0, 2: 0.9, 3: 0.8}
#: The symbols of the tape.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = CLASS_NAMES = ("other", "insult", "threat", "target", "negation", "report", "end")
NEGATED, QUOTED, THREAT_OFF = "negated insult", "quoted insult", "threat off"
#: One more insult waits for a target; and the beginning of what is told of all that wait.
HOLD, HELD = "hold", "held "
#: The symbols that are words: each counts as one wherever reach is counted.
WORDS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, QUOTED, THREAT_OFF)


class Machine(NamedTuple):
    """A weighted transducer: by state and symbol the next state and (symbol, weight) out. A symbol without an arc goes
    through as it is."""

    start: object
    arcs: dict

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (state, ((symbol, 1.0),))


def reported_speech() -> Machine:
    """After a word of reported speech, to the end of the clause, insults are quoted and threats off."""
    return Machine(0, {(0, REPORT): (1, ((REPORT, 1.0),)), (1, INSULT): (1, ((QUOTED, 1.0),)), (1, THREAT): (1, ((THREAT_OFF, 1.0),)), (1, END): (0, ((END, 1.0),))})


def negation() -> Machine:
    """The state counts the words that a negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        for w in WORDS:
            told = {INSULT: NEGATED, THREAT: THREAT_OFF}.get(w, w) if left else w
            arcs[left, w] = (REACH if w == NEGATION else max(0, left - 1), ((told, 1.0),))
        arcs[left, END] = (0, ((END, 1.0),))
    return Machine(0, arcs)


def threat() -> Machine:
    """The state is the last threat's kind and the words it still reaches; a target there makes it an event."""
    arcs, kinds = {}, {THREAT: "threat at target", THREAT_OFF: "threat negated or reported"}
    for kind in (None, *kinds):
        for left in range(1, REACH + 1) if kind else (0,):
            for w in WORDS:
                to = (w, REACH) if w in kinds else (kind, left - 1) if left > 1 and w != TARGET else (None, 0)
                event = ((kinds[kind], 1.0),) if kind and w == TARGET else ()
                arcs[(kind, left), w] = (to, ((w, 1.0), *event))
            arcs[(kind, left), END] = ((None, 0), ((END, 1.0),))
    return Machine((None, 0), arcs)


def target() -> Machine:
    """The state counts the words that the last target, and the last insult waiting for one, still reach."""
    arcs, at, alone = {}, "insult at target", "insult"
    for aimed in range(REACH + 1):
        for held in range(REACH + 1):
            for w in WORDS:
                out, waits = [(w, 1.0)], max(0, held - 1)
                if w == TARGET and held:
                    out.append((HELD + at, NEARNESS[REACH - held + 1]))
                    waits = 0
                elif w == INSULT and aimed:
                    out.append((at, NEARNESS[REACH - aimed + 1]))
                elif w == INSULT:
                    out.append((HOLD, 1.0))
                    waits = REACH
                if w != TARGET and held == 1 and not waits:
                    out.append((HELD + alone, 1.0))
                arcs[(aimed, held), w] = ((REACH if w == TARGET else max(0, aimed - 1), waits), tuple(out))
            arcs[(aimed, held), END] = ((0, 0), ((END, 1.0), *(((HELD + alone, 1.0),) if held else ())))
    return Machine((0, 0), arcs)


def insult() -> Machine:
    """Words say nothing any more, but negated and quoted insults are events."""
    told = {NEGATED: (("insult negated", 1.0),), QUOTED: (("insult reported", 1.0),)}
    return Machine(0, {(0, w): (0, told.get(w, ())) for w in (*WORDS, END)})


def compose(first: Machine, second: Machine, symbols: tuple[str, ...]) -> Machine:
    """The machine that gives what second gives for first's output; symbols: those that first is asked."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        if (state, symbols[0]) in arcs:
            continue
        for symbol in symbols:
            a, between = first.step(state[0], symbol)
            b, out = state[1], []
            for x, weight in between:
                b, told = second.step(b, x)
                out += [(y, weight * w) for y, w in told]
            arcs[state, symbol] = ((a, b), tuple(out))
            todo.append((a, b))
    return Machine(start, arcs)


def grammar() -> Machine:
    whole = reported_speech()
    for machine in (negation(), threat(), target(), insult()):
        whole = compose(whole, machine, CLASS_NAMES)
    return whole


GRAMMAR = grammar()


def compiled(machine: Machine) -> list[list[tuple[int, tuple]]]:
    """For each state and class the next state and its acts: (event, or -1 to hold; whether of those held; weight). 0 is
    the start."""
    states = [machine.start, *sorted({s for s, _ in machine.arcs} - {machine.start}, key=repr)]
    place = {s: k for k, s in enumerate(states)}

    def act(symbol: str, weight: float) -> tuple[int, bool, float]:
        return (-1, False, weight) if symbol == HOLD else (EVENTS.index(symbol.removeprefix(HELD)), symbol.startswith(HELD), weight)

    return [[(place[to], tuple(act(*x) for x in out)) for to, out in (machine.arcs[s, c] for c in CLASS_NAMES)] for s in states]


TABLE = compiled(GRAMMAR)
CLASSES = {w: CLASS_NAMES.index(c) for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTED), (THREAT, THREATS)) for w in ws}
INSULT_CLASS, END_CLASS = CLASS_NAMES.index(INSULT), CLASS_NAMES.index(END)


class Lexicon:
    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.longest = max(map(len, stems), default=0)
        self.found = ahocorasick.Automaton()
        for s in {*stems, *THREATS}:
            self.found.add_word(s, len(s))
        if len(self.found):
            self.found.make_automaton()

    def weight(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in range(STEM[0], min(self.longest, len(word)) + 1)), default=0.0)

    def events(self, text: str) -> list[float]:
        """Weighted counts of the events of all clauses in which anything is found."""
        out, done = [0.0] * len(EVENTS), -1
        if not len(self.found):
            return out
        low = text.lower()
        for end, n in self.found.iter(low):
            begin = end - n + 1
            if begin <= done or begin and low[begin - 1].isalnum():
                continue
            first = max(done + 1, *(low.rfind(x, done + 1, begin) + 1 for x in CLAUSE_ENDS))
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            state, held = 0, 0.0
            for m in WORD.finditer(low, first, done):
                word = m[0]
                weight = self.weight(word)
                state, acts = TABLE[state][INSULT_CLASS if weight else CLASSES.get(word, 0)]
                for e, waited, w in acts:
                    if e < 0:
                        held += weight
                    elif waited:
                        out[e] += w * held
                        held = 0.0
                    else:
                        out[e] += w * (weight or 1.0)
            for e, _, w in TABLE[state][END_CLASS][1]:
                out[e] += w * held
        return out


def strength(x: float) -> float:
    """One event counts almost fully, more of them a little more."""
    return min(1.0, x) + log1p(x) / 4


def apart(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies, which would make one text's words look telling."""
    seen, out = Counter(), []
    for text, label in rows:
        words = WORD.findall(text.lower())
        least = sorted({zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))})[:RUNS]
        if sum(h in seen for h in least) < min(SHARED, len(least)):
            out.append((text, label))
        seen.update(least)
    return out


def learnt_stems(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Word beginnings that tell toxic from other texts, with weights of 0 to 1."""
    counts, n = (Counter(), Counter()), [0, 0]
    for text, toxic in rows:
        found = {w[:k] for w in set(WORD.findall(text.lower())) for k in range(STEM[0], min(STEM[1], len(w)) + 1)}
        counts[toxic].update(found)
        n[toxic] += 1
    if not n[0] or not n[1]:
        return {}
    share, told = n[1] / (n[0] + n[1]), {}
    for stem, a in counts[1].items():
        b = counts[0][stem]
        ratio = ((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1))
        g = 2 * (a * log(a / ((a + b) * share)) + (b * log(b / ((a + b) * (1 - share))) if b else 0.0))
        if ratio >= LEAST_RATIO and g >= LEAST_G:
            told[stem] = min(1.0, log(ratio) / log(100))
    kept = [s for s, w in told.items() if not any(s[:k] in told and told[s[:k]] >= w - 0.05 for k in range(STEM[0], len(s)))]
    return {closed(s, counts[1]): told[s] for s in kept}


def closed(stem: str, counts: Counter) -> str:
    """The longest stem that nearly all texts with this one hold: no shorter than what their words share."""
    longer: dict[str, int] = {stem: counts[stem]}
    for s, n in counts.items():
        if s.startswith(stem) and n >= SHARE * counts[stem]:
            longer[s] = n
    return max(longer, key=len)


def logistic(features: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps from and towards PRIOR."""
    prior = w = np.array(PRIOR)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (labels - p)) - ridge * (w - prior)
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: list[float]):
        self.lexicon, self.weights = lexicon, weights

    def __reduce__(self):
        return rebuilt, (self.lexicon.stems, self.weights)

    def score(self, text: str | None) -> float:
        z = self.weights[0]
        if text:
            for w, x in zip(self.weights[1:], self.lexicon.events(text), strict=True):
                z += w * strength(x)
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def rebuilt(stems: dict[str, float], weights: list[float]) -> Scorer:
    return Scorer(Lexicon(stems), weights)


def fit(rows: list[tuple[str, int]], rate: float) -> Scorer:
    """rows: (text, toxic 0 or 1); rate: the share of toxic rows among all labelled."""
    rows = apart(rows)
    lexicon = Lexicon({s: 1.0 for s in INSULTS} | learnt_stems(rows))
    if not rows or not 0 < rate < 1:
        return Scorer(lexicon, list(PRIOR))
    x = np.array([[strength(e) for e in lexicon.events(t)] for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    return Scorer(lexicon, logistic(np.column_stack([np.ones(len(y)), x]), y, weight).tolist())


def fitted(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fits on at most TOXIC_ROWS and CLEAN_ROWS labelled documents outside the held-out fold, whole texts of at most
    SAMPLE_BYTES for each of the two."""
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked_ids(known, "toxic", F.when(F.col("toxic") == 1, TOXIC_ROWS).otherwise(CLEAN_ROWS))
    # at most TOXIC_ROWS + CLEAN_ROWS ids, hence the broadcast
    found = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    rows = sorted((r["text"], r["toxic"]) for r in bounded_texts(found, "toxic", SAMPLE_BYTES).collect())
    rate = known.agg(F.avg("toxic").alias("rate")).head()["rate"] or 0.0
    return fit(rows, rate)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The columns of docs and toxicity double."""
    kept = [c for c in docs.columns if c != "toxicity"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "toxicity"])

    bounded_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("toxicity", "double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
