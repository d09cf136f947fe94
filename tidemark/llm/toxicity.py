"""Toxicity by a weighted finite-state pattern grammar.

Small automata over word classes (insults, threats, targets, negation,
reported speech) are composed into one weighted transducer. It reads each
clause and gives a weight where a pattern ends: an insult counts otherwise when
aimed at a target, before or after it, under negation and in reported speech;
threats need a verb of the future. A text's score is a logistic function of its
clauses' weights.

Word weights come from labelled texts: the log-odds of a word, or of the stem
that a word begins with, from the number of different contexts (the words
beside it) in toxic and in clean texts. Counting contexts, not occurrences,
keeps the words of copied passages out. Spark counts them; the driver gets the
weights alone. What target, negation and report multiply a weight by, and the
logistic, are fitted on other labelled texts than the words: of all choices of
``ToxicParams.factors`` that of least logistic loss, where losses are within
``tie`` the one named first. Only a bounded sample of labelled rows is used.

Edge cases: a null or empty text scores as one without matches; unlabelled
ids, null labels and held-out rows are never learned from; without toxic rows
to learn from the built-in words alone count; extra columns are ignored;
repeated rows score alike.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, ship, stored

# Closed word classes of the grammar.
TARGETS = frozenset("you your yours yourself u ur he she they them him her his their everyone people du dich dir ihr euch sie tu te toi vous tú usted ustedes vosotros él ella".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn didn without neither nicht kein keine nie ne pas jamais sin nunca jamás".split())
REPORTS = frozenset("said says say called calls wrote told claims claimed reported quoted sagte sagt nannte dit disait appelé dijo llamó".split())
FUTURES = frozenset("will gonna shall ll should must going werde wirst wird werden werdet vais vas va allons vont voy vamos van".split())
# "die" is left out, as it is an article in German
THREATS = frozenset(
    "kill hurt destroy beat murder shoot stab hang burn töten umbringen erschießen verprügeln erstechen verbrennen tuer frapper poignarder brûler détruire égorger "
    "matar matarte mataros golpear golpearte apuñalar quemar quemarte destruir".split()
)

_TOKEN = re.compile(r"[^\W_]+|[.!?;:\n\"«»“”]")
_ENDS = frozenset(".!?;\n")
OTHER, INSULT, TARGET, NEGATION, REPORT, FUTURE, THREAT = range(7)


@dataclass(frozen=True)
class ToxicParams:
    #: Bounds on the labelled rows learned from, toxic and clean; a hash of the id picks them.
    max_toxic: int = 2000
    max_clean: int = 4000
    #: A word or stem needs so many different contexts in toxic texts ...
    min_contexts: int = 10
    #: ... and so large a share of its contexts there, with equal numbers of either.
    min_precision: float = 0.97
    stems: tuple[int, ...] = (4, 5, 6)
    #: Choices of what a target, negation and report multiply an insult's weight by; of choices as good, the first.
    factors: tuple[tuple[float, ...], ...] = ((1.3, 1.0, 1.6, 2.0), (0.25, 0.0, 0.5, 1.0), (0.5, 0.1, 0.25, 1.0))
    #: A later choice must lower the mean loss by more than this.
    tie: float = 1e-4
    #: No more words and no more stems than this, those of most contexts first.
    max_words: int = 50_000
    held_out_mod: int = 4
    held_out_rest: int = 2
    threshold: float = 0.3


class Automaton:
    """A deterministic automaton over word classes: (state, class) -> state, and whether its pattern holds in a state."""

    def __init__(self, step, on) -> None:
        self.step, self.on = step, on


def _window(trigger: int, length: int) -> Automaton:
    """On for ``length`` words after a word of the class."""
    return Automaton(lambda s, c: length if c == trigger else max(0, s - 1), lambda s: s > 0)


#: The contexts that change what an insult counts.
CONTEXTS = (("target", _window(TARGET, 5)), ("negation", _window(NEGATION, 3)), ("report", Automaton(lambda s, c: 1 if c == REPORT else s, lambda s: s > 0)))
_FUTURE = _window(FUTURE, 3)
#: Words after an insult within which a target still makes it aimed.
_AFTER = 3


def _pending(s: tuple[int, int], c: int, mask: int) -> tuple[int, int]:
    """(words left, contexts) of an insult that no target has been seen for."""
    if c == INSULT:
        return (0, 0) if mask & 1 else (_AFTER, mask)
    return (s[0] - 1, s[1]) if s[0] > 1 and c != TARGET else (0, 0)


def composed() -> tuple[list[dict], int]:
    """The product of all automata: for each state, class -> (state, contexts). State 0 starts a clause.

    Contexts are bits in the order of CONTEXTS, -1 where no pattern ends. For an
    insult or a threat they are those of the word; for a target they are those
    of the insult before it, which is aimed from there on.
    """
    parts = [a for _, a in CONTEXTS] + [_FUTURE]
    first = ((0,) * len(parts), (0, 0))
    names, table, todo = {first: 0}, [], [first]
    for s, open_ in todo:  # grows while it is read
        row = {}
        for c in range(7):
            mask = sum(a.on(x) << k for k, ((_, a), x) in enumerate(zip(CONTEXTS, s)))
            ends = c == INSULT or (c == THREAT and _FUTURE.on(s[-1]))
            out = mask if ends else open_[1] if c == TARGET and open_[0] else -1
            t = (tuple(a.step(x, c) for a, x in zip(parts, s)), _pending(open_, c, mask))
            if t not in names:
                names[t] = len(names)
                todo.append(t)
            row[c] = (names[t], out)
        table.append(row)
    return table, len(names)


def products(factors: tuple[float, ...]) -> list[float]:
    """The factor of each set of contexts."""
    return [math.prod(by for k, by in enumerate(factors) if mask >> k & 1) for mask in range(1 << len(factors))]


@dataclass(frozen=True)
class Grammar:
    words: dict
    stems: dict
    #: Intercept and slopes of the strongest clause and of all clauses together.
    logit: tuple[float, float, float] = (-4.0, 1.0, 0.5)
    lengths: tuple[int, ...] = (4, 5, 6)
    #: Of CONTEXTS, in order.
    factors: tuple[float, ...] = (1.3, 0.25, 0.5)


class Matcher:
    """Scores texts with a grammar; remembers the classes of words, up to a bound."""

    def __init__(self, grammar: Grammar) -> None:
        self.g, (self.table, _) = grammar, composed()
        self.factors = products(grammar.factors)
        self.seen: dict[str, tuple | None] = {}
        for names, c in ((REPORTS, REPORT), (FUTURES, FUTURE), (NEGATIONS, NEGATION), (TARGETS, TARGET)):
            self.seen.update((w, (c, 0.0)) for w in names)
        self.seen.update((w, (THREAT, 2.0)) for w in THREATS)
        self.fixed = dict(self.seen)

    def kind(self, w: str) -> tuple | None:
        """The class and weight of a word, or None for any other."""
        if w in _ENDS:
            return (-1, 0.0)
        weight = self.g.words.get(w)
        if weight is None:
            weight = max((self.g.stems.get(w[:n], 0.0) for n in self.g.lengths if len(w) >= n), default=0.0)
        return (INSULT, weight) if weight else None

    def matched(self, text: str) -> list[list[float]]:
        """For each clause with a match, the weights by their contexts."""
        tokens = _TOKEN.findall(text.lower())
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
            seen.update(self.fixed)
        for w in {*tokens}.difference(seen):
            seen[w] = self.kind(w)
        kinds = [seen[w] for w in tokens]
        if not any(k and k[1] for k in kinds):
            return []
        out, sums, last, state, table = [], None, 0.0, 0, self.table
        for k in kinds:
            if k is None:
                state = table[state][OTHER][0]
            elif k[0] < 0:
                if sums:
                    out.append(sums)
                sums, state = None, 0
            else:
                state, mask = table[state][k[0]]
                if mask >= 0:
                    sums = sums or [0.0] * len(self.factors)
                    if k[0] == TARGET:
                        sums[mask] -= last
                        sums[mask | 1] += last
                    else:
                        sums[mask] += k[1]
                        # a threat leaves the insult before it open, with its own weight
                        last = k[1] if k[0] == INSULT else last
        return [*out, sums] if sums else out

    def clauses(self, text: str) -> list[float]:
        """The weight of each matched clause."""
        return _weights(self.matched(text), self.factors)

    def features(self, text: str | None) -> tuple[float, float]:
        return _features(self.clauses(text or ""))

    def score(self, text: str | None) -> float:
        x, (b, u, v) = self.features(text), self.g.logit
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + u * x[0] + v * x[1]))))


def _weights(matched: list[list[float]], by: list[float]) -> list[float]:
    return [w for sums in matched if (w := sum(map(float.__mul__, sums, by))) > 1e-9]


def _features(clauses: list[float]) -> tuple[float, float]:
    return max(clauses, default=0.0), math.log1p(sum(clauses))


def held_out(params: ToxicParams = ToxicParams()) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % params.held_out_mod == params.held_out_rest


def learned_words(texts: DataFrame, params: ToxicParams) -> tuple[dict, dict]:
    """Weights of words and of stems from texts(text, y).

    Toxic texts first give the words of enough contexts; only those are counted
    in clean texts. Different contexts are told apart before they move, so a
    word of a third of all texts is spread over its contexts.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    beside = F.concat(F.array(F.lit("")), words, F.array(F.lit("")))
    # the words are split once for each text, not once for each place
    each = let(beside, lambda w: F.transform(F.slice(w, 2, F.size(w) - 2), lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get(w, i), F.get(w, i + 2)).alias("context"))))
    one = texts.select("y", F.explode(each).alias("e")).select("y", "e.*").distinct()
    cut = [F.when(F.length("word") >= n, F.struct(F.substring("word", 1, n).alias("feature"), F.lit(True).alias("stem"))) for n in params.stems]
    named = F.array(F.struct(F.col("word").alias("feature"), F.lit(False).alias("stem")), *cut)
    rows = one.select("y", "context", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("f")).select("y", "context", "f.*")
    key = ["feature", "stem"]

    def counted(r: DataFrame, name: str) -> DataFrame:
        return r.select(*key, "context").distinct().groupBy(*key).agg(F.count("*").alias(name))

    likely = stored(counted(rows.filter("y = 1"), "bad").filter(F.col("bad") >= params.min_contexts))
    good = counted(rows.filter("y = 0").join(likely.select(*key), key, "left_semi"), "good")
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = [float(max(1, n.get(k, 0))) for k in (0, 1)]
    bad, good_ = F.col("bad") / total[1], F.col("good") / total[0]
    weight = F.log((F.col("bad") + 0.5) / total[1]) - F.log((F.col("good") + 0.5) / total[0])
    both = likely.join(good, key, "left").fillna(0, ["good"]).filter(bad / (bad + good_) >= params.min_precision)
    out: tuple[dict, dict] = ({}, {})
    for stem in (False, True):
        kept = both.filter(F.col("stem") == stem).orderBy(F.desc("bad"), "feature").limit(params.max_words)
        out[stem].update((r["feature"], r["weight"]) for r in kept.select("feature", F.least(F.lit(8.0), weight).alias("weight")).collect())
    return out


def fitted(x: list[tuple[float, float]], y: list[int]) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a little shrinkage; a slope that would be negative is left out of the fit."""
    import numpy as np

    if not x or len(set(y)) < 2:
        return Grammar({}, {}).logit
    a, t = np.column_stack([np.ones(len(x)), np.array(x, float)]), np.array(y, float)
    used = [0, 1, 2]
    while True:
        w, part = np.zeros(len(used)), a[:, used]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h = (part * (p * (1 - p))[:, None]).T @ part + 0.1 * np.eye(len(used))
            step = np.linalg.solve(h, part.T @ (p - t) + 0.1 * w)
            w = w - step
            if abs(step).max() < 1e-8:
                break
        if len(used) == 1 or w[1:].min() >= 0:
            full = dict(zip(used, map(float, w)))
            return full[0], full.get(1, 0.0), full.get(2, 0.0)
        used.pop(1 + int(w[1:].argmin()))


def learn(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> Grammar:
    """A grammar from a bounded sample of the labelled rows that aren't held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(params)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    n = {r["_toxic"]: r["n"] for r in known.groupBy((F.col("_toxic") == 1).cast("int").alias("_toxic")).agg(F.count("*").alias("n")).collect()}
    part = [min(1.0, most / max(1, n.get(k, 0))) for k, most in ((0, params.max_clean), (1, params.max_toxic))]
    share = F.when(F.col("_toxic") == 1, int(part[1] * 1_000_000)).otherwise(int(part[0] * 1_000_000))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    part_of = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3)).alias("part")
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col("_toxic") == 1).cast("int").alias("y"), part_of))
    words, stems = learned_words(texts.filter("part <> 0"), params)
    return refitted(texts.filter("part = 0"), Grammar(words, stems, lengths=params.stems), params)


def refitted(texts: DataFrame, grammar: Grammar, params: ToxicParams = ToxicParams()) -> Grammar:
    """The grammar with factors and logistic fitted on texts(text, y); tasks send a few numbers for each text."""
    ship(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(grammar)
    choices = list(itertools.product(*params.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, by = Matcher(sent.value), [products(c) for c in choices]
        for b in batches:
            x = []
            for t in b.column(1).to_pylist():
                matched = m.matched(t)
                x.append([v for p in by for v in _features(_weights(matched, p))] if matched else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    # bounded by max_toxic and max_clean: no texts, and 2 numbers for each choice
    rows = texts.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    rows = sorted((r["y"], tuple(r["x"])) for r in rows)
    y = [k for k, _ in rows]
    best = None
    for n, c in enumerate(choices):
        x = [v[2 * n : 2 * n + 2] or (0.0, 0.0) for _, v in rows]
        logit = fitted(x, y)
        value = loss(x, y, logit)
        if best is None or value < best[0] - params.tie:
            best = (value, c, logit)
    return Grammar(grammar.words, grammar.stems, best[2], grammar.lengths, best[1])


def loss(x: list[tuple[float, float]], y: list[int], logit: tuple[float, float, float]) -> float:
    """Mean logistic loss."""
    total = 0.0
    for (u, v), k in zip(x, y):
        z = logit[0] + logit[1] * u + logit[2] * v
        total += math.log1p(math.exp(-abs(z))) + max(z, 0.0) - k * z
    return total / max(1, len(y))


def scored(docs: DataFrame, grammar: Grammar, params: ToxicParams = ToxicParams()) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value)
        for b in batches:
            score = [m.score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= params.threshold) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).select("doc_id", held_out(params).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
