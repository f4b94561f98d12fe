"""Toxicity by a learned lexicon, misspellings included (operator 4).

Terms (words, and stems that begin words) that mark labelled toxic texts are put in a trie.
A Levenshtein automaton of one edit runs over the trie; the product of both is made
deterministic state by state as texts need it, so a word costs one lookup per character.
Hits are weighed in a window of words around them: a hit in quotation marks or with words
of reporting near it counts apart from one that stands among further hits. A logistic model
over these sums, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaktrail.llm.staging import discard, stage

#: At most this many labelled rows (the first by hash) are learned from.
SAMPLE_ROWS = 20_000
#: At most this many terms make up the lexicon, the surest first.
MAX_TERMS = 2_000
#: Standard errors by which a term's log odds must exceed zero.
SURE = 3.0
STEMS = (4, 5, 6)
#: Terms from this length on are matched with one edit.
FUZZY_LENGTH = 5
WINDOW = 6
PREDICT_FROM = 0.3
WORD = re.compile(r"\w(?:[\w*@$]*\w)?|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
#: Words of reporting in the four languages of the corpus.
REPORTING = frozenset("said says called wrote quoted word words dit disait mot mots sagte nannte wort worte dijo llamó palabra palabras".split())
#: Words and transitions kept by a Python worker; only memory depends on them.
CACHE = 500_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def terms_of(text: str | None) -> list[str]:
    """Distinct words of a text, and their stems with a closing ``~``."""
    words = set(tokens(text)) - QUOTES
    return sorted(words | {w[:n] + "~" for w in words for n in STEMS if len(w) > n})


class Matcher:
    """Deterministic product of the lexicon's trie and the one-edit Levenshtein automaton."""

    def __init__(self, weights: dict[str, float], fuzzy: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.long_below = [False]
        self.stem_at: dict[int, str] = {}
        self.word_at: dict[int, str] = {}
        for term in weights:
            text = term.rstrip("~")
            node, path = 0, [0]
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.long_below.append(False)
                node = self.children[node][ch]
                path.append(node)
            if len(text) >= FUZZY_LENGTH:
                for n in path:
                    self.long_below[n] = True
            (self.stem_at if term.endswith("~") else self.word_at)[node] = term
        self.weights, self.fuzzy = weights, fuzzy
        self.states: list[tuple] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self.known: dict[str, tuple[float, str, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state made of (trie node, edits), with the terms it accepts."""
        pairs = pairs | {(c, 1) for n, e in pairs if e == 0 for c in self.children[n].values()}  # a character left out
        pairs = {(n, e) for n, e in pairs if e == 0 or self.long_below[n] and (n, 0) not in pairs}
        key = frozenset(pairs)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append((tuple(pairs), self._best(pairs, self.stem_at), self._best(pairs, self.word_at)))
        return self.ids[key]

    def _best(self, pairs, at: dict[int, str]) -> tuple[float, str, int] | None:
        found = [(self.weight(at[n], e), at[n], e) for n, e in pairs
                 if n in at and (e == 0 or len(at[n].rstrip("~")) >= FUZZY_LENGTH)]
        return max(found, default=None)

    def weight(self, term: str, edits: int) -> float:
        return self.fuzzy.get(term, 0.0) if edits else self.weights[term]

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for n, e in self.states[state][0]:
            child = self.children[n].get(ch)
            if child is not None:
                out.add((child, e))
            if e == 0:
                out.add((n, 1))  # a character too many
                out.update((c, 1) for c in self.children[n].values() if c != child)  # another character
        return self._state(out) if out else -1

    def find(self, word: str) -> tuple[float, str, int] | None:
        """Best (weight, term, edits) that ``word`` is, or begins with; None if there is none."""
        state, best = self.start, None
        for ch in word:
            key = (state, ch)
            after = self.moves.get(key)
            if after is None:
                if len(self.moves) > CACHE:
                    self.moves.clear()
                after = self.moves[key] = self._move(state, ch)
            if after < 0:
                return best
            state = after
            stem = self.states[state][1]
            if stem is not None and (best is None or stem > best):
                best = stem
        whole = self.states[state][2]
        return whole if whole is not None and (best is None or whole > best) else best

    def hits(self, words: list[str]) -> list[tuple[int, float, str, int]]:
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        for k, w in enumerate(words):
            if w in known:
                hit = known[w]
            else:
                hit = known[w] = self.find(w)
            if hit is not None:
                out.append((k, *hit))
        return out


def window_sums(words: list[str], hits: list[tuple[int, float, str, int]]) -> list[float]:
    """Sums over the hits of one text: all, misspelled, quoted, among further hits; the largest; hits per word."""
    quote_at = [k for k, w in enumerate(words) if w in QUOTES] if hits else []
    total = edited = quoted = dense = top = 0.0
    opened, seen = 0, 0
    for at, (k, weight, _, edits) in enumerate(hits):
        while seen < len(quote_at) and quote_at[seen] < k:
            opened, seen = opened + 1, seen + 1
        inside = opened % 2 == 1 and seen < len(quote_at)
        near = words[max(0, k - WINDOW):k + WINDOW + 1]
        reported = any(w in REPORTING for w in near)
        company = (at > 0 and k - hits[at - 1][0] <= WINDOW) or (at + 1 < len(hits) and hits[at + 1][0] - k <= WINDOW)
        total += weight
        edited += weight if edits else 0.0
        quoted += weight if inside or reported else 0.0
        dense += weight if company else 0.0
        top = max(top, weight)
    return [math.log1p(total), math.log1p(edited), math.log1p(quoted), math.log1p(dense), top, len(hits) / (len(words) + 1) * 10]


@dataclass
class Model:
    """Terms with their weights, exact and misspelled, and the logistic model over the window sums."""

    weights: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=lambda: [0.0] * 6)
    bias: float = -20.0
    _matcher: Matcher | None = field(default=None, repr=False, compare=False)

    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(self.weights, self.fuzzy)
        return self._matcher

    def sums(self, text: str | None) -> list[float]:
        words = tokens(text)
        return window_sums(words, self.matcher().hits(words))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(c * x for c, x in zip(self.coef, self.sums(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: Column | str) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows that are not held out; an id labelled both ways is toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).dropDuplicates([id_col]).select("text", "toxic")


def _log_odds(a: float, c: float, toxic: float, clean: float) -> tuple[float, float]:
    """Smoothed log odds ratio of a term and its standard error."""
    return math.log((a + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)), math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled rows; what reaches the driver is bounded by that and by ``MAX_TERMS``.

    Without toxic or without clean rows the model has no terms; the score is then the smoothed share of toxic rows.
    """
    sample, path = stage(training_sample(docs, labels, id_col, text_col, rows), "toxic-sample")
    counts = {bool(r.toxic): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        discard(sample, path)
        return Model(bias=math.log((toxic + 0.01) / (clean + 0.01)) if toxic + clean else -20.0)

    @F.arrow_udf("array<string>")
    def terms(column: pa.Array) -> pa.Array:
        return pa.array([terms_of(t.as_py()) for t in column], pa.list_(pa.string()))

    seen = sample.select((F.col("toxic") > 0).cast("int").alias("t"), F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("c"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    chosen = seen.where(z >= SURE).orderBy(z.desc(), "term").limit(MAX_TERMS).select("term", odds.alias("w")).collect()
    model = Model(weights={r.term: r.w for r in chosen})
    model.fuzzy = _fuzzy_weights(sample, model, toxic, clean)
    model.coef, model.bias = _logistic(sample, model)
    discard(sample, path)
    return model


def _fuzzy_weights(sample: DataFrame, model: Model, toxic: int, clean: int) -> dict[str, float]:
    """Weight of each term's misspelled matches: half the term's own, corrected by what its misspellings mark in the sample."""
    probe = Model(weights=model.weights, fuzzy={t: w / 2 for t, w in model.weights.items()})

    @F.arrow_udf("array<string>")
    def edited(column: pa.Array) -> pa.Array:
        m = probe.matcher()
        return pa.array([sorted({h[2] for h in m.hits(tokens(t.as_py())) if h[3]}) for t in column], pa.list_(pa.string()))

    found = sample.select((F.col("toxic") > 0).cast("int").alias("t"), F.explode(edited(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("c")).collect()  # a row per term at most
    out = dict(probe.fuzzy)
    for r in found:
        odds, error = _log_odds(r.a, r.c, toxic, clean)
        prior = out[r.term]
        out[r.term] = max(0.0, min(prior, (odds / error**2 + prior) / (1 / error**2 + 1)) if r.c else prior)
    return out


def _logistic(sample: DataFrame, model: Model, ridge: float = 0.1, rounds: int = 30) -> tuple[list[float], float]:
    @F.arrow_udf("array<double>")
    def sums(column: pa.Array) -> pa.Array:
        return pa.array([model.sums(t.as_py()) for t in column], pa.list_(pa.float64()))

    rows = sample.select((F.col("toxic") > 0).cast("int").alias("t"), sums(F.col("text")).alias("x")).collect()
    x = np.array([[1.0, *r.x] for r in rows])
    y = np.array([r.t for r in rows], float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    x, y = x[order], y[order]
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[1:].tolist(), float(w[0])


def toxicity(text: Column | str, model: Model) -> Column:
    """Score of ``text`` between 0 and 1; null and empty texts get the score of a text without hits. Whole texts are read."""
    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in column], pa.float64())

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, score, predicted) per row of ``docs``; only the id and the text are read.

    Repeated rows score alike, null ids keep their row and are never held out, an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), toxicity(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
