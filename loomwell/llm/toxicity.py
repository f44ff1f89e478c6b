"""Toxicity scores from a lexicon, Levenshtein automata and context windows.

Lexicon: terms are mined from labelled training rows.  Words and word beginnings (stems) that
many toxic texts share and clean ones hardly ever have are ranked by support; a term that a
chosen stem covers is left out.  A term must stand in SHARE of the toxic training texts, so the
bounded sample bounds the candidates too (1 / SHARE times the terms of a mean text); none is cut off.

Matching: a trie holds the terms.  For each distinct word a Levenshtein automaton of that word
(bit-parallel, states are sets of positions for 0 and 1 edits) is run down the trie: a stem
matches if it begins the word, a term matches misspelled within one edit (terms of FUZZY_FROM
letters or more).  A word can match misspelled only if it starts with a term's first half or ends
with its second half, which is tested first.

Context: each hit has a window of WINDOW words on either side and from it a score of quotation, 0
to 1: marks that open before and close after the hit (MARKED), a word of report before it
(REPORTED), both as independent evidence; a word of address next to the hit takes ADDRESSED of the
reported part back.  A hit counts with its weight times one minus that score in every feature, so
quoted terms alone leave a text clean while the same terms as abuse do not.  These three figures are
set, not fitted: the labelled tables hold no quotations to learn them from.

Score: logistic regression over the sum of exact and misspelled weights, the density of hits and
the number of terms.  It is fitted on at most TRAIN_TOXIC + TRAIN_CLEAN labelled
rows (the documented bound), drawn by a hash of doc_id from the training rows.  A misspelled hit
weighs the log odds that its term's misspellings had in training, so harmless look-alikes fade.

Scores use the text only.  Null or empty texts get the score of a text without hits.  Labels:
several for one doc_id count as toxic if one is; a null label is ignored.  If one class has no
training row, all scores are 0 (no toxic row) or 1 (no clean row).  Repeated rows are scored
again; an empty table gives an empty result; extra columns are ignored by score().
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed

TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
SUPPORT, SHARE = 4, 0.01
MARKED, REPORTED, ADDRESSED = 0.95, 0.35, 0.5
STEM_FROM, STEM_TO = 4, 9
FUZZY_FROM = 5
WINDOW = 8
MEMO = 500_000
FOLDS, HELD_OUT = 5, 0

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# Marks and words of quotation.
OPEN, SHUT = "\"“„«‹‘", "\"”“»›’"
ADDRESS = set("you your you're youre u ur du dein deine dich dir ihr tu te ton ta toi vous votre tú usted eres".split())
REPORT = set("said says wrote writes quote quoted quotes called reported reports claimed dit écrit cité sagte schrieb zitat dijo escribió cita".split())


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT


# --- lexicon trie and Levenshtein automaton --------------------------------------------------


class Trie:
    """Terms; each may be a stem."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.terms = terms
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
        fuzzy = [t for t in terms if len(t) >= FUZZY_FROM]
        self.heads = tuple(sorted({t[: len(t) // 2] for t in fuzzy}))
        self.tails = tuple(sorted({t[len(t) // 2 :] for t in fuzzy}))
        self.sizes = {len(t) + d for t in fuzzy for d in (-1, 0, 1)}
        self.starts = tuple(terms)

    def match(self, word: str) -> tuple[int, bool] | None:
        """(term, misspelled) of the best match."""
        if word.startswith(self.starts):
            node, best = self.root, None
            for c in word:
                node = node.get(c)
                if node is None:
                    break
                best = node.get("", best)
            return best, False
        if len(word) in self.sizes and (word.startswith(self.heads) or word.endswith(self.tails)):
            found = self.near(word)
            if found is not None:
                return found, True
        return None

    def near(self, word: str) -> int | None:
        """The first term within one edit of the whole word: automaton of the word x trie."""
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        whole = (1 << n + 1) - 1
        found = []

        def walk(node, r0, r1, depth):
            # r0, r1: positions of the word reachable with no edit, with one edit or none
            end = node.get("")
            if end is not None and depth >= FUZZY_FROM and (r1 | r0) >> n & 1:
                found.append(end)
            if depth > n:
                return
            for c, below in node.items():
                if c:
                    same = at.get(c, 0)
                    s0 = (r0 & same) << 1
                    s1 = (r1 & same) << 1 | r0 | r0 << 1 | s0 << 1 | s0
                    if (s0 | s1) & whole:
                        walk(below, s0 & whole, s1 & whole, depth + 1)

        walk(self.root, 1, 3, 0)
        return min(found) if found else None


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)  # of an exact hit
    fuzzy: list[float] = field(default_factory=list)  # of a misspelled hit
    coef: list[float] = field(default_factory=list)
    constant: float | None = None


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.trie = Trie(model.terms)
        self.seen: set[str] = set()  # words tried; those that matched are in known
        self.known: dict[str, tuple[int, bool]] = {}

    def hits(self, text: str) -> list[tuple[int, bool, float]]:
        """(term, misspelled, quotation score) of each hit."""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        for w in distinct - self.seen:
            m = self.trie.match(w)
            if m is not None:
                self.known[w] = m
        if len(self.seen) > MEMO:
            self.seen, self.known = set(), {w: self.known[w] for w in distinct if w in self.known}
        self.seen |= distinct
        self.words = len(words)
        found = self.known
        if distinct.isdisjoint(found):
            return []
        spans = [m for m in WORD.finditer(low)]
        out = []
        for i, m in enumerate(spans):
            hit = found.get(m.group())
            if hit is not None:
                left = low[spans[max(0, i - WINDOW)].start() : m.start()]
                right = low[m.end() : spans[min(len(spans) - 1, i + WINDOW)].end() + 1]
                before = [x.group() for x in spans[max(0, i - WINDOW) : i]]
                after = spans[i + 1].group() if i + 1 < len(spans) else ""
                out.append((*hit, self.quotation(left, right, before, after)))
        return out

    @staticmethod
    def quotation(left: str, right: str, before: list[str], after: str) -> float:
        """How far the window reads as a quotation rather than as an attack, 0 to 1."""
        straight = left.count('"') % 2 == 1 and '"' in right
        paired = any(left.rfind(a) > left.rfind(b) and b in right for a, b in zip(OPEN[1:], SHUT[1:]))
        marked = MARKED if straight or paired else 0.0
        reported = REPORTED if not REPORT.isdisjoint(before) else 0.0
        if after in ADDRESS or not ADDRESS.isdisjoint(before[-2:]):
            reported *= 1 - ADDRESSED
        return 1 - (1 - marked) * (1 - reported)

    def features(self, text: str) -> list[float]:
        hits = self.hits(text)
        m = self.model
        exact = sum(m.weight[t] * (1 - q) for t, bad, q in hits if not bad)
        fuzzy = sum((m.fuzzy[t] if m.fuzzy else 1.0) * (1 - q) for t, bad, q in hits if bad)
        often = sum(1 - q for _, bad, q in hits if not bad)
        terms: dict[int, float] = {}
        for t, bad, q in hits:
            if not bad:
                terms[t] = max(terms.get(t, 0.0), 1 - q)
        return [math.log1p(exact + max(0.0, fuzzy)), math.log1p(100 * often / max(1, self.words)), sum(terms.values())]

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        z = self.model.coef[0] + sum(c * x for c, x in zip(self.model.coef[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- training ---------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): distinct texts of the bounded sample of training rows, one of near copies."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.filter(~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id")
    some = marked.filter("toxic = 1").orderBy(draw).limit(TRAIN_TOXIC).union(marked.filter("toxic = 0").orderBy(draw).limit(TRAIN_CLEAN))
    # the sample holds TRAIN_TOXIC + TRAIN_CLEAN rows at most: broadcast
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    # one text of near copies: else words that only copies share would look like terms
    for seed in range(2):
        cut_up = rows.withColumn("w", F.split("text", r"\s+"))
        at = F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)))
        least = F.array_min(F.transform(at, lambda i: F.xxhash64(F.lit(seed), *[F.get("w", i + j) for j in range(3)])))
        rows = cut_up.groupBy(least.alias("h"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    return rows


def _terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    out = {w for w in words if STEM_FROM <= len(w) <= 24}
    for n in range(STEM_FROM, STEM_TO + 1):
        out |= {w[:n] for w in words if len(w) > n}
    return out


def _count_terms(only: set | None):
    def run(batches):
        counts: dict = {}
        for part in slices(batches, 256):
            for text in part.column(0).to_pylist():
                found = _terms_of(text)
                for t in found if only is None else found & only:
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """Terms (with weights) from (term, toxic texts, clean texts)."""
    rated = []
    for term, pos, neg in counts:
        odds = math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))
        if odds > math.log(8):
            rated.append((pos, len(term), term, odds))
    rated.sort(key=lambda r: (-r[0], -r[1], r[2]))
    taken: dict[str, tuple[int, float]] = {}
    for pos, _, term, odds in rated:
        if any(term[:n] in taken for n in range(1, len(term) + 1)):
            continue  # a stem covers it
        if any(t.startswith(term) and pos <= 1.1 * p for t, (p, _) in taken.items()):
            continue  # a mere beginning of a term
        taken[term] = (pos, odds)
    return list(taken), [o for _, o in taken.values()]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps; the intercept is free, weights shrink to zero.  No feature speaks for a
    clean text, so one whose weight comes out negative is left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, use], y, ridge)
        if all(v >= 0 for v in w[1:]):
            break
        del use[int(np.argmin(w[1:]))]
    out = [0.0] * (x.shape[1] + 1)
    out[0] = w[0]
    for k, v in zip(use, w[1:]):
        out[k + 1] = v
    return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> list[float]:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    shrink = np.full(a.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + shrink * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return Model(constant=1.0 if toxic else 0.0)
        pos = rows.filter("toxic = 1").select("text").mapInArrow(trimmed(_count_terms(None)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        least = max(SUPPORT, math.ceil(SHARE * toxic))
        top = {r["term"]: r["n"] for r in pos.filter(F.col("n") >= least).collect()}  # bounded by the sample and SHARE
        neg = rows.filter("toxic = 0").select("text").mapInArrow(trimmed(_count_terms(set(top))), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        neg = {r["term"]: r["n"] for r in neg.collect()}  # no more rows than top has
        terms, weight = choose([(t, n, neg.get(t, 0)) for t, n in top.items()], toxic, clean)
        model = Model(terms, weight)

        def fuzzy(batches):
            scorer = Scorer(model)
            for part in slices(batches, 256):
                found = [(t, int(y)) for text, y in zip(*(c.to_pylist() for c in part.columns)) for t in {t for t, bad, _ in scorer.hits(text) if bad}]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([y for _, y in found], pa.int32())], ["term", "toxic"])

        seen = rows.select("text", "toxic").mapInArrow(trimmed(fuzzy), "term int, toxic int").groupBy("term").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
        # a misspelling never seen in training counts half of its term
        model.fuzzy = [w / 2 for w in weight]
        for r in seen:
            p, q = r["pos"], r["n"] - r["pos"]
            odds = math.log((p + 0.5) / (toxic + 1)) - math.log((q + 0.5) / (clean + 1))
            model.fuzzy[r["term"]] = max(0.0, min(weight[r["term"]], odds - 1)) if p + q >= 3 else max(0.0, odds) / 4

        def features(batches):
            scorer = Scorer(model)
            for part in slices(batches, 256):
                x = [scorer.features(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1)], ["x", "toxic"])

        sample = rows.select("text", "toxic").mapInArrow(trimmed(features), "x array<double>, toxic int").collect()  # bounded by the sample
        model.coef = fit_logistic(np.array([r["x"] for r in sample]), np.array([r["toxic"] for r in sample], float))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches):
            s = np.array([scorer.score(t or "") for t in part.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches):
            yield part.filter(pa.array([scorer.score(t or "") < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
