"""Toxicity: a learned lexicon, its misspellings, and the context of each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import save, small
from linkwright.llm.training import class_counts, only, sampled

WORDS = re.compile(r"\w+")
ROWS = 256
#: Lengths of the stems that a lexicon may have besides words.
STEMS = (4, 5, 6, 7, 8)
#: Marks of quotation, and words that report or address somebody.
QUOTES = "\"“”„«»‹›`"
REPORTS = frozenset("said says say wrote writes called quote quoted quotes word words term terms slur insult dit écrit mot dijo escribió palabra sagte schrieb wort".split())
ADDRESS = frozenset("you your you're u ur yourself tu toi vous tú usted du dich ihr".split())


def split(text: str) -> list[str]:
    """Lower-case words, and each one's stems with an asterisk."""
    words = set(WORDS.findall(text.lower()))
    return [*words, *{f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}]


class Automaton:
    """A trie of terms intersected with the Levenshtein automata of the words that are read.

    A state is a set of (trie node, errors so far); sets are made once, as words first lead to them, and numbered, so
    that reading a word costs a table look-up for each letter until no term is within reach. Terms that end with an
    asterisk match any word that begins with them, without errors; others within one error if they have at least
    `least` letters.
    """

    def __init__(self, terms: list[str], least: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.prefix, self.loose = [False], [False]
        for k, term in enumerate(terms):
            for loose in (False, True):
                if loose and (term.endswith("*") or len(term) < least):
                    continue
                node = self._child(0, "\0" if loose else "\1", loose)
                for c in term.rstrip("*"):
                    node = self._child(node, c, loose)
                self.ends[node], self.prefix[node] = k, term.endswith("*")
        self.sets: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.done: list[tuple[int, int] | None] = []
        roots = [n for n in (self.children[0].get("\1"), self.children[0].get("\0")) if n is not None]
        self.start = self._state({(n, 0) for n in roots})

    def _child(self, node: int, c: str, loose: bool) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            self.ends.append(None)
            self.prefix.append(False)
            self.loose.append(loose)
        return self.children[node][c]

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set, closed under leaving out a letter of the term; -1 for none."""
        pairs |= {(child, 1) for node, errors in pairs if self.loose[node] and not errors for child in self.children[node].values()}
        key = tuple(sorted(p for p in pairs if not (p[1] and (p[0], 0) in pairs)))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(errors, self.ends[node]) for node, errors in key if self.ends[node] is not None]
            stems = [(0, self.ends[node]) for node, _ in key if self.prefix[node]]
            self.found.append(min(ends, default=None))
            self.done.append(min(stems, default=None))
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, errors))
            if self.loose[node] and not errors:
                after.add((node, 1))
                after |= {(n, 1) for n in self.children[node].values()}
        to = self.step[state][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the nearest term, the first of equally near ones."""
        state, best = self.start, None
        for c in word:
            if state < 0:
                return best
            if self.done[state] is not None and (best is None or self.done[state] < best):
                best = self.done[state]
            to = self.step[state].get(c)
            state = self._next(state, c) if to is None else to
        if state < 0 or self.found[state] is None:
            return best
        return self.found[state] if best is None else min(best, self.found[state])


class Model:
    """Terms with their log odds, words that are near a term but known as clean, and the weights of the features."""

    def __init__(self, terms: dict[str, float], clean: set[str] = frozenset(), weights: list[float] | None = None, most: int = 100_000):
        self.terms, self.odds = list(terms), list(terms.values())
        self.clean, self.weights, self.most = clean, weights or [-4.0, 1.5, 0.5, -0.5, 0.5, 0.3], most
        self.automaton: Automaton | None = None
        self.seen: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "seen": {}}

    def forget(self) -> None:
        """Drop what was found out about single words."""
        self.automaton, self.seen = None, {}

    def _hits(self, words: set[str]) -> set[str]:
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        if len(self.seen) > self.most:
            self.seen.clear()
            self.automaton = Automaton(self.terms)
        for w in [w for w in words if w not in self.seen]:
            hit = self.automaton.match(w)
            self.seen[w] = None if hit is not None and hit[0] and w in self.clean else hit
        return {w for w in words if self.seen[w] is not None}

    def features(self, text: str | None, odds: list[float] | None = None) -> list[float]:
        """Of a whole text: log-scaled evidence from plain, misspelled and quoted hits, their variety and rate.

        odds replaces the terms' own.
        """
        odds = odds or self.odds
        low = (text or "").lower()
        if not self.terms or not low:
            return [0.0] * 5
        words = WORDS.findall(low)
        hits = self._hits(set(words))
        if not hits:
            return [0.0] * 5
        plain = loose = quoted = 0.0
        kinds, spans = set(), list(WORDS.finditer(low))
        for k, m in enumerate(spans):
            if m[0] not in hits:
                continue
            errors, term = self.seen[m[0]]
            kinds.add(term)
            if quotation(low, spans, k) > 0:
                quoted += odds[term]
            elif errors:
                loose += odds[term]
            else:
                plain += odds[term]
        return [log1p(plain), log1p(loose), log1p(quoted), log1p(len(kinds)), log1p(1000 * (plain + loose) / len(words))]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + exp(-max(-500.0, min(500.0, z))))


def quotation(low: str, spans: list[re.Match], k: int, window: int = 6) -> float:
    """How far the context of word k speaks for quotation (positive) or abuse: marks right before and after it within
    a few words, words that report, words that address somebody."""
    first, last = spans[max(0, k - window)], spans[min(len(spans) - 1, k + window)]
    before, after = low[first.start() : spans[k].start()], low[spans[k].end() : last.end() + 2]
    marked = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
    around = {spans[j][0] for j in range(max(0, k - window), min(len(spans), k + window + 1)) if j != k}
    return 1.5 * marked + len(around & REPORTS) - 0.75 * len(around & ADDRESS) - 1


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> list[float]:
    """Weights of a logistic regression, intercept first, by Newton steps."""
    one = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(one.shape[1]), np.diag([1e-3, *[decay] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        move = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + keep, one.T @ (y - p) - keep @ w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w.tolist()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = 20_000, support: int = 3
) -> Model:
    """A model from labelled rows: a sample of about most_docs of them by a hash of the id.

    Toxic and other rows are sampled apart, about half of most_docs each, or more if there are fewer of the other kind; the
    intercept is corrected to the shares among all rows.
    A term is a word or stem that at least `support` toxic texts have, and whose smoothed log odds are above 1 by two
    standard errors; it weighs its log odds less one standard error, and for the regression a text's own count is left out.
    Of copies and near copies, told by the least hash of their shingles, one counts. Null labels are left out.
    Texts with contradicting labels count for both. Without toxic and other texts the model has no terms.
    """
    rows = labels.where(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("kind")).distinct()
    chosen, skew = _balanced(rows, most_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    found = save(_keyed(texts.join(small(save(chosen, "sampled-labels")), "doc_id")).dropDuplicates(["kind", "key"]), "labelled")
    totals = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model({}, weights=[log((bad + 0.5) / (good + 0.5)) - skew, 0, 0, 0, 0, 0])
    counts = class_counts(found, split, once=True).groupBy("word").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("good"))
    counts = save(counts, "term-counts")
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    terms = counts.where(f"bad >= {support}").withColumn("low", odds - error).where(F.col("low") - error > 1.0)
    chosen_terms = terms.orderBy(F.desc("low"), "word").collect()
    model = Model({r["word"]: min(r["low"], 8.0) for r in chosen_terms})
    if not model.terms:
        return Model({}, weights=[log(bad / good) - skew, 0, 0, 0, 0, 0])
    model.clean = _near_but_clean(counts, model)
    others = [[_weight(r["bad"] - kind, r["good"] - (not kind and r["good"] > 0), bad, good) for r in chosen_terms] for kind in (0, 1)]
    x = _features(found, model, others)
    model.weights = fit(np.array([r[1:] for r in x], dtype=float), np.array([r[0] for r in x], dtype=float))
    model.weights[0] -= skew
    return model


def _balanced(rows: DataFrame, most: int) -> tuple[DataFrame, float]:
    """About `most` rows at most, and by how much the log odds of a toxic row are higher in them than in all rows."""
    toxic, other = rows.where("kind = 1"), rows.where("kind <> 1")
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("kind") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    most_bad = max(most // 2, most - good)
    most_good = most - min(bad, most_bad)
    chosen = sampled(toxic, most_bad, F.col("doc_id")).union(sampled(other, most_good, F.col("doc_id")))
    return chosen, log(min(1, most_bad / max(1, bad))) - log(min(1, most_good / max(1, good)))


def _weight(with_bad: int, with_good: int, bad: int, good: int) -> float:
    """A term's smoothed log odds less their standard error, 0 to 8."""
    odds = log((with_bad + 0.5) / (bad + 1)) - log((with_good + 0.5) / (good + 1))
    return max(0.0, min(8.0, odds - sqrt(1 / (with_bad + 0.5) + 1 / (with_good + 0.5))))


def _keyed(texts: DataFrame) -> DataFrame:
    """(kind, text, key): the least XXH64 of a text's runs of five words, which near copies mostly share."""

    def key(text: str) -> int:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        return min(xxhash.xxh64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("text"), keys], ["kind", "text", "key"])

    return texts.select("kind", "text").mapInArrow(run, "kind int, text string, key long")


def _near_but_clean(counts: DataFrame, model: Model) -> set[str]:
    """Words of clean texts within an error of a term: they are no misspellings. At most the sample's vocabulary."""
    shipped = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shipped.value.terms)
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if (hit := automaton.match(w)) is not None and hit[0]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    return {r["word"] for r in counts.where("good > bad and not endswith(word, '*')").select("word").mapInArrow(run, "word string").collect()}


def _features(found: DataFrame, model: Model, odds: list[list[float]]) -> list:
    """(kind, features) of the sample, by the odds for each kind."""
    shipped = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = only(shipped.value)
        for batch in batches:
            x = [held.features(t.as_py(), odds[k.as_py() == 1]) for k, t in zip(batch.column("kind"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), *(pa.array([r[k] for r in x], pa.float64()) for k in range(5))], ["kind", *"abcde"])

    return found.select("kind", "text").mapInArrow(run, "kind int, a double, b double, c double, d double, e double").collect()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: its id and score, 0 to 1; with carry also `row`, a struct of its columns.

    Whole texts are read, one by one. Null and empty texts get the score of a text without hits.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = only(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names = [n for n in part.schema.names if n != "text"]
                scores = pa.array([held.score(t.as_py()) for t in part.column("text")], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), scores], [*names, "score"])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *row, F.col(f"`{text_col}`").cast("string").alias("text"))
    return df.mapInArrow(run, df.drop("text").schema.add("score", "double", False))
