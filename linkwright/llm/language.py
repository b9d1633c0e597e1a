"""Language identification: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import save
from linkwright.llm.training import class_counts, only, sampled_by_class

#: Runs of letters and of other numbers than digits, such as fractions; LETTERS takes the latter apart.
RUNS = re.compile(r"[^\W\d_]+").findall
LETTERS = regex.compile(r"\p{L}+").findall
ROWS = 256


def split(text: str) -> list[str]:
    """Lower-case runs of letters, which are the characters of Unicode's categories L."""
    found = RUNS(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found for w in LETTERS(x)]


def grams(word: str, longest: int) -> Iterator[str]:
    """The n-grams of a word between spaces, of one to `longest` characters."""
    padded = f" {word} "
    for size in range(1, longest + 1):
        for k in range(len(padded) - size + 1):
            yield padded[k : k + size]


class Model:
    """Log frequencies by language of known words and of the n-grams of their letters.

    A word that training has not seen often enough is scored by its letters: at each of them by the longest n-gram
    ending there that is known, of `longest` characters down to one.
    """

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]], longest: int = 4, most: int = 300_000):
        """words and grams: (language, word or n-gram, count)."""
        self.languages = sorted({lang for lang, _, _ in words} | {lang for lang, _, _ in grams})
        self.longest, self.most = longest, most
        self.words, self.word_logs = self._logs(words, 0.5)
        # an n-gram's share is among those of its size
        sizes = [self._logs([g for g in grams if len(g[1]) == size], 0.1) for size in range(1, longest + 1)]
        self.grams, self.gram_logs = {}, np.concatenate([logs for _, logs in sizes])
        for at, _ in sizes:
            self.grams |= {g: k + len(self.grams) for g, k in at.items()}
        self.forget()

    def _logs(self, counts: list[tuple[str, str, int]], more: float) -> tuple[dict[str, int], np.ndarray]:
        """(the row of each word, log frequencies by language)."""
        at = {lang: k for k, lang in enumerate(self.languages)}
        rows: dict[str, int] = {}
        table = np.full((len({w for _, w, _ in counts}), len(at)), more)
        for lang, word, n in counts:
            table[rows.setdefault(word, len(rows)), at[lang]] += n
        return rows, np.log(table / table.sum(axis=0)).astype(np.float32) if len(rows) else table.astype(np.float32)

    def forget(self) -> None:
        """Drop what was found out about single words."""
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))

    def _letters(self, word: str) -> np.ndarray:
        padded, known, found = f" {word} ", self.grams, []
        for end in range(2, len(padded) + 1):
            for size in range(min(self.longest, end), 0, -1):
                x = known.get(padded[end - size : end])
                if x is not None:
                    found.append(x)
                    break
        if not found:
            return np.zeros(len(self.languages))
        x = self.gram_logs[found].astype(float)
        return (x - x.max(axis=1, keepdims=True)).sum(axis=0)

    def _row(self, word: str) -> int:
        known = self.words.get(word)
        k = len(self.rows)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.word_logs[known] - self.word_logs[known].max() if known is not None else self._letters(word)
        self.rows[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihood; `und` and 0 if the text has no letter or nothing is learned."""
        counts = Counter(split(text or ""))
        if not counts or not self.languages:
            return "und", 0.0
        if len(self.rows) + len(counts) > self.most:
            self.rows.clear()
        rows = list(map(self.rows.get, counts))
        if None in rows:
            rows = [self._row(w) if r is None else r for w, r in zip(counts, rows)]
        total = np.fromiter(counts.values(), dtype=float, count=len(counts)) @ self.table[rows]
        share = np.exp(np.maximum(total - total.max(), -700))
        best = int(total.argmax())
        return self.languages[best], float(share[best] / share.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = 12_000, longest: int = 4, known: int = 3) -> Model:
    """A model from the rows of docs whose language and text are not null: of each language a sample by a hash of id and
    text, together about most_docs, rare languages whole. All words and n-grams that the sample has `known` times count;
    an n-gram is counted once for each occurrence of its word. Repeated rows count once."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("kind"), F.col(f"`{text_col}`").alias("text"))
    counts = save(class_counts(sampled_by_class(rows, most_docs), split, once=False), "word-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "word", "n"))):
                for g in grams(word, longest):
                    found[kind, g] += n
            kinds, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["kind", "word", "n"])

    pieces = counts.mapInArrow(run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    tables = []
    for table in (counts, save(pieces, "gram-counts")):
        often = table.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= known).select("word")
        tables.append([tuple(r) for r in table.join(often, "word").select("kind", "word", "n").collect()])
    return Model(*(sorted(t) for t in tables), longest)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, lang_pred and score. Null texts and those without a letter are `und`.

    Every whole text is read, one by one; repeated rows get equal rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = only(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [held.predict(t.as_py()) for t in part.column("text")]
                langs, scores = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
