"""Language identification by word-first backoff.

A word seen in training scores each language by the logarithm of its relative frequency there. An
unseen word falls back to its character n-grams (padded with a space on both sides), the longest
length of which any n-gram is known, averaged; shorter lengths only if none is. A document scores
the mean over its words, and the language with the largest mean wins.

Training reads at most `max_docs` labelled rows (those of smallest hash of the id; a bound of the
operator), whole texts of them; the vocabulary keeps at most `max_entries` words and as many n-grams,
which bounds what is broadcast. Prediction covers every row.

Cases: null texts and texts without a letter give `und` with score 0; so does every text where there
is nothing to learn from. Ties go to the first language in alphabetical order. Rows with null text or
label don't teach. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts

UNDETERMINED = "und"
#: Runs of word characters; those that aren't letters (numerals such as ² and Ⅷ count as word characters) part them.
RUN = re.compile(r"[^\W\d_]+")
MAX_DOCS, MAX_ENTRIES, MAX_GRAM, MIN_COUNT, PENALTY = 8_000, 100_000, 5, 2, 7.0
#: The score is the winner's share when the mean log scores are weighed by at most so many words.
SCORE_WORDS = 20


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray  # a row for each word and n-gram: log10 relative frequency by language


def words_of(text: str | None) -> list[str]:
    """Words of letters, in lower case."""
    runs = RUN.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def sample_rows(df: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> DataFrame:
    """(label, text) of the labelled rows whose id's hash is among the max_docs smallest; ties on the last one all stay out."""
    rows = df.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(label_col).alias("label"), F.col(text_col).alias("text")
    ).filter("label IS NOT NULL AND text IS NOT NULL")
    smallest = [r[0] for r in rows.select("h").orderBy("h").limit(max_docs + 1).collect()]
    return rows.filter(F.col("h") < smallest[-1]) if len(smallest) > max_docs else rows


def count_words(rows: DataFrame) -> DataFrame:
    """(label, gram, n) for words in lower case."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > 500_000:
                yield _rows(counts)
                counts = {}
        yield _rows(counts)

    return rows.select("label", "text").mapInArrow(run, _SCHEMA).groupBy("label", "gram").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, max_gram: int) -> DataFrame:
    """(label, gram, n) for n-grams of the counted words, weighed by the words' counts."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for label, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts.setdefault(label, Counter())
                for size in range(1, max_gram + 1):
                    for gram in grams_of(word, size):
                        own[gram] += n
            yield _rows(counts)

    return words.mapInArrow(run, _SCHEMA).groupBy("label", "gram").agg(F.sum("n").alias("n"))


_SCHEMA = "label string, gram string, n long"


def _rows(counts: dict[str, Counter]) -> pa.RecordBatch:
    flat = [(label, gram, n) for label, own in counts.items() for gram, n in own.items()]
    columns = zip(*flat, strict=True) if flat else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)],
        names=["label", "gram", "n"],
    )


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *,
    max_docs: int = MAX_DOCS, max_entries: int = MAX_ENTRIES, max_gram: int = MAX_GRAM, min_count: int = MIN_COUNT,
) -> Model:
    words = cut(count_words(sample_rows(df, id_col, text_col, label_col, max_docs)))
    grams = cut(count_grams(words, max_gram))
    tables = []
    for counts in (words, grams):
        kept = (
            counts.groupBy("gram").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_count)
            .orderBy(F.desc("total"), "gram").limit(max_entries)
        )
        tables.append(counts.join(F.broadcast(kept), "gram").select("label", "gram", "n").toArrow().to_pydict())
    sizes = {n: {r["label"]: r["t"] for r in own} for n, own in _totals(words, grams, max_gram).items()}
    return build(tables[0], tables[1], sizes)


def _totals(words: DataFrame, grams: DataFrame, max_gram: int) -> dict[int, list]:
    """All counted occurrences by n-gram length (0: words) and language."""
    of_words = words.groupBy("label").agg(F.sum("n").alias("t")).withColumn("k", F.lit(0))
    of_grams = grams.groupBy("label", F.length("gram").alias("k")).agg(F.sum("n").alias("t"))
    found = of_words.unionByName(of_grams).collect()
    return {k: [r for r in found if r["k"] == k] for k in range(max_gram + 1)}


def build(words: dict, grams: dict, sizes: dict[int, dict[str, int]]) -> Model:
    languages = sorted(sizes.get(0, {}))
    column = {x: i for i, x in enumerate(languages)}
    model = Model(languages, {}, {}, np.zeros((0, len(languages))))
    rows: list[np.ndarray] = []
    for index, counted, is_word in ((model.words, words, True), (model.grams, grams, False)):
        for label, gram, n in zip(counted["label"], counted["gram"], counted["n"], strict=True):
            if gram not in index:
                index[gram] = len(rows)
                rows.append(np.full(len(languages), -PENALTY))
            total = sizes[0 if is_word else len(gram)][label]
            rows[index[gram]][column[label]] = max(-PENALTY, np.log10(n / total))
    if rows:
        model.scores = np.array(rows)
    return model


class Scorer:
    """Scores texts; keeps the vectors of up to `cache` unseen words."""

    def __init__(self, model: Model, max_gram: int = MAX_GRAM, cache: int = 200_000):
        self.model, self.max_gram, self.cache = model, max_gram, cache
        self.scores, self.index = model.scores, dict(model.words)
        self._reset()

    def _reset(self) -> None:
        self.scores = np.concatenate([self.model.scores, np.zeros((self.cache, len(self.model.languages)))])
        self.index, self.used = dict(self.model.words), len(self.model.scores)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(self.max_gram, len(word) + 2), 0, -1):
            if found := [i for g in grams_of(word, n) if (i := self.model.grams.get(g)) is not None]:
                return self.model.scores[found].mean(axis=0)
        return np.full(len(self.model.languages), -PENALTY)

    def row(self, word: str) -> int:
        self.scores[self.used] = self.unseen(word)
        self.index[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        counts = Counter(words)
        if self.used + len(counts) > len(self.scores):
            if len(counts) > self.cache:
                self.cache = len(counts)
            self._reset()
        get = self.index.get
        at = [i if (i := get(w)) is not None else self.row(w) for w in counts]
        weights = np.fromiter(counts.values(), dtype=float, count=len(counts))
        mean = weights @ self.scores[at] / len(words)
        best = int(np.argmax(np.round(mean, 12)))
        odds = 10.0 ** ((mean - mean[best]) * min(len(words), SCORE_WORDS))
        return self.model.languages[best], float(1 / odds.sum())


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_gram: int = MAX_GRAM) -> DataFrame:
    """(id, lang_pred, score) for every row of df; extra columns of df can be joined by the caller."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value, max_gram)

        def work(ids, texts):
            found = [scorer.predict(t) for t in texts]
            return {id_col: ids, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(df, id_col, text_col, start, fields)


def identify_rows(
    df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score",
    max_gram: int = MAX_GRAM,
) -> DataFrame:
    """df with the prediction and its score beside every row; the two names must be new to df."""
    if clash := {pred_col, score_col} & set(df.columns):
        raise ValueError(f"df already has {sorted(clash)}")
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(sent.value, max_gram)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            columns = [
                *batch.columns, pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, pred_col, score_col])

    added = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
