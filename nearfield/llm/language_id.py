"""Language ID by word-first backoff.

A known word scores by its logarithmic frequency in each language. An unseen word falls back to its
longest known character n-grams, and then to shorter ones.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import bound_batches, documents

#: The model is fitted on about this many labelled documents at most, chosen by a hash of their ids.
SAMPLE = 10_000
LONGEST = 5
UNKNOWN = "und"
#: Runs of letters, Unicode's categories L: what ``\w`` has besides letters is digits, other numbers, and the underscore. The pattern that leaves out other numbers is slow and serves texts that have some.
_NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
LETTERS = re.compile(rf"[^\W\d_{''.join(sorted(_NUMBERS))}]+")
_FAST_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a whole text, in lower case."""
    text = text.lower() if text else ""
    return (_FAST_LETTERS if text.isascii() or _NUMBERS.isdisjoint(text) else LETTERS).findall(text)


#: Words that a Python worker remembers the scores of.
REMEMBERED = 300_000


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of the words of a partition."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text.as_py()))
    for lang, counts in words.items():
        keys, values = list(counts), list(counts.values())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "word": some, "n": pa.array(values[i : i + 50_000], pa.int64())})


def _word_grams(words: DataFrame) -> DataFrame:
    """``kind, gram, lang, n`` from ``lang, word, n``: words are kind 0, n-grams their length."""
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(marked) - k + 1), lambda i: F.struct(F.lit(k).alias("kind"), F.substr(marked, i, F.lit(k)).alias("gram")))
    none = F.array().cast("array<struct<kind:int,gram:string>>")
    grams = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("word").alias("gram"))), *[F.when(F.length(marked) >= k, of(k)).otherwise(none) for k in range(1, LONGEST + 1)])
    return words.select("lang", F.explode(grams).alias("g"), "n").groupBy("g.kind", "g.gram", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Logarithmic frequencies by language of words and n-grams: for each kind the row of ``rows`` that a word or n-gram has."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], rows: np.ndarray):
        self.langs, self.tables, self.rows = langs, tables, rows

    def score(self, word: str) -> np.ndarray:
        if (known := self.tables[0].get(word)) is not None:
            return self.rows[known]
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            found = [table[g] for g in _grams(word, n) if g in table]
            if found:
                return self.rows[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit a model on ``labelled(doc_id, text, lang)``; rows without text or lang are left out.

    Whole texts of about ``sample`` rows at most are counted, chosen by a hash of doc_id. Every word
    and n-gram of theirs is kept, so what the driver holds is bounded by the sample and by nothing else.
    The texts are read once. Without any labelled row the model knows no language.
    """
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    share = min(1.0, sample / max(1, labelled.select("doc_id", "lang").count()))
    chosen = labelled.filter((F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)) & F.col("text").isNotNull())
    words = chosen.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = _word_grams(words).toArrow()
    langs = sorted(got.column("lang").unique().to_pylist())
    kind, n = got.column("kind").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    lang = np.searchsorted(np.array(langs, dtype=object), np.array(got.column("lang").to_pylist(), dtype=object)) if langs else np.zeros(0, np.int64)
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    row, size = np.zeros(len(kind), np.int64), 0
    for i, (k, gram) in enumerate(zip(kind.tolist(), got.column("gram").to_pylist(), strict=True)):
        at = tables[k].setdefault(gram, size)
        row[i] = at
        size += at == size
    counts, kinds, totals = np.full((size, len(langs)), 0.5), np.zeros(size, np.int64), np.ones((LONGEST + 1, len(langs)))
    np.add.at(counts, (row, lang), n)
    kinds[row] = kind
    np.add.at(totals, (kind, lang), n)
    return Model(langs, tables, np.log(counts / totals[kinds]).astype(np.float32))


class _Scores(dict):
    """Row of ``rows`` that holds a word's scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((REMEMBERED, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.rows[at] = self.model.score(word)
        self[word] = at
        return at

    def total(self, words: list[str]) -> np.ndarray:
        sums = np.zeros(len(self.model.langs))
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            if len(self) + len(some) > REMEMBERED:
                self.clear()
            sums += self.rows[np.fromiter(map(self.__getitem__, some), np.int64, len(some))].sum(axis=0, dtype=np.float64)
        return sums


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs(doc_id, text)``.

    ``score`` is the posterior of the best language, from the mean over the words when they are many.
    A text that is null or has no letters gives ``und`` and 0, as does a model without languages. Ties go to
    the first language by name. Null and repeated ids are rows like others; an empty table gives no rows;
    other columns are ignored. Every word of a very long text counts, in time linear in their number.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        scores = _Scores(known) if known.langs else None
        for batch in batches:
            langs, best = [], []
            for text in batch.column(1):
                words = words_of(text.as_py()) if scores is not None else ()
                if not words:
                    langs.append(UNKNOWN)
                    best.append(0.0)
                    continue
                sums = scores.total(words)
                sums = sums * min(1.0, 50 / len(words))
                odds = np.exp(sums - sums.max())
                at = int(odds.argmax())
                langs.append(known.langs[at])
                best.append(float(odds[at] / odds.sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(best, pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, by a model of those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
