"""Operator 5, language ID: word-first backoff.

A word seen in training scores every language by the word's log frequency there. An unseen word falls back to its
character n-grams, longest first: the first length of which some n-gram is known scores the word. A text of which nothing
is known gets the language of most training rows, its share there as score.

Cases: a null text, or one without a letter, is ``und`` with score 0; with no training rows everything is ``und``;
repeated rows get equal results; an empty table gives an empty table; a very long text is scored whole, with a number a
word in memory; other columns are not read in prediction, and of training rows with a null lang or text nothing is learned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import flat_map_rows, map_batches, map_rows

WORD = 0
EDGE = "\x02"
STRIP = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡*#%&$|/\\+=~_-"


@dataclass(frozen=True)
class LanguageParameters:
    """docs_per_language bounds the training sample. Of each language, its most frequent words and n-grams of each length are kept.

    With so many languages that those are more than ``model_rows`` in all, every language and length keeps an equal smaller share.
    """

    docs_per_language: int = 1500
    words: int = 20_000
    grams: int = 8_000
    model_rows: int = 500_000
    longest: int = 5
    unseen: float = 0.2
    sharpness: float = 12.0


def word_counts(text: str | None) -> Counter:
    """Lower-case words with a letter, bare of punctuation."""
    out: Counter = Counter()
    for raw, n in Counter((text or "").lower().split()).items():
        w = raw.strip(STRIP)
        if w and any(map(str.isalpha, w)):
            out[w] += n
    return out


def grams(word: str, size: int) -> list[str]:
    edged = f"{EDGE}{word}{EDGE}"
    return [edged[i : i + size] for i in range(len(edged) - size + 1)]


class LanguageModel:
    """Log frequencies by language of words (length 0) and of character n-grams of each length."""

    def __init__(self, grams: pa.Table | None = None, priors: dict[str, int] | None = None, p: LanguageParameters = LanguageParameters()):
        """``grams`` has the columns lang, kind, gram, n and total (that of the language and kind); priors count training rows."""
        self.p, self.priors = p, priors or {}
        columns = [grams[c].to_pylist() for c in ("lang", "kind", "gram", "n", "total")] if grams is not None else [[]] * 5
        langs, kinds, names, counts, sums = columns
        self.languages = sorted(self.priors)
        place = {x: i for i, x in enumerate(self.languages)}
        self.table: list[dict[str, int]] = [{} for _ in range(p.longest + 1)]
        rows = [self.table[k].setdefault(g, sum(map(len, self.table))) for k, g in zip(kinds, names, strict=True)]
        have = np.zeros((max(rows, default=-1) + 1, len(place)), np.float32)
        where = np.array([place[x] for x in langs], np.int64)
        have[rows, where] = counts
        kind_of = np.zeros(len(have), np.int64)
        kind_of[rows] = kinds
        totals = np.ones((p.longest + 1, len(place)))
        totals[kinds, where] = sums
        floor = np.log(p.unseen / totals)
        self.scores = (floor[kind_of] + np.log1p(have / p.unseen)).astype(np.float32)

    def hits(self, w: str) -> list[int]:
        """Rows of scores of an unseen word's known n-grams, of the greatest length that has any."""
        edged = f"{EDGE}{w}{EDGE}"
        for size in range(self.p.longest, 0, -1):
            known = self.table[size].get
            if hits := [i for at in range(len(edged) - size + 1) if (i := known(edged[at : at + size])) is not None]:
                return hits
        return []


class Scorer(dict):
    """Words as they stand in a text, by the row of a matrix with their scores relative to the best language's.

    Row 0 is of words that tell nothing; the words of the model follow, then unseen ones as they come. The last column counts words.
    """

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.known = {w: i + 1 for i, w in enumerate(model.table[WORD])}
        scores = model.scores[list(model.table[WORD].values())]
        self.matrix = np.zeros((len(scores) + 4096, len(model.languages) + 1), np.float32)
        self.used = self.base = len(scores) + 1
        self.fill(1, scores)
        self.hits: list[int] = []
        self.sizes: list[int] = []

    def fill(self, start: int, scores: np.ndarray) -> None:
        if len(scores):
            self.matrix[start : start + len(scores), :-1] = scores - scores.max(axis=1, keepdims=True)
            self.matrix[start : start + len(scores), -1] = 1

    def __missing__(self, raw: str) -> int:
        w = raw.strip(STRIP)
        at = self.known.get(w, 0)
        if not at and any(map(str.isalpha, w)) and (hits := self.model.hits(w)):
            self.hits += hits
            self.sizes.append(len(hits))
            at, self.used = self.used, self.used + 1
        self[raw] = at
        return at

    def settle(self) -> None:
        """Give the unseen words that have come their rows: means over their n-grams."""
        ends = np.cumsum(self.sizes)
        means = np.add.reduceat(self.model.scores[self.hits], ends - self.sizes, axis=0) / np.array(self.sizes)[:, None]
        if self.used > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros((self.used, self.matrix.shape[1]), np.float32)])
        self.fill(self.used - len(means), means)
        self.hits, self.sizes = [], []

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most likelihood, and its posterior with evidence of at most ``sharpness`` words."""
        model = self.model
        if not text or not model.languages:
            return UNKNOWN
        if len(self) > MOST_HELD:
            self.clear()
            self.used = self.base
        tokens = text.lower().split()
        rows, times = np.unique(np.fromiter(map(self.__getitem__, tokens), np.intp, len(tokens)), return_counts=True)
        if self.sizes:
            self.settle()
        totals = times @ self.matrix[rows].astype(np.float64)
        n = totals[-1]
        if not n:
            if not any(map(str.isalpha, text)):
                return UNKNOWN
            best = max(model.languages, key=lambda x: (model.priors[x], x))
            return best, model.priors[best] / sum(model.priors.values())
        best = int(totals[:-1].argmax())
        apart = (totals[:-1] - totals[best]) * min(1.0, model.p.sharpness / n)
        return model.languages[best], 1.0 / float(np.exp(apart).sum())


UNKNOWN = ("und", 0.0)
#: Words that a task remembers the scores of.
MOST_HELD = 150_000


def fit(train: DataFrame, p: LanguageParameters = LanguageParameters()) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows: about ``docs_per_language`` of each language, chosen by a hash of doc_id.

    One row a language reaches the driver, and the model.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel(None, None, p)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, p.docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    sample = train.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    longest = p.longest

    def make():
        def count(lang, text):
            out: Counter = Counter()
            for w, n in word_counts(text).items():
                out[WORD, w] += n
                for size in range(1, longest + 1):
                    for g in grams(w, size):
                        out[size, g] += n
            return ((lang, kind, g, n) for (kind, g), n in out.items())

        return count

    counted = flat_map_rows(sample.select("lang", "text"), make, "lang string, kind int, gram string, n long")
    counted = counted.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    part = min(1.0, p.model_rows / (len(sizes) * (p.words + longest * p.grams)))
    most = F.when(F.col("kind") == WORD, max(1, int(p.words * part))).otherwise(max(1, int(p.grams * part)))
    own = Window.partitionBy("lang", "kind")
    ranked = counted.withColumn("total", F.sum("n").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "gram")))
    return LanguageModel(ranked.where(F.col("rank") <= most).drop("rank").toArrow(), sizes, p)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # model_rows bounds it

    def make():
        scorer = Scorer(shared.value)
        return lambda doc_id, text: (doc_id, *scorer.predict(text))

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def select_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """Whole rows whose text is in a learned language with a posterior of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def make():
        scorer = Scorer(shared.value)

        def keep(batch):
            found = map(scorer.predict, batch.column(text).to_pylist())
            return batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

        return keep

    return map_batches(docs, make)
