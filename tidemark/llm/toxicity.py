"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give the words of a text probabilities by their continuation counts: a word counts
as often as it follows different words, and no more than once for a document, so that passages that are copied by heart are one
witness. From a count k, the discount min(k, DISCOUNT sqrt k), about what chance adds to it, goes to a backoff distribution that both
classes share, by the continuations that both have (and half a one for every word, and for all unknown words together). A rare
expression is thus smoothed towards what the classes have in common; none is left out.

A text's evidence is the sum over its different words of log p(word | toxic) - log p(word | ordinary). The classes of a sample differ in
their shares of languages and subjects, which tilts all words of one; a word's level is the mean evidence per word of the ordinary documents
that have it and that the models have not seen, and the mean level of a text's words is taken off each of them. What is left is divided by
the square root of their number, as the noise of a sum grows like that. A logistic map from this margin to the score is fitted on
documents that the models have not seen. Nothing but the text is an input of a score.

The sample is at most about `rows_per_class` labelled documents of each class, chosen by a hash of the id. The models are fitted on
the same number of both classes, three quarters of the smaller class's sample; the rest gives the levels and the logistic map.

Defined results: an empty or null text, and one without words, has margin 0; labels that are null teach nothing; without
rows of both classes every score is 0; a class whose documents have no words has the shared distribution; repeated rows give a row each;
of a document that has several labels, the largest counts; an input column `score` is replaced. A text takes the memory of its different words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, table
from tidemark.llm.packed import portions

#: Documents of a class that the sample has (expected number; texts are used whole).
ROWS_PER_CLASS = 4_000
DISCOUNT = 2.0
#: Of the models' sample, one row in so many is held for the levels and the logistic map.
HELD = 4
#: Documents of a word beyond which its level weighs no more.
LEVEL_DOCS = 50
#: Means are added up as integers, so that their order doesn't matter.
_UNIT = 1 << 40
RIDGE = 1e-4
PIECE = 1 << 20
_WORD = re.compile(r"\w+")
_BLANK = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, min(len(text), start + PIECE)) if len(text) - start > PIECE else None
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


def tokens(text: str | None) -> Iterator[list[str]]:
    """Lower-cased words of a text, piece by piece."""
    for piece in pieces(text or ""):
        yield _WORD.findall(piece.lower())


def distinct_words(text: str | None) -> set[str]:
    out: set[str] = set()
    for found in tokens(text):
        out.update(found)
    return out


class KneserNey:
    """The two models, as differences of log probabilities; levels of words; the logistic map.

    counts: word -> continuations in ordinary and in toxic documents.
    """

    def __init__(self, counts: dict[str, tuple[int, int]]):
        n = [sum(x[c] for x in counts.values()) for c in (0, 1)]
        self.shared_total = sum(min(x) + 0.5 for x in counts.values()) + 0.5
        self.sizes = n
        self.weight = [sum(self.discount(x[c]) for x in counts.values()) / n[c] if n[c] else 1.0 for c in (0, 1)]
        #: What an unknown word says; a word whose counts go to the backoff as a whole says the same, and is not stored.
        self.unknown = math.log(self.weight[1]) - math.log(self.weight[0])
        own = {w: x for w, x in counts.items() if max(x) > self.discount(max(x))}
        self.word = {w: math.log(self.probability(1, x)) - math.log(self.probability(0, x)) for w, x in own.items()}
        self.level: dict[str, tuple[float, int]] = {}
        self.mean = 0.0
        self.slope, self.start = 1.0, 0.0

    @staticmethod
    def discount(k: int) -> float:
        return min(k, DISCOUNT * math.sqrt(k))

    def probability(self, c: int, x: tuple[int, int]) -> float:
        """Of a word with counts x in class c; (0, 0): of all unknown words together."""
        return (x[c] - self.discount(x[c])) / max(1, self.sizes[c]) + self.weight[c] * (min(x) + 0.5) / self.shared_total

    def evidence(self, words: Iterable[str]) -> float:
        """The sum of log p(word | toxic) - log p(word | ordinary) over different words."""
        return math.fsum(self.word.get(w, self.unknown) for w in words)

    def margin(self, text: str | None) -> float:
        words = distinct_words(text)
        if not words:
            return 0.0
        levels = [x for w in words if (x := self.level.get(w)) is not None]
        weights = sum(n for _, n in levels)
        level = math.fsum(x * n for x, n in levels) / weights if weights else self.mean
        return (self.evidence(words) - level * len(words)) / math.sqrt(len(words))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.margin(text) + self.start))))

    def learn_levels(self, seen: Iterable[tuple[str, int, float]], mean: float) -> None:
        """(word, documents, the sum of their mean evidence), of ordinary documents; their mean."""
        self.mean = mean
        self.level = {w: ((total + 2 * mean) / (n + 2), min(n, LEVEL_DOCS)) for w, n, total in seen}

    def calibrate(self, seen: list[tuple[float, int]], share: float) -> None:
        """Logistic regression of labels on margins by Newton's method; share: the weight of all toxic rows together."""
        sizes = Counter(y for _, y in seen)
        if len(sizes) < 2:
            return
        scale = max(1e-9, sum(abs(x) for x, _ in seen) / len(seen))
        a, b = 1.0, 0.0
        for _ in range(50):
            ga, gb, aa, ab, bb = RIDGE * a, 0.0, RIDGE, 0.0, 1e-9
            for x, y in seen:
                x, w = x / scale, (share if y else 1 - share) / sizes[y]
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * x + b))))
                ga, gb = ga + w * (p - y) * x, gb + w * (p - y)
                v = w * max(p * (1 - p), 1e-6)
                aa, ab, bb = aa + v * x * x, ab + v * x, bb + v
            det = aa * bb - ab * ab
            da, db = (ga * bb - gb * ab) / det, (gb * aa - ga * ab) / det
            a, b = a - max(-2.0, min(2.0, da)), b - max(-2.0, min(2.0, db))
            if abs(da) + abs(db) < 1e-9:
                break
        self.slope, self.start = a / scale, b


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (toxic, h, w, n): a portion's different pairs of neighbours, where '' stands before the first word; where h is
    null, n is the number of documents that have w."""
    for batch in portions(batches):
        runs: tuple[set, set] = (set(), set())
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            h, here = "", set()
            for found in tokens(text):
                if found:
                    runs[toxic].update(zip([h, *found], found))
                    here.update(found)
                    h = found[-1]
            docs[toxic].update(here)
        for toxic in (0, 1):
            rows = [(*x, 1) for x in runs[toxic]] + [(None, w, k) for w, k in docs[toxic].items()]
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(rows), pa.int32()), *(pa.array([x[c] for x in rows], pa.string()) for c in range(2)), pa.array([x[2] for x in rows], pa.int64())], names=["toxic", "h", "w", "n"])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int) -> tuple[DataFrame, dict[int, int]] | None:
    """toxic, text, held of the labelled documents that are used, and the classes' sizes. The sample is chosen among the labels, and
    its ids are broadcast: no text but the sample's is moved."""
    rows = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("toxic")).filter("toxic IS NOT NULL AND _id IS NOT NULL")
    rows = rows.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_x", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    bound = min(rows_per_class, *sizes.values())
    below = lambda n: F.when(F.col("toxic") == 1, int(min(1, n / sizes[1]) * (1 << 30))).otherwise(int(min(1, n / sizes[0]) * (1 << 30)))
    held = (F.pmod(F.col("_x"), F.lit(HELD)) == 0) | (F.col("_x") >= below(bound))
    chosen = rows.filter(F.col("_x") < below(rows_per_class)).select("_id", "toxic", held.alias("held"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), on="_id").select("toxic", "text", "held"), sizes


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> KneserNey | None:
    """The models and their logistic map; None without rows of both classes. labels: id and label."""
    found = _sample(docs, labels, id_col, text_col, label_col, rows_per_class)
    if found is None:
        return None
    sample, sizes = found
    runs = sample.filter("NOT held").select("toxic", "text").mapInArrow(_pairs, "toxic int, h string, w string, n long")
    one = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    runs = runs.groupBy("h", "w").agg(one(0).alias("c0"), one(1).alias("c1"))
    count = lambda c: F.least(F.sum((F.col("h").isNotNull() & (F.col(c) > 0)).cast("int")), F.sum(F.when(F.col("h").isNull(), F.col(c)))).alias(c)
    counts = runs.groupBy("w").agg(count("c0"), count("c1"))
    model = KneserNey({w: (a, b) for w, a, b in counts.toArrow().to_pandas().itertuples(index=False, name=None)})

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, round(model.evidence(words) / len(words) * _UNIT)) for t in batch.column("text").to_pylist() if (words := distinct_words(t)) for w in [*sorted(words), ""]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], names=["w", "x"])

    ordinary = sample.filter("held AND toxic = 0").select("text").mapInArrow(means, "w string, x long")
    levels = ordinary.groupBy("w").agg(F.count("*").alias("n"), F.sum("x").alias("x")).toArrow().to_pandas()
    levels = {w: (n, x / _UNIT) for w, n, x in levels.itertuples(index=False, name=None)}
    n, total = levels.pop("", (1, 0.0))
    model.learn_levels(((w, *x) for w, x in levels.items()), total / n)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.margin(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], names=["x", "toxic"])

    seen = sample.filter("held").select("text", "toxic").mapInArrow(margins, "x double, toxic int").collect()
    model.calibrate(sorted(map(tuple, seen)), sizes[1] ** 0.5 / (sizes[0] ** 0.5 + sizes[1] ** 0.5))
    return model


def score(docs: DataFrame, model: KneserNey | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.score(t) for t in batch.column(0).to_pylist()], pa.float64())], names=["row", "score"])

    rows = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    return rows.mapInArrow(scored, rows.drop("text").schema.add("score", "double")).select("row.*", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by models of the labelled ones whose crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = score(rows, model, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
