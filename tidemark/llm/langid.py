"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

The model is fitted on at most about `rows_per_lang` labelled documents of each language, chosen by a hash of the id, so its
size is bounded by that parameter and by the texts' lengths. A word that the sample has is scored in each language by its
smoothed log frequency; another word by the longest order of character n-grams (with the word's edges marked) of which at
least one is known, as the mean of their log frequencies; a word of which not even a letter is known says nothing. The
language with the highest sum wins; the score is its posterior with equal priors.

Defined results: a null or empty text, and one without letters, is `und` with score 0; so is every text when no labelled row is
left to learn from. Of languages that are equally likely the first by name wins. Labels that are null teach nothing. Repeated rows give a
row each. Input columns named lang_pred or score are replaced. Texts are read in pieces of
`PIECE` characters cut at white space, so a long text takes no more memory than its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, table
from tidemark.llm.packed import lean, portions

UND = "und"
#: Documents of a language that the model is fitted on (expected number; texts are used whole).
ROWS_PER_LANG = 1_500
#: The longest character n-gram that unseen words back off to.
MAX_GRAM = 4
SMOOTHING = 0.5
#: Words and n-grams that occur less often in the sample are left to shorter ones.
MIN_COUNT = 2
PIECE = 1 << 20
_CACHE_WORDS = 200_000
#: Languages up to which the sample's shares are broadcast.
BROADCAST_LANGS = 10_000
_ALNUM = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s")


def letter_runs(text: str) -> list[str]:
    """Lower-cased runs of letters; fractions, superscripts and other number signs are none."""
    found = _ALNUM.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def count_words(text: str | None) -> Counter:
    """Lower-cased letter runs of a whole text."""
    if not text:
        return Counter()
    if len(text) <= PIECE:
        return Counter(letter_runs(text))
    out: Counter = Counter()
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, min(len(text), start + PIECE))
        end = cut.end() if cut else len(text)
        out.update(letter_runs(text[start:end]))
        start = end
    return out


def grams(word: str, n: int) -> Iterator[str]:
    """Character n-grams of a word between its marked edges; single letters without the marks."""
    edged = word if n == 1 else f"<{word}>"
    return (edged[i : i + n] for i in range(len(edged) - n + 1))


class Model:
    """langs, and log frequencies by word and by n-gram order."""

    def __init__(self, counts: dict[int, dict[str, list[int]]], langs: list[str]):
        self.langs = langs
        self.tables: dict[int, dict[str, tuple[float, ...]]] = {}
        for order, of in counts.items():
            totals = [sum(c[k] for c in of.values()) + SMOOTHING * (len(of) + 1) for k in range(len(langs))]
            logs = [math.log(t) for t in totals]
            self.tables[order] = {w: tuple(math.log(c[k] + SMOOTHING) - logs[k] for k in range(len(langs))) for w, c in of.items()}

    def word(self, word: str) -> tuple[float, ...]:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return known
        for n in range(min(MAX_GRAM, len(word) + 2), 0, -1):
            of = self.tables.get(n, {})
            found = [x for g in grams(word, n) if (x := of.get(g)) is not None]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found))
        return (0.0,) * len(self.langs)

    def predict(self, text: str | None, cache: dict[str, tuple[float, ...]]) -> tuple[str, float]:
        words = count_words(text)
        if not words or not self.langs:
            return UND, 0.0
        sums = [0.0] * len(self.langs)
        for w, c in words.items():
            x = cache.get(w)
            if x is None:
                if len(cache) >= _CACHE_WORDS:
                    cache.clear()
                x = cache[w] = self.word(w)
            sums = [s + c * v for s, v in zip(sums, x)]
        best = max(range(len(sums)), key=sums.__getitem__)
        return self.langs[best], 1.0 / sum(math.exp(max(-700.0, s - sums[best])) for s in sums)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, ord, gram, n): counts of a batch; ord 0 has words, n character n-grams."""
    for batch in portions(batches):
        of: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            of.setdefault(lang, Counter()).update(count_words(text))
        rows: dict[tuple[str, int], Counter] = {}
        for lang, words in of.items():
            rows[lang, 0] = words
            for n in range(1, MAX_GRAM + 1):
                c = rows[lang, n] = Counter()
                for w, k in words.items():
                    for g in grams(w, n):
                        c[g] += k
        for (lang, n), c in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([n] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "ord", "gram", "n"])


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """A model of the labelled rows. A hash of id and text chooses the sample evenly and alike on every run."""
    spread = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread.alias("_x")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model({}, [])
    shares = rows.sparkSession.createDataFrame([(k, int(min(1.0, rows_per_lang / n) * (1 << 30))) for k, n in sizes.items()], "lang string, _share long")
    sample = rows.join(F.broadcast(shares) if len(langs) <= BROADCAST_LANGS else shares, on="lang").filter("_x < _share").select("lang", "text")
    counts = sample.mapInArrow(lean(_sample_counts), "lang string, ord int, gram string, n long").groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("ord", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("c"), F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    found: dict[int, dict[str, list[int]]] = {}
    place = {k: i for i, k in enumerate(langs)}
    for batch in counts.select("ord", "gram", "c").toArrow().to_batches():
        for o, g, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            row = found.setdefault(o, {})[g] = [0] * len(langs)
            for x in c:
                row[place[x["lang"]]] = x["n"]
    return Model(found, langs)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, ...]] = {}
        for batch in batches:
            out = [model.predict(t, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["row", "lang_pred", "score"])

    rows = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    return rows.mapInArrow(lean(scored), rows.drop("text").schema.add("lang_pred", "string").add("score", "double")).select("row.*", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language the model tells, with at least the score `least`; texts without letters go."""
    column = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, ...]] = {}
        for batch in batches:
            told = [model.predict(t, cache) for t in batch.column(column).to_pylist()]
            yield batch.filter(pa.array([lang != UND and score >= least for lang, score in told], pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document from a model of those whose crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", crc_bucket(F.col("doc_id"), 4).alias("_fold"))
    model = fit(docs.filter("_fold <> 2"))
    rows = docs.select("doc_id", "text", (F.col("_fold") == 2).alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
