"""The corpus pipeline: documents through the training-data operators, stage by stage.

Every stage works on all rows that the one before kept. All but the last return the columns of documents; the last, the mix,
has a row for each copy, with the copy's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, line_dedup, mixing, near_dedup
from tidemark.llm.common import READ, discard_paths, materialise, table, written


#: Batches for Python by bytes as well as by rows: 10,000 rows with their texts, or with two shingle sets each, are tens of MB, which the
#: executor holds several times over beside its heap. A longer row is a batch of its own.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _settings(spark: SparkSession) -> None:
    """The stage's input is read with the settings of table() and sent to Python in small batches, unless the session has its own."""
    for key, value in (READ | BATCHES).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from those that have a label."""
    _settings(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match a line before them; n_chars follows the text."""
    _settings(spark)
    out = line_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles."""
    _settings(spark)
    return near_dedup.deduplicate(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    _settings(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    _settings(spark)
    return mixing.emit(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_lines),
    ("near dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_leaks),
    ("mixing", mix_sources),
]

#: The chain and its language stage have no SQL; tests/llm holds the rows of run() against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages keep. A stage's own tables, and its input, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = {*written()} - {getattr(docs, "_tidemark_path", None)}
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), release=True)
        discard_paths(spark, [x for x in written() if x not in before and x != docs._tidemark_path])
    return STAGES[-1][1](spark, docs, sf_dir)
