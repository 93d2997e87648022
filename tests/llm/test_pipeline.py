"""Every stage of the pipeline on its own input, and the chain, against plain Python (the mix against its SQL in DuckDB)."""

import collections

import corpus_pipeline
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.llm.test_brute_force import near_components, repeated

from tidemark.llm import common, langid, mixing


def identified(docs):
    """Rows whose language a model of all labelled rows tells with at least even odds; counted by plain Python."""
    langs = sorted({r["lang"] for r in docs if r["lang"] and r["text"] is not None})
    counts: dict = {n: collections.defaultdict(lambda: [0] * len(langs)) for n in range(langid.MAX_GRAM + 1)}
    for r in docs:
        if r["lang"] and r["text"] is not None:
            for w in langid.letter_runs(r["text"]):
                for n in counts:
                    edged = w if n < 2 else f"<{w}>"
                    for g in [w] if n == 0 else [edged[i : i + n] for i in range(len(edged) - n + 1)]:
                        counts[n][g][langs.index(r["lang"])] += 1
    model = langid.Model({n: {g: c for g, c in of.items() if sum(c) >= langid.MIN_COUNT} for n, of in counts.items()}, langs)
    told = ((r, model.predict(r["text"], {})) for r in docs)
    return [r for r, (lang, score) in told if lang != langid.UND and score >= 0.5]


def without_lines(docs):
    gone = repeated({r["doc_id"]: r["text"] for r in docs})
    out = []
    for r in docs:
        lines = r["text"].split("\n") if r["text"] is not None else None
        cut = set(gone[r["doc_id"]])
        text = r["text"] if not cut else "\n".join(x for k, x in enumerate(lines) if k not in cut)
        if not cut or text.split():
            out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def without_copies(docs):
    found = near_components({r["doc_id"]: r["text"] for r in docs}, 5)
    return [r for r in docs if found[r["doc_id"]][1] == r["doc_id"]]


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split(" ")


def without_leaks(docs, items):
    cuts = collections.defaultdict(set)
    for item in items:
        w = [x for x in words(item) if x]
        for k in range(max(1, len(w) - 9) if w else 0):
            cuts[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    out = []
    for r in docs:
        w = [x for x in words(r["text"]) if x]
        if not any(tuple(w[k : k + n]) in of for n, of in cuts.items() for k in range(len(w) - n + 1)):
            out.append(r)
    return out


def copies(docs, folder):
    """(doc_id, taken) by the mix's SQL."""
    pq.write_table(pa.Table.from_pylist(docs), folder / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    rows = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()
    return {i: taken // size for i, size, taken in rows if size}


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """name -> (the stage's rows, what plain Python makes of the same input), each on what plain Python kept before."""
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    source = spark.read.parquet(f"{data}/documents.parquet")
    docs, out = rows_of(source), {}
    plain = {"language ID": identified, "line dedup": without_lines, "near dedup": without_copies, "benchmark decontamination": lambda d: without_leaks(d, items)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](docs)
        out[name] = rows_of(stage(spark, spark.createDataFrame(docs, source.schema), data)), want
        docs = want
    name, stage = corpus_pipeline.STAGES[-1]
    made = collections.Counter(r["doc_id"] for r in stage(spark, spark.createDataFrame(docs, source.schema), data).collect())
    out[name] = made, copies(docs, tmp_path_factory.mktemp("mix"))
    return out


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_equals_plain_python(stages, name):
    got, want = stages[name]
    assert got == want and want


def test_mix_equals_its_sql(stages):
    made, want = stages["mixing"]
    assert {i: made[i] for i in want} == want


def test_chain_equals_its_stages(spark, data, stages):
    """run() makes what the stages make one after the other, and leaves no more than its last input and the mix's small tables."""
    before = set(common.written())
    rows = corpus_pipeline.run(spark, data).collect()
    docs = {r["doc_id"]: r for r in stages["benchmark decontamination"][1]}
    assert collections.Counter(r["doc_id"] for r in rows) == stages["mixing"][0]
    for r in rows:
        assert {c: r[c] for c in docs[r["doc_id"]]} == docs[r["doc_id"]]
    left = [x.rsplit("/", 1)[1].removeprefix("tidemark-").rsplit("-", 1)[0] for x in common.written() if x not in before]
    assert sorted(left) == ["benchmark-decontamination", "mix-blocks", "mix-sources"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, data, name):
    """A stage's session sends Python few MB at once, whatever the rows' sizes; it keeps a setting that is there."""
    key = next(iter(corpus_pipeline.BATCHES))
    spark.conf.unset(key)
    docs = common.table(spark, data, "documents")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(20), data)
        texts = spark.range(0, 4_000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
        assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < 6 << 20
        spark.conf.set(key, "123456")
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(20), data)
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key)
