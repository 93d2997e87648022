"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and extra columns whose names clash."""

import random
import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, langid, licenses, line_dedup, lm_score, mixing, near_dedup, toxicity, url_filter

LONG = "lorem ipsum dolor sit amet " * 10_000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", 1),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", 1),
    (None, "null id text with some words", "de", "c", 1),
    (7, LONG, "la", "c", None),
    (8, "!!! ... 123", "en", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "copy", "rank", "key", "block", "label", "w", "words", "n", "score", "t", "row", "_text", "block_", "item", "hits"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Two three four five six seven eight nine ten eleven!"), (2, None), (None, "one"), (3, ""), (4, "123")], "item_id long, text string")


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_language(docs, none):
    model = langid.fit(docs)
    assert langid.predict(docs, model).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    got = by_id(langid.predict(docs, model, keep=["doc_id"]), "lang_pred")
    assert len(got) == len(ROWS)
    assert {i: p for i, p in got if i in (2, 3, 4, 8)} == dict.fromkeys((2, 3, 4, 8), langid.UND)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.Model({}, []), keep=["doc_id"]).collect()} == {langid.UND}
    assert langid.keep_identified(docs, model).columns == docs.columns


def test_fingerprints(docs, none, spark):
    got = fingerprints.with_next_text(docs).collect()
    assert len(got) == len(ROWS)
    following = {(r["doc_id"], r["text"]): r["next_text"] for r in got}
    assert following[8, ROWS[8][1]] == ROWS[6][1]  # the first row is the one with a null id
    assert following[None, ROWS[6][1]] == ROWS[0][1]
    assert following[3, ""] == ROWS[3][1]
    roots = dict(by_id(fingerprints.fingerprint(docs), "fingerprint"))
    assert roots[1] == roots[5] != roots[4] and roots[2] == roots[3]
    assert fingerprints.with_next_text(none).count() == 0
    one = spark.createDataFrame([(9, "a b")], "doc_id long, text string")
    assert fingerprints.with_next_text(one).first()["next_text"] == "a b"
    two = spark.createDataFrame([("a\nb c\n\nd", "a\nb x\n\nd")], "a string, b string")
    tree = lambda c: fingerprints.leaf_tree(F.col(c))
    where = two.select(fingerprints.differing_leaves(tree("a"), tree("b")).alias("x")).first()["x"]
    assert [(x["section"], x["paragraph"]) for x in where] == [(0, 1)]


def test_next_text_of_uneven_ids(spark):
    ids = [0, 1, 2, 10**15, 10**15 + 1, -(10**12), 5, 7, 10**6] + list(range(100, 400, 3))
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = sorted(ids)
    want = {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    assert {r["doc_id"]: r["next_text"] for r in fingerprints.with_next_text(rows).collect()} == want


def test_licenses(spark, docs, none):
    known = licenses.known_digests(spark)
    assert len(by_id(licenses.scan(docs, known))) == len(ROWS)
    assert licenses.scan(none, known).count() == 0
    mit = licenses.CATALOGUE[0][1]
    texts = spark.createDataFrame([(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, "text\nreleased under the MIT licence\nmore"), (2, "text\nreleased under the MIT licence\nmore")], "doc_id long, text string")
    got = by_id(licenses.scan(texts, known), "n_license_lines", "text_licenses", "line_licenses")
    assert got == [(1, 0, ["MIT"], []), (2, 1, [], ["MIT"]), (2, 1, [], ["MIT"])]
    nothing = known.filter("false")
    assert {r["n_license_lines"] for r in licenses.scan(texts, nothing).collect()} == {0}


def test_licenses_of_usual_files(spark):
    mit, bsd = licenses._SHORT[0][1], licenses._BSD3
    gpl = (Path(licenses.__file__).parent / "license_texts" / "GPL-3.0-only.txt").read_text()
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit),
        (2, "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + bsd),
        (3, gpl),
        (4, "a text\n// SPDX-License-Identifier: Apache-2.0\nThis project is licensed under the Mozilla Public License 2.0\n"),
        (5, mit[:200]),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(licenses.scan(texts, licenses.known_digests(spark)), "text_licenses", "line_licenses")
    assert got == [(1, ["MIT"], []), (2, ["BSD-3-Clause"], []), (3, ["GPL-3.0-only"], []), (4, [], ["Apache-2.0", "MPL-2.0"]), (5, [], [])]


def test_lm_score(docs, none):
    learn = F.coalesce(F.col("doc_id") != 1, F.lit(False))
    got = lm_score.score(docs, learn).collect()
    assert len(got) == len(ROWS)
    assert all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm_score.score(none, F.lit(True)).count() == 0
    untaught = lm_score.score(docs, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in untaught} == {(0, 0, 0.0)}


def test_urls(spark):
    rules = url_filter.rule_table(spark, url_filter.RULES)
    urls = [(1, "http://A.Example.ORG/es/x?y=/"), (2, None), (3, "no scheme"), (4, "x://org"), (5, "http://a.com/de/1"), (5, "http://a.com/de/1"), (6, "http://notexample.org/es/"), (None, "https://com/fr/a#b"), (7, "ftp://" + "a." * 3000 + "org/" + "p" * 5000), (8, "")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id long, url string, rule string")
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()), key=repr)
    assert got == sorted([(1, "example.org/es/", "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "com/de/", "block"), (5, "com/de/", "block"), (6, "org/", "allow"), (None, "com/fr/", "allow"), (7, "org/", "allow"), (8, None, "allow")], key=repr)
    assert url_filter.judge(pages.filter("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.filter("false")).collect()} == {"allow"}


def test_urls_of_many_rules(spark, monkeypatch):
    """Host and path are compared apart; a set of rules that is too large to broadcast; many shapes."""
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "bb", "org", "example"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "x", "g", "yy"]) for _ in range(rng.randrange(6)))
    rules = {("example.or", "g/"): "block", ("", ""): "block", ("org?", ""): "block", ("org", "?"): "block"}
    rules |= {(host(), p): rng.choice(["allow", "block"]) for p in ("/" + path() if rng.random() < 0.8 else "" for _ in range(150))}
    urls = ["http://example.org/x", "http://example.or/g/"] + [f"http://{host()}/{path()}" for _ in range(300)]
    table = url_filter.rule_table(spark, [(v, h, p) for (h, p), v in rules.items()])
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    want = []
    for i, u in [*enumerate(urls), (0, urls[0])]:
        h, _, p = u[7:].partition("/")
        fit = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules.items() if (h == rh or h.endswith("." + rh) and rh) and ("/" + p).startswith(rp)]
        want.append((i, *max(fit, default=(0, 0, None, "allow"))[2:]))
    for limit in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, table).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_dedup(docs, none):
    got = by_id(line_dedup.repeated_lines(docs), "removed")
    assert got == sorted([(1, []), (2, []), (3, []), (4, []), (5, [0]), (5, [0]), (None, []), (7, []), (8, [])], key=repr)
    assert line_dedup.repeated_lines(none).count() == 0
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert [i for (i,) in by_id(out)] == sorted([1, 2, 3, 4, None, 7, 8], key=repr)


def test_decontamination(docs, none, items):
    got = by_id(decontaminate.scan(docs, items), "n_words", "hits", "items")
    want = {1: (11, list(range(11)), ["1"]), 2: (0, [], []), 8: (1, [0], ["4"])}  # the item without an id hits word 0
    assert len(got) == len(ROWS)
    for i, n, hits, found in got:
        if i in want:
            assert (n, hits, found) == want[i]
    assert decontaminate.scan(none, items).count() == 0
    assert sum(len(r["hits"]) for r in decontaminate.scan(docs, items.filter("false")).collect()) == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert [i for (i,) in by_id(kept)] == sorted([2, 3, 4, None, 7], key=repr)


def test_decontamination_of_capital_sigmas(spark):
    """lower() of a whole text makes another sigma than lower() of its words."""
    text = "Π.Σ. Παπαδόπουλος ΑΣ.Β one TWO"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text.replace("TWO", "two"))], "doc_id long, text string")
    assert by_id(decontaminate.scan(docs, bench), "hits", "items") == [(1, list(range(1, 8)), ["1"])]


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_decontamination_against_plain_python(spark, monkeypatch, window):
    """Windows at every place of a text, items shorter than a window, rows that share an id; sets that are too large to broadcast."""
    rng = random.Random(window)
    texts = [" ".join(rng.choice(["a", "B", "c", "ΑΣ", "d1"]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(60))) for _ in range(40)]
    items = [" ".join(texts[i].split()[k : k + rng.randrange(1, 14)]) for i, k in ((3, 0), (5, 7), (5, 8), (9, 11), (20, 2))]
    words = lambda t: re.findall(decontaminate.WORD.replace(r"\x7F", "\x7f"), "".join(c.lower() if c.isascii() else c for c in t))
    want = []
    cuts = [(str(i), w[k : k + window]) for i, w in enumerate(map(words, items)) for k in range(max(1, len(w) - window + 1)) if w]
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, cut, item) for item, cut in cuts for k in range(len(w) - len(cut) + 1) if w[k : k + len(cut)] == cut]
        want.append((i // 2, len(w), sorted({x for k, cut, _ in at for x in range(k, k + len(cut))}), sorted({x for _, _, x in at})))
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert by_id(decontaminate.scan(df, bench, window=window), "n_words", "hits", "items") == sorted(want, key=repr)
    for limit in ("BROADCAST_WINDOWS", "BROADCAST_BLOCKS", "BROADCAST_DOCS"):
        monkeypatch.setattr(decontaminate, limit, 0)
    assert by_id(decontaminate.scan(df, bench, window=window), "n_words", "hits", "items") == sorted(want, key=repr)


def test_toxicity(docs, none):
    labels = docs.sparkSession.createDataFrame([(1, 1), (7, 0), (2, 1), (None, 1), (8, None), (99, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(docs, model, keep=["doc_id"]), "score")
    assert len(got) == len(ROWS) and all(0 <= s <= 1 for _, s in got)
    assert toxicity.fit(docs, labels.filter("toxic = 1")) is None
    assert toxicity.fit(none, labels) is not None
    assert {r["score"] for r in toxicity.score(docs, None, keep=["doc_id"]).collect()} == {0.0}
    assert toxicity.score(none, model, keep=["doc_id"]).count() == 0
    for given in (model, None):
        out = toxicity.score(docs, given)
        assert out.columns == [c for c in docs.columns if c != "score"] + ["score"] and out.count() == len(ROWS)
    silent = docs.sparkSession.createDataFrame([(2, 1), (3, 1), (1, 0), (7, 0)], "doc_id long, toxic int")  # no toxic words at all
    assert {r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, silent)).collect()} == {True}


def test_near_duplicates(docs, none):
    got = by_id(near_dedup.near_duplicates(docs, shingle=2), "component_id", "kept")
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 1, False), (5, 1, False), (None, None, True), (7, 7, True), (8, 8, True)], key=repr)
    assert near_dedup.near_duplicates(none).count() == 0
    out = near_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == 7
    twice = near_dedup.deduplicate(docs.filter("doc_id >= 3").unionByName(docs.filter("doc_id = 7")))
    assert [i for (i,) in by_id(twice)] == [3, 4, 5, 7, 8]


def test_mixing(docs, none):
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["copies"] <= mixing.MAX_COPIES and r["target"] <= 3 * r["source_size"] for r in rows)
    again = by_id(mixing.mix(docs.repartition(5)), "copies")
    assert again == by_id(mixed, "copies")
    assert mixing.mix(none).count() == 0
    out = mixing.emit(docs)  # the input's own column copy stays
    assert out.columns == [*docs.columns, "copy_"]
    assert out.count() == sum(r["copies"] for r in rows) and {r["copy"] for r in out.collect()} == {"x"}


def test_many_sources_without_a_broadcast(spark, docs, monkeypatch):
    whole = by_id(mixing.mix(docs), "size", "target", "copies")
    join = mixing.join_lookup
    monkeypatch.setattr(mixing, "join_lookup", lambda *a: join(*a, limit=0, salts=3))
    assert by_id(mixing.mix(docs), "size", "target", "copies") == whole


def test_pipeline_stages(spark, docs, none, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        assert set(docs.columns) <= set(rows.columns), name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert rows.count() >= 0


def test_pipeline_keeps_clean_documents(spark, data):
    """Each stage on its own input: what goes is what the operator found."""
    source = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, source, data).collect()}
    assert kept == {r["doc_id"] for r in source.collect()}
    hit = {r["doc_id"] for r in decontaminate.op7_decontaminate(spark, data).filter("contaminated").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.remove_leaks(spark, source, data).collect()}
    assert kept == {r["doc_id"] for r in source.collect()} - hit
    assert corpus_pipeline.run(spark, data).columns == [*source.columns, "copy"]
