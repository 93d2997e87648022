"""The operators that SQL can't express, against plain Python on whole small tables."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, lm_score, mixing, near_dedup, packed, toxicity


def documents(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return (text or "").encode().lower().split()


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def near_components(texts, k, percent=80):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inside = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inside[x].append(i)
    common = collections.Counter()
    for ids in inside.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def repeated(texts):
    sets, inside, out = [], collections.defaultdict(list), {}
    for i in sorted(texts):
        gone = []
        for k, line in enumerate((texts[i] or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            common = collections.Counter(j for w in s for j in inside[w])
            if any(100 * n >= 80 * (len(s) + len(sets[j]) - n) for j, n in common.items()):
                gone.append(k)
            for w in s:
                inside[w].append(len(sets))
            sets.append(s)
        out[i] = gone
    return out


def test_lm_score(spark, data):
    texts = {i: words(t) + [b""] for i, t in documents(spark, data).items()}
    one, two = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if bucket(i, 7) != 2:
            one.update(t)
            two.update(zip([b"", *t], t))
    n, v, mu, d = sum(one.values()), len(one), lm_score.MU, lm_score.DISCOUNT
    p = lambda w: (one[w] - d) / n if one[w] else d * v / n
    assert sum(map(p, one)) + p(b"not a word") == pytest.approx(1)
    rows = {r["doc_id"]: r for r in lm_score.op4_lm_score(spark, data).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(i, 7) == 2, len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10((two[h, w] + mu * p(w)) / (one[h] + mu)) for h, w in zip([b"", *t], t)))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, data, k):
    want = near_components(documents(spark, data), k)
    rows = near_dedup.near_duplicates(spark.read.parquet(f"{data}/documents.parquet"), shingle=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """A chain of edits, of which the ends are not alike, and pairs that only the blocks find."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_components(texts, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_bayes_bounds():
    steps = near_dedup.least_agreements(80, 1e-5)
    assert [n for n, _ in steps] == list(range(20, 141, 20))
    assert all(m < n * 0.8 for n, m in steps) and steps[-1][1] > 70


def test_line_dedup(spark, data):
    want = repeated(documents(spark, data))
    rows = line_dedup.repeated_lines(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r["doc_id"]: r["removed"] for r in rows} == want


def test_line_dedup_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT_LIST", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(30)]
    texts = {}
    for i in range(90):
        copy = [x if rng.random() > 0.08 else f"y{rng.randrange(5000)}" for x in base]
        texts[i] = " ".join(copy) + "\n" + " ".join(f"z{rng.randrange(40)}" for _ in range(6))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(df).collect()} == repeated(texts)


def test_mix_comes_near_its_targets(spark):
    """Each source's words miss its target by its largest document and 2 percent at most."""
    of = collections.defaultdict(lambda: [0, 0, 0.0])
    data = "/root/testdata/sf0.1"
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source").collect()}
    for r in mixing.op10_mix(spark, data).collect():
        assert r["taken"] <= 3 * r["size"]
        x = of[source[r["doc_id"]]]
        of[source[r["doc_id"]]] = [x[0] + r["taken"], max(x[1], r["size"]), r["target"]]
    assert len(of) > 10
    for taken, largest, target in of.values():
        assert abs(taken - target) <= largest + 0.02 * target
    assert sum(abs(taken - target) for taken, _, target in of.values()) <= 0.03 * sum(x[2] for x in of.values())


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op1_language(spark, data).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (bucket(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off():
    model = langid.Model({0: {"the": [9, 0], "der": [0, 9]}, 1: {"q": [1, 3], "e": [4, 4]}, 2: {"ch": [1, 8]}, 3: {}, 4: {}}, ["aa", "bb"])
    assert model.predict("The the", {})[0] == "aa"
    assert model.predict("loch", {})[0] == "bb"  # by the bigram ch
    assert model.predict("qqq", {})[0] == "bb"  # by single letters
    assert model.predict("zzz", {})[1] == pytest.approx(0.5)
    assert model.predict("123 ...", {}) == (langid.UND, 0.0)
    assert model.predict("½ ² Ⅷ ①", {}) == (langid.UND, 0.0)
    assert langid.letter_runs("Aß½b ²c 1x") == ["aß", "b", "c", "x"]
    long = "der " * 1000 + "the"
    langid.PIECE, whole = 64, langid.PIECE
    try:
        assert langid.count_words(long) == {"der": 1000, "the": 1}
    finally:
        langid.PIECE = whole


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, data).collect() if r["held_out"]]
    assert all(bucket(r["doc_id"], 5) == 0 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    ranked = sorted((r["score"], toxic[r["doc_id"]]) for r in rows if r["doc_id"] in toxic)
    ones = [i for i, (_, y) in enumerate(ranked, 1) if y]
    auc = (sum(ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * (len(ranked) - len(ones)))
    assert auc > 0.8


def test_kneser_ney_is_a_distribution():
    counts = {"a": (3, 0), "b": (20, 50), "c": (0, 12), "d": (1, 1), "e": (40, 2)}
    for counts in (counts, {"a": (0, 9), "b": (0, 1)}, {}):
        model = toxicity.KneserNey(counts)
        for c in (0, 1):
            assert sum(model.probability(c, x) for x in counts.values()) + model.probability(c, (0, 0)) == pytest.approx(1)
        for w, x in counts.items():
            assert model.word.get(w, model.unknown) == pytest.approx(math.log(model.probability(1, x) / model.probability(0, x)))


def test_toxicity_of_short_and_wholly_toxic_texts():
    """All of a text's evidence counts: no part of it is taken off as the text's own level."""
    model = toxicity.KneserNey({"a": (30, 10), "b": (20, 50), "c": (0, 40), "d": (25, 25)})
    for text in ("c", "c c c", "c c b", "c unknown"):
        assert model.margin(text) > 0 > model.margin("a")
    assert model.margin("c c b") == pytest.approx((model.word["c"] + model.word["b"]) / 2**0.5)
    model.learn_levels([("a", 4, -0.4), ("d", 100, 20.0)], -0.05)
    assert model.level == {"a": (-0.5 / 6, 4), "d": (19.9 / 102, toxicity.LEVEL_DOCS)}
    assert model.margin("c") == pytest.approx(model.word["c"] + 0.05)
    level = (4 * -0.5 / 6 + 50 * 19.9 / 102) / 54
    assert model.margin("a d c") == pytest.approx((model.word["a"] + model.word["c"] + model.word["d"] - 3 * level) / 3**0.5)
    assert model.margin("") == model.margin(None) == model.margin("...") == 0.0


def test_toxicity_equals_plain_python(spark, data):
    """The model of a sample, its levels and margins, counted again."""
    texts = {i: t for i, t in documents(spark, data).items() if t is not None}
    labels = {r["doc_id"]: int(r["toxic"] > 0) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    sample = toxicity._sample(df.withColumn("text", F.col("doc_id").cast("string")), known, "doc_id", "text", "toxic", 20)[0].collect()
    split = {int(r["text"]): r["held"] for r in sample}
    before, docs = (collections.defaultdict(set), collections.defaultdict(set)), (collections.Counter(), collections.Counter())
    for i in (i for i, held in split.items() if not held):
        w = re.findall(r"\w+", texts[i].lower())
        docs[labels[i]].update(set(w))
        for h, x in zip(["", *w], w):
            before[labels[i]][x].add(h)
    model = toxicity.KneserNey({w: tuple(min(len(before[c][w]), docs[c][w]) for c in (0, 1)) for w in {*docs[0], *docs[1]}})
    held = [set(re.findall(r"\w+", texts[i].lower())) for i, h in split.items() if h and not labels[i]]
    mean = [model.evidence(w) / len(w) for w in held if w]
    level = collections.defaultdict(list)
    for w, x in zip((w for w in held if w), mean):
        for y in w:
            level[y].append(x)
    model.learn_levels([(w, len(x), sum(x)) for w, x in level.items()], sum(mean) / len(mean))
    fitted = toxicity.fit(df, known, rows_per_class=20)
    assert fitted.word == pytest.approx(model.word) and set(fitted.level) == set(model.level)
    for t in texts.values():
        assert fitted.margin(t) == pytest.approx(model.margin(t), abs=1e-6)


def test_line_dedup_of_short_lines(spark):
    """Lines of one to three words go like others."""
    rng = random.Random(7)
    texts = {i: "\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(7))) for _ in range(6)) for i in range(60)}
    texts[100], texts[101] = "一段没有空格的文字。\nfresh words only here", "一段没有空格的文字。"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = repeated(texts)
    assert {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(df).collect()} == want
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in texts.items()}
    changed = {i: t for i, t in kept.items() if not want[i] or t.split()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(df).collect()} == changed


@pytest.mark.parametrize("short", [4, 512])
def test_line_dedup_of_dealt_lists(spark, monkeypatch, short):
    """Lists dealt out to groups, and lines that match none of the few that their lists hand on."""
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    monkeypatch.setattr(line_dedup, "LIST", 5)
    monkeypatch.setattr(line_dedup, "HANDED", 1)
    monkeypatch.setattr(line_dedup, "SHORT_LIST", short)
    rng = random.Random(8)
    texts = {}
    for i in range(120):
        base = [f"w{j}" for j in rng.sample(range(14), 11)]
        texts[i] = " ".join(base) + "\n" + " ".join(f"v{j}" for j in rng.sample(range(9), rng.randrange(4, 8)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(df).collect()} == repeated(texts)


def test_hasher():
    """Equal words have equal hashes wherever they stand, and others have others; words as long as a chunk too."""
    hasher = packed.Hasher()
    data = b"Ab ab\tb\nA " + b"x" * 70_000 + b" " + b"X" * 70_000 + b" ab " + b"y " * 40_000 + "é É".encode()
    words_, (hashes, starts) = data.lower().split(), hasher(data)
    assert len(words_) == len(hashes) and data[starts[2] : starts[2] + 1] == b"b"
    seen = dict(zip(words_, hashes.tolist()))
    assert [seen[w] for w in words_] == hashes.tolist() and len(set(seen.values())) == len(seen)
    assert [len(x) for x in hasher(b"")] == [0, 0]
