"""Language ID and toxicity: held-out accuracy, spans, odd inputs; forward-backward by enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashelf.llm import langid, toxicity
from mediashelf.llm._common import fold_of

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, rejected = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if(F.col("rejected"))).first()
    assert right >= 0.98 * n and rejected <= 0.01 * n


def test_language_rejects_other_scripts_and_keeps_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "日本語の文章です。" * 40), (2, "1234 5678 --- !!!"), (3, "русский текст " * 30), (4, None)],
                                "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(r["rejected"] for r in got.values())
    assert got[2]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert langid.keep_identified(docs, model).count() >= 0.99 * docs.count()


@pytest.mark.parametrize("n", [400, 4000])
def test_language_rejects_labelled_noise(spark, n):
    """Random Latin letters with a label, in the rows the model learns from, below and above ``FIT_ROWS``."""
    rng = np.random.default_rng(n)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(n)
    noise = [(-1 - i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), int(rng.integers(120, 4000)))), "ende"[i % 2 * 2:][:2])
             for i in range(n // 40)]
    rows = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = [r["doc_id"] for r in langid.keep_identified(rows, langid.fit(rows)).select("doc_id").collect()]
    assert not [i for i in kept if i < 0] and len(kept) >= 0.99 * n


def test_language_odd_rows(spark, odd_docs):
    model = langid.fit(odd_docs)
    docs = odd_docs.withColumn("score", F.lit("clash"))
    out = langid.identify(docs, model)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[4]["lang_pred"] == "und"
    assert rows[5]["lang_pred"] in ("en", "de") and 0 <= rows[5]["score"] <= 1
    assert langid.keep_identified(docs, model).columns == docs.columns
    nothing = langid.fit(odd_docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), model).count() == 0


def test_code_points_and_pieces(monkeypatch):
    text = "aé日😀 Zß" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    points, at = langid.code_points(raw)
    assert "".join(map(chr, points)) == text and len(at) == len(text)
    offsets = np.array([0, len("aé日😀 Zß".encode()) * 20, len(raw)])
    whole = langid.gram_counts(raw, offsets)
    monkeypatch.setattr(langid, "PASS_BYTES", 37)
    pieces = langid.gram_counts(raw, offsets)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_language_of_one_character(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "", "en"), (3, None, "en")], "doc_id long, text string, lang string").coalesce(1)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got == {1: "en", 2: "und", 3: "und"}
    raw = np.frombuffer(b"abcdex", np.uint8)
    whole = langid.gram_counts(raw, np.array([0, 6]))
    monkeypatch.setattr(langid, "PASS_BYTES", 5)
    assert (langid.gram_counts(raw, np.array([0, 6]))[0] == whole[0]).all()


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    lengths = np.array([1, 5, 3, 7])
    e = rng.normal(size=lengths.sum())
    got = toxicity.forward_backward(e, trans, np.cumsum(lengths) - lengths, lengths)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + t] for t in range(n) if path[t]) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            on += w * np.array(path)
        assert np.allclose(got[at:at + n], on / total)
        at += n


def _toxic_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = _toxic_table(spark)
    got = toxicity.op2_toxicity_crf(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    n, right, toxic, caught = got.agg(
        F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.expr("toxic = 1")),
        F.count_if(F.expr("toxic = 1 AND predicted = 1"))).first()
    assert right >= 0.95 * n and caught >= 0.8 * toxic
    assert docs.count() == toxicity.op2_toxicity_crf(spark, "/root/testdata/sf0.1").count()


def test_toxicity_spans_and_odd_rows(spark, odd_docs):
    docs, labels = _toxic_table(spark)
    model = toxicity.fit(labels.where(fold_of("doc_id", 5) != 0), docs=docs)
    text = "é a perfectly fine text, but you stupid worthless idiot"
    rows = toxicity.score(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0
    words = " ".join(text.encode()[s["start"]:s["end"]].decode() for s in got[1]["spans"])
    assert "stupid" in words and "fine" not in words
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


def test_toxicity_learns_from_short_texts(spark):
    """Toxic texts of 5 to 12 words, alone and among long clean ones; labelled words at the edges."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("mor", "lin", "tep", "sal", "gor", "vin") for b in ("ane", "ilo", "urt", "ema", "osk", "edi")]
    bad = ["idiot", "moron", "worthless", "scum"]

    def text(toxic, words):
        w = [str(x) for x in rng.choice(plain, words)]
        if toxic:
            w[int(rng.choice([0, words - 1, words // 2]))] = str(rng.choice(bad))
        return " ".join(w)
    for longest in (12, 60):
        rows = [(i, text(i % 4 == 0, int(rng.integers(5, 13 if i % 4 == 0 else longest + 1))), int(i % 4 == 0)) for i in range(1200)]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = toxicity.fit(df.where("doc_id < 800"))
        got = {r["doc_id"]: r for r in toxicity.score(df.where("doc_id >= 800"), model).collect()}
        want = {i: y for i, _, y in rows if i >= 800}
        assert sum(got[i]["predicted"] == y for i, y in want.items()) >= 0.98 * len(want)
        assert sum(got[i]["predicted"] for i, y in want.items() if y) >= 0.95 * sum(want.values())


def test_toxicity_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    ones = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert {r["score"] < 1e-6 for r in toxicity.score(odd_docs, toxicity.fit(none, docs=odd_docs)).collect()} == {True}
    assert {r["predicted"] for r in toxicity.score(odd_docs, toxicity.fit(ones, docs=odd_docs)).collect()} == {1}


def _plain_language(text, model):
    """``(language, score, cosine, rejected)`` of one text, letter by letter and language by language."""
    import math
    from collections import Counter
    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    if not any(letters):
        return "und", 0.0, None, True
    slots = Counter()
    for k in (1, 2, 3):
        for i in range(len(letters) - k + 1):
            gram = letters[i:i + k]
            if any(gram):
                h = k
                for y in gram:
                    h = (h + y) * 0x9E3779B1 % 2 ** 32
                    h ^= h >> 15
                slots[h * 0x85EBCA6B % 2 ** 32 >> 20] += 1
    weight = {s: math.log1p(n) * float(model.idf[s]) for s, n in slots.items()}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    cosines = {}
    for lang, c in zip((model.langs[k] for k in model.of), model.centroids):
        cosines[lang] = max(cosines.get(lang, -2), sum(w * float(c[s]) for s, w in weight.items()) / norm)
    best = max(model.langs, key=lambda x: cosines[x])
    score = 1 / sum(math.exp(langid.SHARPNESS * (cosines[x] - cosines[best])) for x in model.langs)
    n = sum(1 for x in letters if x)
    return best, score, cosines[best], 1 - cosines[best] > model.radius[min(int(math.log2(n)), 12)]


def test_language_scores_equal_a_plain_version(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    docs = docs.limit(60).unionByName(odd_docs.select("doc_id", "text", "lang").where("doc_id <> 5 AND doc_id <> 6"))
    for r in langid.identify(docs, model).collect():
        lang, score, cosine, rejected = _plain_language(r["text"], model)
        assert r["lang_pred"] == lang and r["rejected"] == rejected
        assert abs(r["score"] - score) < 1e-3
        assert cosine is None or abs(r["cosine"] - cosine) < 1e-4
