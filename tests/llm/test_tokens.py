"""Token counts under edits and the piece lattice, against the tokenizers and brute force."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from mediashelf.llm import piece_lattice, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.Tokenizer.get(token_counts.PATTERN, token_counts.read_ranks())


def test_edits_equal_counting_anew(tokenizer):
    rng = random.Random(3)
    alphabet = " \n\t  abcABC'sd'llve123,.!éñ日 "
    anew = again = 0
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 20, 200, 1000])))
        tree = token_counts.build(text, tokenizer)
        for _ in range(5):
            start, length = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 3, 30])
            insert = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 10])))
            text, tree, n = token_counts.edit(text, tree, start, length, insert, tokenizer)
            assert tree.total == len(tokenizer.encode(text)) and tree.chars[1] == len(text)
            again += n
            anew += len(tokenizer.split.findall(text))
    assert again < anew / 5


def test_states_and_edits(spark, odd_docs, tokenizer):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    states = token_counts.build_states(docs)
    edits = spark.createDataFrame(
        [(1, 2, 0, 5, "x"), (1, 1, 6, 4, "BETA "), (2, 1, 0, 0, "new text"), (5, 1, 10_000, 50, None),
         (7, 1, None, None, "é"), (99, 1, 0, 0, "no such document"), (8, 1, 0, 99, "")],
        "doc_id long, seq int, start long, length long, insert string")
    got = {r["doc_id"]: r for r in token_counts.apply_edits(states, edits).collect()}
    assert set(got) == {1, 2, 5, 7, 8}
    assert got[1]["text"].startswith("x BETA") and got[2]["text"] == "new text" and got[8]["text"] == ""
    for r in got.values():
        assert r["n_tokens"] == len(tokenizer.encode(r["text"]))
    assert got[5]["encoded"] < 40


def test_edited_counts(documents, odd_docs, tokenizer):
    def edited(text, edits):
        for e in edits:
            s = min(max(e["start"], 0), len(text))
            text = text[:s] + (e["insert"] or "") + text[min(len(text), s + e["length"]):]
        return text
    for docs in (documents, odd_docs):
        with_edits = docs.select("doc_id", "text", token_counts.sample_edits(F.col("doc_id"), F.col("text")).alias("edits"))
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(tokenizer.encode(r["text"] or "")),
                       len(tokenizer.encode(edited(r["text"] or "", r["edits"])))) for r in with_edits.collect())
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_tokens_edited"])
                     for r in token_counts.edited_counts(with_edits).collect())
        assert got == want
    assert token_counts.edited_counts(with_edits.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, documents, odd_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    extra = spark.createDataFrame(
        [(-1, " a  b \n\n c "), (-2, "<s> <0x41> </s>"), (-3, "x" * 5000), (-4, "\t\r\n　ﬁ\u0000é"), (-5, "   "), (-6, "日本😀" * 400)],
        "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(extra)
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    out = piece_lattice.decode(piece_lattice.encode(docs)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], list(r["ids"])) for r in out)
    assert [g[:3] for g in got] == texts
    assert all(model.encode(t) == g[3] for (_, _, t), g in zip(texts, got))


def test_pieces_empty(spark, odd_docs):
    assert piece_lattice.decode(piece_lattice.encode(odd_docs.limit(0))).count() == 0


def test_unigram_viterbi_by_enumeration(spark):
    rng = random.Random(2)
    table = {p: (i + 3, -rng.uniform(1, 6)) for i, p in enumerate(
        ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "ca", "cab", "bca"])}
    pieces = piece_lattice.Pieces(table, {}, 0, ["<unk>", "<s>", "</s>", *table])
    low = min(s for _, s in table.values()) - 10

    def best(word):
        top = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                p = word[start:end]
                if start in top and (p in table or end - start == 1):
                    i, s = table.get(p, (0, low))
                    options.append((top[start][0] + s, top[start][1] + [i]))
            top[end] = max(options, key=lambda o: o[0])
        return top[len(word)][1]
    texts = ["".join(rng.choice("abc x") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in piece_lattice.encode(df, fold="unigram", pieces=pieces).collect()}
    assert got == {k: [i for w in piece_lattice.split(t) for i in best(w)] for k, t in enumerate(texts)}


def test_bucket_words_are_segmented_in_bounded_steps(monkeypatch):
    """The edges of a bucket's words are not all in memory at once; the ids do not depend on the steps."""
    pieces = piece_lattice.Pieces.read()
    words = [f"▁word{i}" for i in range(200)] + ["▁" + "long" * 40, "日本", "\n", "▁"]
    ids, count = piece_lattice.bpe_bucket(words, pieces)
    seen, edges = [], piece_lattice.PieceArrays.edges

    def counted(self, points, end):
        seen.append(len(points))
        return edges(self, points, end)
    monkeypatch.setattr(piece_lattice.PieceArrays, "edges", counted)
    monkeypatch.setattr(piece_lattice, "STEP_CHARS", 50, raising=False)
    steps = piece_lattice.bpe_bucket(words, pieces)
    assert steps[0].tolist() == ids.tolist() and steps[1].tolist() == count.tolist()
    assert max(seen) == 161 and sorted(seen)[-2] <= 50
