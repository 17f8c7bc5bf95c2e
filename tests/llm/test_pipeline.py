"""The pipeline's stages on a small fixture, and the registered queries against their SQL."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
import __spark_entry__ as entry
from mediashelf.llm import langid, piece_lattice
from mediashelf.llm.queries import load_all
from mediashelf.plans.compare import digest, type_diffs

from .test_native import _targets

SF = "/root/testdata/sf0.001"
NAMES = ["language_id", "near_duplicates", "repeated_passages", "mix_sources", "token_ids"]


def test_stages_of_the_pipeline(spark, odd_docs, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for docs in (documents, odd_docs, odd_docs.limit(0)):
        cols = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == cols, name
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns) == {"doc_id", "n_tokens", "ids"}


def test_stage_decisions(spark, documents):
    docs = documents
    kept = corpus_pipeline.language_id(spark, docs, SF)
    model = langid.fit(docs)
    assert kept.count() == langid.identify(docs, model).where("NOT rejected").count()
    text = documents.first()["text"]
    twice = documents.unionByName(spark.createDataFrame(
        [(10_001, text + " end", "en", "s", 1), (10_002, text, "en", "s", 1)], documents.schema))
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, twice, SF).select("doc_id").collect()}
    assert not {10_001, 10_002} & found
    again = documents.unionByName(documents)
    assert corpus_pipeline.near_duplicates(spark, again, SF).count() == corpus_pipeline.near_duplicates(spark, documents, SF).count()
    cut = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, twice, SF).collect()}
    assert 10_002 not in cut and cut[10_001]["text"] == text[len(text):] + " end" or len(cut[10_001]["text"]) < 60
    assert all(len(r["text"]) == r["n_chars"] for r in cut.values())


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    """Near duplicates: no text is lost because another one has its id."""
    base = [" ".join(f"{a}{i}" for i in range(60)) for a in ("apple", "berry", "cedar", "delta")]
    rows = [(1, base[0], "x"), (1, base[1], "y"), (2, base[2], "x"), (2, base[2], "x"), (3, base[2] + " end", "z"),
            (3, base[3], "z"), (None, base[0], "n"), (None, base[0], "n"), (4, "", "e"), (5, "", "e"), (6, None, "e"), (0, base[1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    for parts in (1, 4):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()), key=str)
        assert got == sorted([(1, base[0], "x"), (0, base[1], "y"), (2, base[2], "x"), (3, base[3], "z"), (None, base[0], "n"),
                              (None, base[0], "n"), (4, "", "e"), (5, "", "e"), (6, None, "e")], key=str)


def _plain_near_duplicates(rows):
    """Rows ``(doc_id, text, lang, source, n_chars)`` that stay, by comparing all pairs of shingle sets."""
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first[g] = min(first.get(g, i), i, key=lambda k: (rows[k][0], k)) if rows[i][0] is not None else i
    return [r for i, r in enumerate(rows) if first[group[i]] == i]


def _plain_passages(rows, width=50):
    """Texts without the strings of ``width`` bytes that start in a document with a smaller id; characters go whole."""
    first = {}
    for r in rows:
        data = (r[1] or "").encode()
        for i in range(len(data) - width + 1):
            if r[0] is not None:
                s = data[i:i + width]
                first[s] = min(first.get(s, r[0]), r[0])
    out = []
    for r in rows:
        data = (r[1] or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if r[0] is not None and first[data[i:i + width]] < r[0]:
                gone[i:i + width] = [True] * width
        at, kept = 0, ""
        for c in r[1] or "":
            n = len(c.encode())
            if not any(gone[at:at + n]):
                kept += c
            at += n
        if not (any(gone) and not kept.strip()):
            out.append((r[0], kept, r[2], r[3], len(kept)) if r[1] is not None else (r[0], "", r[2], r[3], 0))
    return out


def _plain_mix(rows, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, seed=7):
    size = defaultdict(int)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    for r, n in zip(rows, words):
        size[r[3]] += n
    target = _targets(size, weights, share, most)
    out = []
    for r in rows:
        rate = target[r[3]] / size[r[3]] if size[r[3]] else 0.0
        u = int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{seed}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def test_run_equals_a_plain_chain(spark, tmp_path):
    """``run`` against the stages stated anew, on documents with repeated ids, nulls, copies and shared passages."""
    rng = random.Random(8)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select(
        "doc_id", "text", "lang", "source", "n_chars").collect() if len(r["text"]) < 4000]
    shared = "a passage of more than fifty bytes that several documents of the corpus repeat. "
    rows = list(docs)
    for i, r in enumerate(rng.sample(docs, 40)):
        words = r[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((5000 + i if i % 3 or i % 2 else r[0], " ".join(words) if i % 2 else r[1], r[2], r[3], r[4]))
        rows.append((6000 + i, shared + rng.choice(docs)[1][::-1][:300] + shared, r[2], None, None))
    a, b = rng.sample(docs, 2)
    rows += [(a[0], b[1][: len(b[1]) // 2] + " only here", b[2], "s", 1), (None, a[1], a[2], "s", 1), (None, b[1], None, "s", 1),
             (7000, None, "en", "s", None), (7001, "", "en", "s", 0), (7002, "123 456", "en", "s", 7)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, kinds)
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(table)
    texts = {r["text"]: r["rejected"] for r in langid.identify(table.select("text").distinct(), model).collect()}
    want = [r for r in rows if not texts[r[1]]]
    assert len(want) < len(rows)  # without a letter
    before = len(want)
    want = _plain_near_duplicates(want)
    assert len(docs) / 2 < len(want) < before - 20
    want = _plain_passages(want)
    want = _plain_mix(want)
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    want = sorted((str(r[0]), pieces.encode(r[1]) if r[1] else []) for r in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in load_all().items() if sql))
def test_oracle(spark, name):
    build, sql = load_all()[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = build(spark, SF), con.sql(sql)
    assert type_diffs(df.dtypes, rel.columns, rel.types) == {}
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0]


def test_one_query_per_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
