"""Chat formatting, mixing: round trips, targets, oracle SQL, odd inputs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mediashelf.llm import chat, mixing


def _chat_model(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 2, "user", "<\\|im_start|> \\ <\\\\| <|"),
    (1, 3, "assistant", "😀 ok"), (1, 4, "user", "tail"), (2, 0, "system", None), (3, 0, "assistant", ""),
    (4, 1, "ro\nle", "x\ny"), (4, None, None, "null turn"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"),
    (None, 0, "assistant", "no conversation"), (5, 0, "assistant", "a" * 100_000),
]


@pytest.fixture(scope="module")
def turns(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    return df.withColumn("example", F.lit("clash")).withColumn("parts", F.lit(1))


def test_chat_reads_back(turns):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat.chat_digest(chat.format_chats(turns)).collect()}
    assert got == _chat_model(ROWS)


def test_one_example_per_reply_with_its_context(turns):
    ex = [r for r in chat.format_chats(turns).where("conv_id = 1").orderBy("example").collect()]
    assert [r["loss_chars"] > 0 for r in ex] == [True, True, False]
    for a, b in zip(ex, ex[1:]):
        assert b["text"].startswith(a["text"])
    r = ex[1]
    assert r["text"][r["loss_start"]:r["loss_start"] + r["loss_chars"]] == "😀 ok"


def test_texts_cannot_forge_turns(turns):
    for r in chat.format_chats(turns).collect():
        bodies = re.sub(r"<\|im_start\|>|<\|im_end\|>|<\|n\|>", "", r["text"])
        assert "<|" not in bodies


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chats(df)).count() == 0


def _targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        level = (total - sum(target.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: most * sizes[s] for s in over}


def test_targets_equal_repeated_resharing(documents):
    plan = mixing.mix_plan(documents)
    rows = plan.groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t")).collect()
    want = _targets({r["source"]: r["n"] for r in rows})
    assert all(abs(r["t"] - want[r["source"]]) < 1e-6 * max(1, r["t"]) for r in rows)


def test_mix_copies(documents):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert max(plan.values()) <= 2
    assert plan == {r["doc_id"]: r["copies"] for r in mixing.mix_plan(documents.repartition(7)).collect()}


def test_mix_odd_rows(odd_docs):
    plan = mixing.mix_plan(odd_docs).collect()
    words = {r["doc_id"]: r["size"] for r in plan}
    assert words[2] == words[3] == words[4] == 0 and words[5] == 20_000 and words[7] == 5
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert "x" in {r["size"] for r in mixing.mix(odd_docs, share=2.0).collect()}
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    assert mixing.mix(odd_docs.where("doc_id = 2")).count() == 0
