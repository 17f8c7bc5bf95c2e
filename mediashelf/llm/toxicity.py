"""Toxicity by a linear-chain conditional random field over words.

Words (runs of letters, lower-cased) carry hashed features: the word and its 4-, 5- and 6-byte
prefixes. Training words get their labels from labelled documents: a word is labelled toxic where,
in a toxic document, one of its features is far more frequent among toxic training documents than
among the others. A two-state chain is fitted to windows round such words and to windows of
clean documents by gradient ascent on the conditional likelihood. Over all whole texts, forward and
backward messages give each word's marginal; expected toxic words and the highest marginal make
the document score (a logistic fit on the training documents, weighted to the labels' share), and
words with a marginal of one half or more make the offending spans.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS`` per label, by a hash) on the
driver; scoring covers every document with memory bounded by a group of texts.

Defined cases: null and empty texts score like texts without any toxic word; repeated rows score
alike; documents need no label; without both labels in training every score is the share of toxic labels (0
without labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import fold_of, mix64, passes, powers, register, utf8

#: Labelled documents of each label that the model is fitted on.
FIT_ROWS = 1500
#: Hashed feature space.
SLOT_BITS = 22
PREFIXES = (4, 5, 6)
#: A feature marks toxic words when it is so many times as frequent in toxic documents as in the
#: others, and the chance of that among all features (a Chernoff bound) is below this level.
MARK_RATIO, MARK_LEVEL = 12.0, 0.01
#: Words on each side of a labelled word in a training window.
CONTEXT = 8
#: Marginals below this do not add to a document's expected toxic words.
FLOOR = 0.1
#: Bytes of text whose chains run together.
GROUP_BYTES = 24 << 20


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots ``(words, 4)``, document index, and first and end byte of each word."""
    empty = np.empty(0, np.int64)
    if not len(raw):
        return np.empty((0, 1 + len(PREFIXES)), np.int32), empty, empty, empty
    b = raw.copy()
    b[(raw >= 65) & (raw <= 90)] += 32
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1  # capital letters with accents
    cap = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    b[cap] += 32
    letter = ((b >= 97) & (b <= 122)) | (b >= 0x80)
    edge = letter.copy()
    edge[1:] &= ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    edge[inner] = letter[inner]
    start = np.flatnonzero(edge)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    cut = offsets[1:][(offsets[1:] > 0)] - 1
    last[cut] = letter[cut]
    end = np.flatnonzero(last) + 1
    power, inverse = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    slots = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    for i, n in enumerate((1 << 40, *PREFIXES)):
        to = np.minimum(start + n, end)
        h = mix64((sums[to] - sums[start]) * inverse[start] + np.uint64(i))
        slots[:, i] = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    return slots, np.searchsorted(offsets, start, "right") - 1, start, end


def forward_backward(e: np.ndarray, trans: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginal of the toxic state at each position of several chains.

    ``e`` is the emission score of the toxic state against the other, ``trans[i, j]`` the score of
    going from ``i`` to ``j``; chains lie one after the other. The ratio of the two states'
    messages is one number per chain, so all chains advance together."""
    a = np.exp(trans)
    x = np.exp(np.clip(e, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    first, n = starts[order], lengths[order]
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")  # chains longer than t
    fwd = np.empty(len(e))
    ratio = np.ones(len(n))
    for t, k in enumerate(alive):
        at = first[:k] + t
        r = ratio[:k]
        new = x[at] if t == 0 else x[at] * (r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])
        fwd[at] = ratio[:k] = new
    bwd = np.ones(len(e))
    ends = first + n - 1
    ratio = np.ones(len(n))
    for t, k in enumerate(alive):
        if t:
            at = ends[:k] - t
            y = x[at + 1] * ratio[:k]
            bwd[at] = ratio[:k] = (a[1, 1] * y + a[1, 0]) / (a[0, 1] * y + a[0, 0])
    both = fwd * bwd
    return both / (1 + both)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, logit: np.ndarray):
        self.weights, self.bias, self.trans, self.logit = weights, bias, trans, logit

    def marginals(self, e: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
        lengths = np.bincount(docs, minlength=n_docs)
        some = lengths > 0
        return forward_backward(e, self.trans, (np.cumsum(lengths) - lengths)[some], lengths[some])

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(axis=1) + self.bias

    def scores(self, m: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
        z = _summary(m, docs, n_docs) @ self.logit
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _summary(m: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Columns: 1, log of expected toxic words, highest marginal. Marginals under ``FLOOR`` count
    as none: in a very long text they would add up to several words."""
    top = np.zeros(n_docs)
    np.maximum.at(top, docs, m)
    some = m >= FLOOR
    return np.stack([np.ones(n_docs), np.log1p(np.bincount(docs[some], m[some], minlength=n_docs)), top], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        w += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w), -4, 4)
    return w


def _train_chain(slots: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Fit emission weights, bias and transitions to labelled windows, one after the other (Adam)."""
    size = 1 << SLOT_BITS
    used, index = np.unique(slots, return_inverse=True)
    index = index.reshape(slots.shape)
    theta = np.zeros(len(used) + 5)  # slot weights, bias, four transitions
    theta[len(used)] = -2.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    starts = np.cumsum(lengths) - lengths
    steps = np.arange(lengths.max())
    there = steps < lengths[:, None]  # one window per row, shorter ones filled up
    grid = np.where(there, starts[:, None] + steps, 0)
    both, yy = there[:, 1:], y[grid]
    pairs = np.array([[(both & (yy[:, :-1] == i) & (yy[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, 121):
        w, bias, trans = theta[:len(used)], theta[len(used)], theta[len(used) + 1:].reshape(2, 2)
        e = w[index].sum(axis=1) + bias
        m = forward_backward(e, trans, starts, lengths)
        # expected transitions: pair marginals from forward ratio, scores and backward ratio
        x, a = np.exp(np.clip(e, -30, 30)), np.exp(trans)
        mm = np.clip(m, 1e-12, 1 - 1e-12)
        fwd, bwd = _ratios(x[grid], a, there)
        f, b = fwd[:, :-1], bwd[:, 1:] * x[grid[:, 1:]]
        p11, p10, p01, p00 = f * a[1, 1] * b, f * a[1, 0], a[0, 1] * b, np.full_like(f, a[0, 0])
        total = p11 + p10 + p01 + p00
        expected = np.array([[(p / total)[both].sum() for p in row] for row in ((p00, p01), (p10, p11))])
        d = y - mm
        grad = np.concatenate([np.bincount(index.ravel(), np.repeat(d, slots.shape[1]), minlength=len(used)),
                               [d.sum()], (pairs - expected).ravel()])
        grad -= 0.05 * theta
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad ** 2
        theta += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = theta[:len(used)]
    return weights, float(theta[len(used)]), theta[len(used) + 1:].reshape(2, 2)


def _ratios(x: np.ndarray, a: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward message ratios of chains, one per row, which has the positions ``there``."""
    f, b = np.empty_like(x), np.ones_like(x)
    f[:, 0] = x[:, 0]
    for t in range(1, x.shape[1]):
        f[:, t] = x[:, t] * (f[:, t - 1] * a[1, 1] + a[0, 1]) / (f[:, t - 1] * a[1, 0] + a[0, 0])
        y = x[:, -t] * b[:, -t]
        b[:, -t - 1] = np.where(there[:, -t], (a[1, 1] * y + a[1, 0]) / (a[0, 1] * y + a[0, 0]), 1.0)
    return f, b


def _windows(docs: np.ndarray, hit: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the training windows, one after the other, and their lengths: round the toxic
    documents' labelled words and, as often again, round evenly spaced words of the other documents.
    A window has ``2 * CONTEXT + 1`` words, moved into its document, or the whole of a shorter one."""
    length = 2 * CONTEXT + 1
    centre = np.flatnonzero(hit)
    clean = np.flatnonzero(~toxic[docs])
    clean = clean[::max(1, len(clean) // max(2000, 2 * len(centre)))] if len(clean) else clean
    at = np.concatenate([centre, clean])
    low, high = (np.searchsorted(docs, docs[at], side) for side in ("left", "right"))
    first = np.maximum(np.minimum(at - CONTEXT, high - length), low)
    lengths = np.minimum(first + length, high) - first
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()), lengths


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id",
        fit_rows: int = FIT_ROWS, docs: DataFrame | None = None) -> Model:
    """Fit on at most about ``fit_rows`` documents of each label, picked by a hash of the key.

    ``labelled`` has the key and a 0/1 label; the texts come from ``docs`` by the key (a join
    with the sample only) or, without ``docs``, from ``labelled`` itself."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull())
    counted = {int(r[0]): r[1] for r in rows.groupBy(label_col).count().collect()}
    prior = counted.get(1, 0) / max(1, sum(counted.values()))
    flat = Model(np.zeros(1 << SLOT_BITS, np.float32), -30.0, np.zeros((2, 2)),
                 np.array([np.log(prior / (1 - prior)) if 0 < prior < 1 else 30.0 * (2 * prior - 1), 0.0, 0.0]))
    if len(counted) < 2:
        return flat
    draw = (F.xxhash64(key_col, F.lit(13)).cast("double") + 2.0 ** 63) / 2.0 ** 64
    share = F.when(F.col(label_col) == 1, min(1.0, fit_rows / counted[1])).otherwise(min(1.0, fit_rows / counted[0]))
    sample = rows.where(draw < share)
    if docs is not None:
        sample = docs.select(key_col, text_col).join(F.broadcast(sample.select(key_col, label_col).distinct()), key_col)
    table = sample.where(F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).alias("y"), F.xxhash64(key_col).alias("h")).toArrow()
    # whatever order Spark gave; of equal texts the first only
    table = table.sort_by([("h", "ascending")])
    first = {t: i for i, t in reversed(list(enumerate(table.column("text").to_pylist())))}
    table = table.take(sorted(first.values()))
    toxic = table.column("y").to_numpy().astype(bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return flat
    raw, offsets = utf8(table.column("text"))
    slots, doc, _, _ = words(raw, offsets)
    # labels: features far more frequent in toxic documents
    hit = np.zeros(len(doc), bool)
    for i in range(slots.shape[1]):
        used, slot = np.unique(slots[:, i], return_inverse=True)
        pair = np.unique(doc.astype(np.int64) * len(used) + slot)
        of, own = pair // len(used), pair % len(used)
        pos = np.bincount(own[toxic[of]], minlength=len(used))
        neg = np.bincount(own[~toxic[of]], minlength=len(used))
        ratio = ((pos + 0.5) / (toxic.sum() + 1)) / ((neg + 0.5) / ((~toxic).sum() + 1))
        n, q = np.maximum(pos + neg, 1), toxic.mean()
        p = np.clip(pos / n, 1e-9, 1 - 1e-9)
        surprise = n * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q)))
        hit |= ((surprise > np.log(len(used) / MARK_LEVEL)) & (ratio >= MARK_RATIO))[slot]
    hit &= toxic[doc]
    if not hit.any():
        return flat
    at, lengths = _windows(doc, hit, toxic)
    weights, bias, trans = _train_chain(slots[at], hit[at].astype(float), lengths)
    model = Model(weights, bias, trans, np.zeros(3))
    m = model.marginals(model.emissions(slots), doc, len(toxic))
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    model.logit = _logistic(_summary(m, doc, len(toxic)), toxic.astype(float), weight)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, spans)``: spans are byte ranges of the UTF-8 text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(group: list) -> pa.RecordBatch:
        model = shared.value
        ids = pa.concat_arrays([g[0] for g in group])
        n = np.cumsum([0] + [len(g[0]) for g in group])
        e = np.concatenate([g[1] for g in group])
        doc = np.concatenate([g[2] + n[i] for i, g in enumerate(group)])
        start, end = (np.concatenate([g[k] for g in group]) for k in (3, 4))
        m = model.marginals(e, doc, len(ids))
        s = model.scores(m, doc, len(ids))
        lists: list[list] = [[] for _ in range(len(ids))]
        bad = np.flatnonzero(m >= 0.5)
        for i in bad.tolist():
            own = lists[doc[i]]
            if own and i > 0 and m[i - 1] >= 0.5 and doc[i - 1] == doc[i]:
                own[-1]["end"] = int(end[i])
            else:
                own.append({"start": int(start[i]), "end": int(end[i])})
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(lists, span)],
            names=["doc_id", "score", "predicted", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], 0
        for batch in batches:
            for rows, raw, offsets in passes(batch):
                slots, doc, start, end = words(raw, offsets)
                own = offsets[doc]
                group.append((rows.column(0).cast(pa.int64()), shared.value.emissions(slots), doc, start - own, end - own))
                held += len(raw) + 1000 * rows.num_rows
                if held >= GROUP_BYTES:
                    yield finish(group)
                    group, held = [], 0
        if group:
            yield finish(group)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>")


@register("op2_toxicity_crf")
def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    model = fit(labels.where(fold_of("doc_id", 5) != 0).select("doc_id", "toxic"), docs=docs)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
