"""Language identification by nearest centroids of TF-IDF character n-grams.

A text is the vector of its 1- to 3-gram counts over lower-cased letters (anything else counts as
one blank), hashed to ``DIMS`` dimensions, log-scaled, weighted by inverse document frequency and
normalised. Each language is described by several centroids (spherical k-means over its training
vectors); the nearest centroid by cosine names the language. A text is *rejected* when it
has no letter or when its cosine is far below those that nearly all training texts of its length
have with centroids they took no part in. Training texts unlike the others of their label are
left out of the centroids, so a share of wrong or garbage rows does not move the limits.

The classifier is fitted on a bounded sample (``FIT_ROWS`` documents per language, chosen by a
hash) on the driver; prediction runs over all whole texts in Arrow batches with fixed memory.

Defined cases: null text, text without a letter and every text when nothing could be learned give
``und`` with score 0 and are rejected; ties go to the first language in order; repeated rows are
predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import read_table
from ._common import PASS_BYTES, fold_of, passes, register, utf8

DIMS = 4096
#: Documents per language that the classifier is fitted on, and centroids per language.
FIT_ROWS, CENTROIDS = 600, 4
#: Documents whose vectors are held at once.
BLOCK = 512
#: Rejection: below this share of the cosine that all but ``TAIL`` of the training texts, cut to
#: the same length class, have. ``TRIM`` likewise leaves texts out of the centroids.
REACH, TRIM, TAIL = 0.4, 0.6, 0.1
#: Folds of the cross-fit, the least texts that set a limit, and the most that are cut for a class.
FOLDS, LEAST, CUT_ROWS = 4, 20, 400
#: Distance allowed where there are too few training texts to set a limit.
SHORT_RADIUS = 0.95
#: Sharpness of the score over the languages' best cosines.
SHARPNESS = 20.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-cased letter of each code point, 0 for anything but a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the position of each one's first byte."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(3, np.uint8)])
    first = b[at].astype(np.uint32)
    out = first.copy()
    for low, mask, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        many = np.flatnonzero(first >= low)
        x = first[many] & mask
        for i in range(1, n + 1):
            x = (x << 6) | (b[at[many] + i] & 0x3F)
        out[many] = np.minimum(x, 0x10FFFF)
    return out, at


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts ``(documents, DIMS)`` and letters of each document, in pieces of
    ``PASS_BYTES`` so that a very long text needs no more memory than a short one."""
    n = len(offsets) - 1
    counts = np.zeros(n * DIMS, np.float32)
    n_letters = np.zeros(n, np.int64)
    for start in range(0, len(raw), PASS_BYTES):
        end = min(len(raw), start + PASS_BYTES)
        points, at = code_points(raw[start:end + 12])
        if not len(at):
            continue
        at = at + start
        x = letters()[points]
        doc = np.searchsorted(offsets, at, "right") - 1
        own = at < end
        n_letters += np.bincount(doc[own & (x > 0)], minlength=n)
        for k in (1, 2, 3):
            if k > len(x):
                break
            h = np.full(len(x) - k + 1, k, np.uint32)
            some = np.zeros(len(h), bool)
            for i in range(k):
                y = x[i:len(x) - k + 1 + i]
                h = (h + y) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                some |= y > 0
            h *= np.uint32(0x85EBCA6B)
            some &= own[:len(h)] & (doc[:len(h)] == doc[k - 1:])
            slot = doc[:len(h)][some] * DIMS + (h[some] >> np.uint32(32 - 12)).astype(np.int64)
            counts += np.bincount(slot, minlength=len(counts)).astype(np.float32)
    return counts.reshape(n, DIMS), n_letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64), 12)


class Model:
    """Centroids with the language of each, document frequencies and rejection radii."""

    def __init__(self, langs: list[str], centroids: np.ndarray, of: np.ndarray, idf: np.ndarray, radius: np.ndarray):
        self.langs, self.centroids, self.of, self.idf, self.radius = langs, centroids, of, idf, radius

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and rejection of each document."""
        counts, n_letters = gram_counts(raw, offsets)
        if not self.langs:
            n = len(n_letters)
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        cosine = (vectors(counts, self.idf) @ self.centroids.T).astype(np.float64)
        best = np.stack([cosine[:, self.of == k].max(axis=1) for k in range(len(self.langs))], 1)
        pick = best.argmax(axis=1)
        top = best.max(axis=1)
        weight = np.exp(SHARPNESS * (best - top[:, None]))
        score = 1 / weight.sum(axis=1)
        rejected = (n_letters == 0) | (1 - top > self.radius[length_class(n_letters)])
        names = np.array([*self.langs, "und"], dtype=object)[np.where(n_letters == 0, len(self.langs), pick)]
        return names.tolist(), np.where(n_letters == 0, 0.0, score), top, rejected


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; returns at most ``k`` unit centroids."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        of = (x @ c.T).argmax(axis=1)
        c = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(k)])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _usual(x: np.ndarray, n_letters: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Which texts are like the others of their label: near its mean, for their length class."""
    own = np.empty(len(x))
    for k in set(lang):
        mean = x[lang == k].sum(axis=0)
        own[lang == k] = x[lang == k] @ (mean / max(np.linalg.norm(mean), 1e-12))
    classes = length_class(n_letters)
    least, low = np.zeros(13), 0.0
    for c in range(13):  # a class with few texts has the limit of the next shorter one
        if (classes == c).sum() >= LEAST:
            low = TRIM * np.quantile(own[classes == c], TAIL)
        least[c] = low
    return own >= least[classes]


def _radius(texts: list[str], x: np.ndarray, n_letters: np.ndarray, lang: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Distance allowed for each length class, from texts cut to the class and centroids of other folds."""
    fold = np.arange(len(x)) % FOLDS
    rng = np.random.default_rng(1)
    cents = []
    for f in range(FOLDS):
        there = [(fold != f) & (lang == k) for k in sorted(set(lang))]
        cents.append([_kmeans(x[t], CENTROIDS, rng) for t in there if t.any()])
    radius, last = np.empty(13), SHORT_RADIUS
    for c in range(13):
        rows = np.flatnonzero(n_letters >= 1 << c)
        rows = rows[::max(1, -(-len(rows) // CUT_ROWS))]
        rows = rows[[len(cents[f]) > 0 for f in fold[rows]]]
        if len(rows) >= LEAST:
            cut = [texts[i][:max(1, int(len(texts[i]) * min(1.0, 1.5 * 2 ** c / n_letters[i])))] for i in rows]
            counts, some = gram_counts(*utf8(pa.array(cut, pa.string())))
            v = vectors(counts, idf)
            cosine = np.array([max((y @ z.T).max() for z in cents[f]) for y, f in zip(v, fold[rows])])
            if (some > 0).sum() >= LEAST:
                last = 1 - REACH * np.quantile(cosine[some > 0], TAIL)
        radius[c] = last
    return radius


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS,
        key_col: str = "doc_id") -> Model:
    """Fit on about ``fit_rows`` documents of each language, picked by a hash of ``key_col``."""
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, F.lit(11)).alias("h"))
    counted = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    langs = sorted(counted)
    if not langs:
        return Model([], np.empty((0, DIMS), np.float32), np.empty(0, np.int64), np.empty(0), np.empty(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / counted[k]))])
    draw = (F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64
    rows = train.where(draw < share[F.col("lang")]).select("lang", "text").toArrow()
    raw, offsets = utf8(rows.column("text"))
    lang = np.array(rows.column("lang").to_pylist(), dtype=object)
    parts = [gram_counts(raw[offsets[a]:offsets[min(a + BLOCK, len(lang))]],
                         offsets[a:a + BLOCK + 1] - offsets[a]) for a in range(0, len(lang), BLOCK)]
    counts, n_letters = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((counts.sum(axis=1), n_letters, lang.astype(str)))  # whatever order Spark gave
    order = order[n_letters[order] > 0]
    counts, n_letters, lang = counts[order], n_letters[order], lang[order]
    if not len(order):
        return Model([], np.empty((0, DIMS), np.float32), np.empty(0, np.int64), np.empty(0), np.empty(0))
    idf = (np.log((len(lang) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
    x = vectors(counts, idf).astype(np.float32)
    usual = _usual(x, n_letters, lang)
    x, n_letters, lang, order = x[usual], n_letters[usual], lang[usual], order[usual]
    rng = np.random.default_rng(0)
    langs = [k for k in langs if (lang == k).any()]
    cents = [_kmeans(x[lang == k], CENTROIDS, rng) for k in langs]
    of = np.repeat(np.arange(len(langs)), [len(c) for c in cents])
    texts = rows.column("text").take(pa.array(order)).to_pylist()
    radius = _radius(texts, x, n_letters, lang, idf)
    return Model(langs, np.concatenate(cents), of, idf, radius)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, cosine, rejected`` (which replace columns so named)."""
    added = ["lang_pred", "score", "cosine", "rejected"]
    base = docs.drop(*added)
    at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                for rows, raw, offsets in passes(batch.slice(a, BLOCK), batch.schema.names[at]):
                    lang, score, cosine, rejected = shared.value.predict(raw, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                         pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())],
                        names=[*rows.schema.names, *added])
    schema = StructType(base.schema.fields[:])
    for name, kind in zip(added, ("string", "double", "double", "boolean")):
        schema = schema.add(name, kind)
    return base.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                for rows, raw, offsets in passes(batch.slice(a, BLOCK), batch.schema.names[at]):
                    yield rows.filter(pa.array(~shared.value.predict(raw, offsets)[3]))
    return docs.mapInArrow(run, docs.schema)


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "cosine")
