"""Toxic spans and document scores from a linear-chain conditional random field.

Two states (clean, toxic) label every word. The labels table has one mark for
each document, so token labels are made from it: a word of a toxic document is
a toxic token if significantly more of the documents that have it, or its
beginning, are toxic than of all training documents; near copies count once.
The field has word, prefix, suffix and length features in a hashed table and
learned transitions. Forward-backward marginals give the offending offsets;
their sum, maximum and density give the document score through a logistic
calibration fitted on training documents that the field has not seen.

The classifier is fitted on a bounded sample of labelled rows: at most
``TRAIN_DOCS`` toxic documents and ``CLEAN_RATIO`` times as many clean ones, the
least by a hash of the id, each of at most ``TRAIN_CHARS`` characters; of these
``FIELD_DOCS`` of each class fit the field and a third calibrates the score.
Everything else covers all documents.

Defined results: a null text has a null score, no spans and is not toxic, an
empty one has score 0; rows are scored one by one, so repeated rows repeat; with
no labelled documents of a class nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.textvec import U64, Words, map_text, mix, slices, table

TRAIN_DOCS = 1200
CLEAN_RATIO = 3
FIELD_DOCS = 400
TRAIN_CHARS = 20_000
FEATURES = 1 << 18
THRESHOLD = 0.5
SPAN_MARGINAL = 0.5
#: Log likelihood ratio beyond which a word counts as toxic in a toxic training document.
SIGNIFICANCE = 6.0
_PREFIXES, _SUFFIX = (3, 4, 5, 6, 7), 3
_BLOCK = 64
SCHEMA = "doc_id bigint, score double, toxic boolean, n_spans int, starts array<int>, ends array<int>"


@dataclass
class Model:
    weights: np.ndarray  # emission weight of each hashed feature
    trans: np.ndarray  # log potentials [from, to]
    start: float
    doc: np.ndarray  # logistic weights of the document features and the bias


def features(w: Words) -> np.ndarray:
    """Hashed feature indices, one row for each kind of feature."""
    size = w.end - w.start
    out = [w.hash]
    for k, n in enumerate(_PREFIXES):
        out.append(mix(w.span_hash(w.start, np.minimum(w.start + n, w.end)) + U64(k + 1)))
    out.append(mix(w.span_hash(np.maximum(w.end - _SUFFIX, w.start), w.end) + U64(77)))
    out.append(mix(np.minimum(size, 20).astype(U64) + U64(999)))
    return np.stack([(h >> U64(20)).astype(np.int64) & (FEATURES - 1) for h in out])


def _f(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)


def _g(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)


def _scan(e: np.ndarray, fixed: np.ndarray, value: float, step) -> np.ndarray:
    """r[i] = e[i] + (value if fixed[i] else step(r[i - 1])), exactly, in blocks side by side.

    Blocks start from a guess and are repeated while the value that enters
    them differs from what the block before gave; clean text settles at once.
    """
    n = len(e)
    if n == 0:
        return e.copy()
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    ee = np.concatenate([e, np.zeros(pad, e.dtype)]).reshape(blocks, _BLOCK).T.copy()
    ff = np.concatenate([fixed, np.ones(pad, bool)]).reshape(blocks, _BLOCK).T.copy()
    out = np.empty_like(ee)
    enter = np.full(blocks, value, dtype=e.dtype)
    todo = np.arange(blocks)
    while len(todo):
        r = enter[todo]
        for j in range(_BLOCK):
            r = ee[j, todo] + np.where(ff[j, todo], value, step(r))
            out[j, todo] = r
        after = np.concatenate([[value], out[-1, :-1]]).astype(e.dtype)
        todo = np.flatnonzero((np.abs(after - enter) > 1e-9) & ~ff[0])
        enter = after
    return out.T.reshape(-1)[:n]


def chain(e: np.ndarray, off: np.ndarray, t: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log ratios and the marginals of the toxic state, for rows ``off`` of one flat array."""
    n = len(e)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    rows = np.diff(off) > 0
    first[off[:-1][rows]] = True
    last[off[1:][rows] - 1] = True
    r = _scan(e, first, start, lambda x: _f(x, t))
    # backward: c[i] = e[i] + b[i] with b[i] = g(c[i + 1]), b = 0 at the end of a row
    c = _scan(e[::-1], last[::-1], 0.0, lambda x: _g(x, t))[::-1]
    return r, c - e, 1.0 / (1.0 + np.exp(-np.clip(r + c - e, -60, 60)))


@dataclass
class Hashed:
    """Hashes of all words of a training sample, or of their first letters."""

    hash: np.ndarray
    doc: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


def hashed(text: pa.Array, prefix: int | None = None) -> Hashed:
    """The words of a sample, found in slices that keep the memory of the driver small."""
    hashes, counts = [], []
    for part in slices(pa.record_batch([text], names=["text"]), 0):
        w = Words(part.column(0))
        hashes.append(w.hash if prefix is None else w.span_hash(w.start, np.minimum(w.start + prefix, w.end)))
        counts.append(w.counts)
    count = np.concatenate(counts)
    return Hashed(np.concatenate(hashes), np.repeat(np.arange(len(count), dtype=np.int32), count), np.concatenate([[0], np.cumsum(count)]))


def clusters(w: Hashed, bands: int = 6) -> np.ndarray:
    """The least row of each row's group of near copies: rows that share two min-wise hashes of word trigrams."""
    n = w.n
    out = np.arange(n)
    long = np.flatnonzero(np.diff(w.off) >= 3)
    if not len(long):
        return out
    h = w.hash
    tri = mix(h[:-2] * U64(0x9E3779B97F4A7C15) ^ mix(h[1:-1] * U64(0xD6E8FEB86659FD93) ^ mix(h[2:])))
    tri[(w.doc[2:] != w.doc[:-2])] = U64(0xFFFFFFFFFFFFFFFF)
    for k in range(bands):
        key = np.zeros(len(long), U64)
        for j in (2 * k, 2 * k + 1):
            x = np.append(mix(tri ^ U64(j * 7919 + 1)), np.full(2, ~U64(0)))
            x[:-2][tri == ~U64(0)] = ~U64(0)
            key = mix(key * U64(31) ^ np.minimum.reduceat(x, w.off[long]))
        _, group = np.unique(key, return_inverse=True)
        for _ in range(8):
            least = np.full(group.max() + 1, n)
            np.minimum.at(least, group, out[long])
            out[long] = least[group]
            out = out[out]
    return out


def significant(w: Hashed, toxic: np.ndarray, group: np.ndarray, least: int, level: float) -> np.ndarray:
    """Words, one mark each, in at least ``least`` groups of toxic rows and of a significantly high toxic share.

    Significance is the log likelihood ratio of the word's own share against
    the share of the sample; a group of near copies counts once for each class.
    """
    word, inverse = np.unique(w.hash, return_inverse=True)
    own = group * 2 + toxic
    pair = np.unique(inverse.astype(np.int64) * (2 * w.n) + own[w.doc])
    of, bad = pair // (2 * w.n), (pair & 1).astype(bool)
    hit, miss = np.bincount(of[bad], minlength=len(word)), np.bincount(of[~bad], minlength=len(word))
    every = np.unique(own)
    base = np.clip((every & 1).mean(), 1e-9, 1 - 1e-9)
    share = np.clip(hit / np.maximum(hit + miss, 1), 1e-9, 1 - 1e-9)
    ratio = hit * np.log(share / base) + miss * np.log((1 - share) / (1 - base))
    return ((hit >= least) & (share > (1 + base) / 2) & (ratio > level))[inverse]


def token_labels(text: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic tokens of toxic rows, which are words, or words with a beginning, that are significantly toxic; and offsets of the rows."""
    w = hashed(text)
    group = clusters(w)
    bad = significant(w, toxic, group, 4, SIGNIFICANCE)
    for n in _PREFIXES[1:]:
        bad |= significant(hashed(text, n), toxic, group, 8, 2 * SIGNIFICANCE)
    return (bad & toxic[w.doc]).astype(np.float64), w.off


def fit_field(idx: np.ndarray, y: np.ndarray, off: np.ndarray, rounds: int = 25, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum likelihood of the field by Adam over the whole sample."""
    used, idx = np.unique(idx, return_inverse=True)
    idx = idx.reshape(-1, len(y))
    theta = np.zeros(len(used) + 6)  # weights, start, four transitions, bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(y)
    inner = np.ones(n, bool)
    inner[off[:-1][np.diff(off) > 0]] = False
    at = np.flatnonzero(inner)
    yi = y.astype(bool)
    gold = np.array([[np.sum(~yi[at - 1] & ~yi[at]), np.sum(~yi[at - 1] & yi[at])], [np.sum(yi[at - 1] & ~yi[at]), np.sum(yi[at - 1] & yi[at])]], dtype=float)
    for k in range(1, rounds + 1):
        wts, start, t = theta[: len(used)], theta[-6], theta[-5:-1].reshape(2, 2)
        e = wts[idx].sum(0) + theta[-1]
        r, b, p = chain(e, off, t, start)
        ahead = e[at] + b[at]
        lw = np.stack([np.full(len(at), t[0, 0]), t[0, 1] + ahead, t[1, 0] + r[at - 1], t[1, 1] + r[at - 1] + ahead])
        lw -= lw.max(0)
        np.exp(lw, out=lw)
        expect = (lw / lw.sum(0)).sum(1).reshape(2, 2)
        d = y - p
        grad = np.empty_like(theta)
        grad[: len(used)] = np.bincount(idx.ravel(), weights=np.tile(d, len(idx)), minlength=len(used)) - l2 * n * wts
        grad[-6] = d[~inner].sum()
        grad[-5:-1] = (gold - expect).ravel()
        grad[-1] = d.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    weights = np.zeros(FEATURES)
    weights[used] = theta[: len(used)]
    return np.concatenate([weights, theta[-1:]]), theta[-5:-1].reshape(2, 2).copy(), float(theta[-6])


def doc_features(p: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Expected toxic words, greatest marginal, density of toxic words and 1 for each row."""
    n = np.diff(off)
    cum = np.concatenate([[0.0], np.cumsum(np.where(p > 0.01, p, 0.0))])
    total = cum[off[1:]] - cum[off[:-1]]
    most = np.zeros(len(n))
    some = n > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, off[:-1][some])
    return np.stack([np.log1p(np.maximum(total, 0)), most, np.log(np.maximum(total, 1e-3) / np.maximum(n, 10)), np.ones(len(n))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def score_rows(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document scores and word marginals."""
    e = model.weights[features(w)].sum(0) + model.weights[-1]
    _, _, p = chain(e, w.off, model.trans, model.start)
    x = doc_features(p, w.off) @ model.doc
    return np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(x, -60, 60))), 0.0), p


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model | None:
    """The model of the labelled documents, None if either class has none."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    by = F.xxhash64("doc_id")
    pick = marks.where("toxic = 1").orderBy(by, "doc_id").limit(limit).union(marks.where("toxic = 0").orderBy(by, "doc_id").limit(CLEAN_RATIO * limit))
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").where(F.length("text").between(1, max_chars)).toArrow()
    rows = rows.group_by("doc_id").aggregate([("text", "min"), ("toxic", "max")])  # repeated rows count once
    rows = rows.sort_by("doc_id").select(["doc_id", "text_min", "toxic_max"])
    toxic = np.asarray(rows.column(2)).astype(bool)
    if not toxic.any() or toxic.all():
        return None
    text = rows.column(1).combine_chunks()
    y, off = token_labels(text, toxic)
    order = np.random.default_rng(11).permutation(len(toxic))
    own = np.zeros(len(toxic), bool)
    own[order[: -(-2 * len(toxic) // 3)]] = True
    if not (toxic[own].any() and (~toxic[own]).any() and toxic[~own].any() and (~toxic[~own]).any()):
        own[:] = True
    field = np.concatenate([order[own[order] & toxic[order]][:FIELD_DOCS], order[own[order] & ~toxic[order]][:FIELD_DOCS]])
    f = Words(text.take(pa.array(field)))
    pos = np.concatenate([np.arange(off[i], off[i + 1]) for i in field])
    weights, trans, start = fit_field(features(f), y[pos], f.off)
    model = Model(weights, trans, start, np.zeros(4))
    held = ~own if not own.all() else own
    seen = [doc_features(score_rows(model, v)[1], v.off) for v in (Words(p.column(0)) for p in slices(pa.record_batch([text.filter(pa.array(held))], names=["text"]), 0))]
    mark = toxic[held].astype(float)
    weight = np.where(mark > 0, share / max(mark.mean(), 1e-9), (1 - share) / max(1 - mark.mean(), 1e-9))
    model.doc = fit_logistic(np.concatenate(seen), mark, weight)
    return model


def _offsets(text: pa.Array, w: Words, rows: np.ndarray, p: np.ndarray) -> tuple[list, list]:
    """Character offsets of runs of toxic words in ``rows`` of ``text``."""
    raw = Words(text.take(pa.array(rows)), lower=False)
    char = np.concatenate([[0], np.cumsum((raw.buf & 0xC0) != 0x80)])
    starts, ends = [], []
    for k, i in enumerate(rows):
        bad = np.flatnonzero(p[w.off[i] : w.off[i + 1]] >= SPAN_MARGINAL)
        cut = np.flatnonzero(np.diff(bad) > 1)
        a, z = np.concatenate([bad[:1], bad[cut + 1]]), np.concatenate([bad[cut], bad[-1:]])
        base = char[raw.text_off[k]]
        starts.append((char[raw.start[raw.off[k] + a]] - base).tolist())
        ends.append((char[raw.end[raw.off[k] + z]] - base).tolist())
    return starts, ends


def scorer(model: Model | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        text = batch.column(1).fill_null("")
        null = np.asarray(batch.column(1).is_null())
        starts, ends = [[] for _ in range(n)], [[] for _ in range(n)]
        score = np.zeros(n)
        if model is not None:
            w = Words(text)
            score, p = score_rows(model, w)
            hit = np.unique(w.doc[p >= SPAN_MARGINAL])
            if len(hit):
                for i, s, e in zip(hit, *_offsets(text, w, hit, p)):
                    starts[i], ends[i] = s, e
        toxic = score >= THRESHOLD
        kind = pa.list_(pa.int32())
        return pa.record_batch([batch.column(0), pa.array(score, mask=null), pa.array(toxic), pa.array([len(s) for s in starts], pa.int32()), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "score", "toxic", "n_spans", "starts", "ends"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, verdict and offending character offsets of every document."""
    model = fit(docs, labels)
    return map_text(docs, ["doc_id", "text"], "text", scorer(model), SCHEMA)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches ``THRESHOLD`` go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, _ = score_rows(model, Words(batch.column(at)))
        return batch.filter(pa.array(score < THRESHOLD))

    return map_text(docs, docs.columns, "text", keep, docs.schema)
