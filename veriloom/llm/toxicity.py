"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states per word (clean, toxic), a chain per document. A word's emission is a sum of hashed
feature weights (the word, its beginnings and endings, its length); transitions are learned too.

Labelled tokens: a document labelled clean labels all of its tokens clean; one labelled toxic
says that some token of it is toxic. The field is fitted to just that: clean documents by the
likelihood of the all-clean tagging, toxic ones by the likelihood of every other tagging
(constrained forward-backward), by gradient ascent on the driver. The sample of labelled rows is
bounded by TRAIN_TOXIC and TRAIN_CLEAN rows of at most TRAIN_CHARS characters each, drawn by a
hash of the key; nothing else is bounded, and scoring reads every whole text.

A document's score is a calibrated function of two aggregates of its marginals: the log odds of its
likeliest toxic token, and the expected number of toxic tokens among those with a marginal of at
least FAINT; below that marginals don't count, or any clean text would be toxic if only long enough. Spans are runs of tokens whose marginal is
at least SPAN_MARGINAL, as code point offsets.

Scale: one broadcast join of the bounded sample, then a map over documents without a shuffle; a
worker remembers emissions by word. Scoring a batch runs forward-backward over all its tokens at
once, in blocks, so that one very long text costs no more than many short ones.

Defined results: null and empty texts have no token and get the calibrated score of none; rows
and labels may repeat (a document's label is its largest); without labels of both kinds among the
rows to learn from, all scores are the share of toxic labels there (0 without labels); columns of
the output's names are replaced, and others of any name are carried along.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, whole

TRAIN_TOXIC = 2000
TRAIN_CLEAN = 2000
TRAIN_CHARS = 30_000
EPOCHS = 30
BATCH_TOKENS = 250_000
RIDGE = 0.05
BITS = 18
SPAN_MARGINAL = 0.5
FAINT = 0.1
THRESHOLD = 0.7
#: Texts that are scored together.
SCORED = 256
REMEMBERED = 150_000
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&+-=_/\\"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def core(word: bytes) -> str:
    """What of a word its features look at."""
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def features(w: str) -> list[int]:
    """Hashed features of a word's core: a fixed number, so that they form a matrix."""
    n = min(len(w), 15)
    told = [f"w{w}", *(f"p{w[:k]}" for k in range(2, 8)), f"s{w[-3:]}", f"s{w[-4:]}", f"n{n}", f"q{w[:4]}|{n}", f"r{w[:6]}|{n}"]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in told]


class Chain:
    """Forward-backward over the tokens of many documents laid end to end."""

    def __init__(self, x: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray, start: float):
        """x: exp(emission) by token; first, last: whether it begins or ends a document."""
        self.n = n = len(x)
        steps = max(1, int(np.sqrt(n)))
        width = -(-n // steps) if n else 0
        t00, t01, t10, t11 = np.exp(trans)
        pad = steps * width - n
        grid = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(width, steps).T.copy()
        xs, fs, ls = grid(x, 1.0), grid(first, True), grid(last, True)
        back = np.concatenate([x[1:], np.ones(1 + pad)]).reshape(width, steps).T.copy() if n else xs
        s = np.exp(start)
        # a document's beginning forgets what was before, its end what comes after
        f00, f10 = np.where(fs, 1.0, t00), np.where(fs, 1.0, t10)
        f01, f11 = np.where(fs, s, t01) * xs, np.where(fs, s, t11) * xs
        b00, b01 = np.where(ls, 1.0, t00), np.where(ls, 0.0, t01 * back)
        b10, b11 = np.where(ls, 1.0, t10), np.where(ls, 0.0, t11 * back)
        ratio = self._scan(f00, f10, f01, f11, range(steps), range(width))
        rest = self._scan(b00, b01, b10, b11, range(steps)[::-1], range(width)[::-1])
        flat = lambda a: a.T.reshape(-1)[:n]
        self.r, self.q = flat(ratio), flat(rest)
        before = np.concatenate([[1.0], self.r[:-1]]) if n else self.r
        self.log_scale = np.where(first, 0.0, np.log(t00 + t10 * before))
        odds = self.r * self.q
        self.marginal = odds / (1 + odds)
        self.trans, self.first, self.last = trans, first, last
        self.x, self.before = x, before

    @staticmethod
    def _scan(a, b, c, d, rows, columns):
        """r[i] = (c + d r[i-1]) / (a + b r[i-1]) along rows, column after column."""
        width = a.shape[1]
        p, q, r, s = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
        for i in rows:  # the product of each column's steps
            p, q, r, s = a[i] * p + b[i] * r, a[i] * q + b[i] * s, c[i] * p + d[i] * r, c[i] * q + d[i] * s
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
        begin, at = np.ones(width), 1.0
        for j in columns:
            begin[j] = at
            at = (r[j] + s[j] * at) / max(p[j] + q[j] * at, 1e-300)
            at = min(max(at, 1e-200), 1e200)
        out, now = np.empty_like(a), begin
        for i in rows:
            now = np.clip((c[i] + d[i] * now) / (a[i] + b[i] * now), 1e-200, 1e200)
            out[i] = now
        return out

    def log_clean(self, doc: np.ndarray, docs: int) -> np.ndarray:
        """Log probability of the all-clean tagging by document."""
        inner = np.where(self.first, 0.0, self.trans[0]) - self.log_scale - np.where(self.last, np.log1p(self.r), 0.0)
        return np.minimum(np.bincount(doc, inner, docs), -1e-12)

    def pair_expectations(self, weight: np.ndarray) -> np.ndarray:
        """Expected numbers of transitions 00, 01, 10, 11, weighted by token."""
        t = np.exp(self.trans)
        with np.errstate(over="ignore", invalid="ignore"):
            u = self.x * self.q
            parts = np.stack([np.full(self.n, t[0]), t[1] * u, t[2] * self.before, t[3] * self.before * u])
            parts = parts / parts.sum(0)
        return (parts * np.where(self.first, 0.0, weight)).sum(1)


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each token, and whether it is its first or last."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    return doc, first, last


def aggregates(chain: Chain, doc: np.ndarray, docs: int) -> np.ndarray:
    """By document: log odds of the likeliest toxic token, and log of one plus the expected number of them."""
    top = np.full(docs, 1e-6)
    np.maximum.at(top, doc, chain.marginal)
    odds = np.log(top) - np.log1p(-np.minimum(top, 1 - 1e-9))
    return np.stack([np.clip(odds, -12, 12), np.log1p(np.bincount(doc, np.where(chain.marginal >= FAINT, chain.marginal, 0.0), docs))], 1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge, and steps halved until the loss falls."""
    a = np.c_[x, np.ones(len(x))]
    ridge = np.array([1e-2] * x.shape[1] + [1e-6])
    loss = lambda w: float((weight * (np.logaddexp(0, a @ w) - y * (a @ w))).sum() + (ridge * w * w).sum() / 2)
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge) + 1e-9 * np.eye(len(w)), a.T @ (weight * (p - y)) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(texts: list[bytes], labels: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS) -> dict:
    """The field and its calibration. weight: rows of the corpus that a row stands for."""
    labels = np.asarray(labels, float)
    weight = np.ones(len(labels)) if weight is None else weight
    share = float(np.average(labels, weights=weight)) if len(labels) else 0.0
    if not 0 < labels.sum() < len(labels):
        return {"share": share}
    types: dict[bytes, int] = {}
    words = [np.array([types.setdefault(w, len(types)) for w in t.split()], np.int32) for t in texts]
    if not types:
        return {"share": share}
    matrix = np.array([features(core(w)) for w in types], np.int32)
    # a quarter of each label's rows is kept for the calibration
    own = np.ones(len(texts), bool)
    for kind in (0, 1):
        own[np.flatnonzero(labels == kind)[3::4]] = False
    trans, start = np.array([2.0, -2.0, 0.0, 0.0]), -3.0
    w = np.zeros(1 << BITS)
    bias = -4.0
    pick = [i for i in range(len(texts)) if own[i] and len(words[i])]
    # documents dealt to batches of about BATCH_TOKENS, which bounds what the driver holds at once
    batches = max(4, round(sum(len(words[i]) for i in pick) / BATCH_TOKENS))
    parts = [pick[b::batches] for b in range(batches)]
    parts = [(np.concatenate([words[i] for i in part]), labels[part], _layout(np.array([len(words[i]) for i in part]))) for part in parts if part]
    moments = {k: [0.0, 0.0] for k in ("w", "t", "s")}
    k, n_step, most = matrix.shape[1], 0, epochs * len(parts)
    for tokens, y, (doc, first, last) in parts * epochs:
        n_step += 1
        emission = w[matrix].sum(1) + bias
        chain = Chain(np.exp(np.clip(emission, -30, 30))[tokens], first, last, trans, start)
        p0 = np.exp(chain.log_clean(doc, len(y)))
        # d loglik / d log P(all clean): 1 for clean documents, -P0/(1-P0) for toxic ones
        by_token = np.where(y > 0, -p0 / np.maximum(1 - p0, 1e-3), 1.0)[doc]
        down = -chain.marginal * by_token
        by_type = np.bincount(tokens, down, len(matrix))
        grad_w = np.bincount(matrix.ravel(), np.repeat(by_type, k), 1 << BITS) - RIDGE / len(parts) * w
        inner = np.where(first, 0.0, by_token).sum()
        grad_t = np.array([inner, 0, 0, 0]) - chain.pair_expectations(by_token) - 0.1 * trans
        grad_s = float((down * first).sum())
        rate = 0.08 if n_step < most * 0.6 else 0.03
        for name, g in (("w", grad_w), ("t", grad_t), ("s", np.array(grad_s))):
            m = moments[name]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            step = rate * (m[0] / (1 - 0.9**n_step)) / (np.sqrt(m[1] / (1 - 0.99**n_step)) + 1e-6)
            if name == "w":
                w += step
            elif name == "t":
                trans = trans + step
            else:
                start += float(step)
    model = {"weights": w.astype(np.float32), "bias": bias, "trans": trans, "start": start, "share": share}
    held = [i for i in range(len(texts)) if not own[i]]
    lengths = np.array([len(words[i]) for i in held])
    emission = np.exp(np.clip(w[matrix].sum(1) + bias, -30, 30))
    doc, first, last = _layout(lengths)
    told = np.concatenate([words[i] for i in held]) if held else np.zeros(0, np.int32)
    found = aggregates(Chain(emission[told], first, last, trans, start), doc, len(held))
    model["calibration"] = _fit_logistic(found, labels[held], weight[held] / weight[held].mean())
    return model


class Scorer:
    """Scores and spans of texts under a model; remembers emissions by word."""

    def __init__(self, model: dict):
        self.model, self.known, self.cores = model, {}, {}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        known, cores = self.known, self.cores
        if len(known) > REMEMBERED:
            known.clear()
            cores.clear()
        new = {w: core(w) for w in {*words}.difference(known)}
        if unseen := [*{*new.values()}.difference(cores)]:
            value = self.model["weights"][np.array([features(c) for c in unseen], np.int32)].sum(1, dtype=np.float64) + self.model["bias"]
            cores.update(zip(unseen, np.exp(np.clip(value, -30, 30)).tolist(), strict=True))
        known.update((w, cores[c]) for w, c in new.items())
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by text, marginals by token, and the number of tokens by text."""
        words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        if "weights" not in self.model:
            return np.full(len(texts), self.model["share"]), np.zeros(int(lengths.sum())), lengths
        flat = [w for ws in words for w in ws]
        doc, first, last = _layout(lengths)
        chain = Chain(self.emissions(flat), first, last, self.model["trans"], self.model["start"])
        found = aggregates(chain, doc, len(texts))
        score = 1 / (1 + np.exp(-np.clip(np.c_[found, np.ones(len(texts))] @ self.model["calibration"], -30, 30)))
        return score, chain.marginal, lengths


def spans(text: bytes, marginal: np.ndarray) -> list[list]:
    """Runs of offending tokens as [start, end, largest marginal], in code points."""
    out: list[list] = []
    at = chars = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if marginal[i] < SPAN_MARGINAL:
            continue
        chars += len(text[at : m.start()].decode("utf-8", "replace"))
        begin = chars
        chars += len(m[0].decode("utf-8", "replace"))
        at = m.end()
        if out and out[-1][3] == i - 1:
            out[-1][1:] = [chars, max(out[-1][2], float(marginal[i])), i]
        else:
            out.append([begin, chars, float(marginal[i]), i])
    return [x[:3] for x in out]


def learned_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", key: str = "doc_id") -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bounded sample: texts, labels, and how many labelled rows each stands for."""
    told = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(may_learn)
    counts = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for kind, bound in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        some = told.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = some if picked is None else picked.unionByName(some)
    body = docs.select(F.col(key).alias("doc_id"), whole(text).alias("body")).filter(F.length("body") <= TRAIN_CHARS)
    # at most TRAIN_TOXIC + TRAIN_CLEAN rows of a number and a flag; equal doc_ids count once
    rows = body.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("body").cast("binary").alias("body"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["toxic"] for r in rows], int)
    stands = np.array([counts.get(int(k), 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return [bytes(r["body"]) for r in rows], y, stands[y] if len(y) else np.zeros(0)


def score_documents(docs: DataFrame, model: dict, text: str = "text", score: str = "score", spans_as: str | None = "spans") -> DataFrame:
    """docs with a score, and offending offsets as a JSON list of [start, end, marginal], in place of
    columns of these names."""
    kept = [c for c in docs.columns if c not in (score, spans_as)]
    width = len(kept)
    if text in kept and docs.schema[text].dataType == T.StringType():
        at_text, docs = kept.index(text), docs.select(kept)
    else:  # a column that the output replaces, or that is named or typed another way
        at_text, docs = width, docs.select(*kept, whole(text).alias(free_name(docs, "body")))
    schema = T.StructType([*docs.schema.fields[:width], T.StructField(score, T.DoubleType()), *([T.StructField(spans_as, T.StringType())] if spans_as else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(model)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, SCORED):
                batch = whole_batch.slice(at, SCORED)
                texts = [t or b"" for t in batch.column(at_text).cast(pa.binary()).to_pylist()]
                value, marginal, lengths = scorer(texts)
                columns = [*batch.columns[:width], pa.array(value)]
                if spans_as:
                    ends = np.cumsum(lengths)
                    peak = np.maximum.reduceat(np.r_[marginal, 0], np.minimum(ends - lengths, len(marginal))) if len(texts) else marginal
                    columns.append(pa.array([json.dumps([[s, e, round(p, 4)] for s, e, p in spans(t, marginal[e0 - n : e0])]) if n and top >= SPAN_MARGINAL else "[]" for t, n, e0, top in zip(texts, lengths, ends, peak, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(run, schema)


def fold(key: str = "doc_id") -> Column:
    """The remainder that decides what may be learned from: 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3))


def learn(spark: SparkSession, sf_dir: str) -> dict:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit(*learned_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold() != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
