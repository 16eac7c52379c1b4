"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1 outside the held-out fold;
unlabelled is web text from the documents. With the class prior p the risk

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

is minimised (Kiryo et al. 2017; l is the logistic loss), where a step whose
second part is negative climbs it back instead. g is a small network over
features of the whole text; its logistic is the score, that quality is 1.

The prior is estimated from positives and unlabelled texts alone, by the best
bin (Garg et al. 2021): a network fitted on half of both samples scores the other
half; at any threshold, the share of unlabelled texts above it over the share of
positives above it is no less than the prior but for chance, so the least such
ratio plus its margin is taken. Labels of quality 0 are never used.

Both samples are bounded: at most `sample` ids each, those of least hash, and
one row an id, the one of least text hash. Features are shares, so a text's
length does not matter, and are counted over bytes and words of the whole text.

Cases: null text counts as empty, and gets a score too. No labels, or no
positives: every score is 0.5 and every document is kept. Several labels of a
doc_id: it is trusted if any is 1. Repeated rows score alike; extra columns pass through
`with_score` unless they carry its names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import slices, tidied

SAMPLE, THRESHOLD, FOLDS, SEED = 20_000, 0.3, 5, 11
HIDDEN, STEPS, PRIOR_STEPS, RATE, DECAY = 16, 600, 150, 0.02, 1e-3
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes whose shares are features; bytes of one class count together.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n\r",
    "stop": b".,;:?",
    "shout": b"!",
    "mark": b"#$%&*+=@^_~|\\/<>",
    "quote": b"'\"`()[]{}",
    "dash": b"-",
    "high": bytes(range(128, 256)),
}
SINGLE = b"!#$%&*+/=@|~<>_\\"
NAMES = [*CLASSES, *(f"byte{b}" for b in SINGLE), "words", "distinct_words", "top_word", "again_word", "letters_per_word", "long_words", "upper_words", "pure_mark_words", "lines", "distinct_lines", "entropy", "empty"]


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256).astype(np.float64)
    share = lambda x: float(h[list(x)].sum()) / n
    words = b.split()
    w = max(1, len(words))
    distinct = set(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = b.split(b"\n")
    p = h[h > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    marks = sum(map(bytes.isupper, words))
    bare = w - sum(map(bytes.isalpha, words)) if words else 0
    top = h[[*range(65, 91), *range(97, 123)]].max() / n
    return [
        *(np.log1p(50 * share(c)) for c in CLASSES.values()),
        *(np.log1p(100 * h[x] / n) for x in SINGLE),
        np.log1p(w) / 5,
        np.log(w / max(1, len(distinct))),
        float(top),
        repeats / w,
        np.log1p(float(sizes.mean())),
        float((sizes > 20).mean()),
        marks / w,
        bare / w,
        np.log1p(len(lines)) / 5,
        np.log(len(lines) / len(set(lines))),
        float(-(p * np.log2(p)).sum()) / 5,
        0.0,
    ]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold that no label is learned from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk_parts(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * E_pos[l(g)], and what must not fall below 0: E_unl[l(-g)] - prior * E_pos[l(-g)]."""
    return float(prior * _soft(-gp).mean()), float(_soft(gu).mean() - prior * _soft(gp).mean())


def risk_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes by each logit of what a step descends: the sum of both parts, or the negative of the second where that is below 0."""
    if risk_parts(gp, gu, prior)[1] >= 0:
        return (-prior * _sigmoid(-gp) - prior * _sigmoid(gp)) / len(gp), _sigmoid(gu) / len(gu)
    return prior * _sigmoid(gp) / len(gp), -_sigmoid(gu) / len(gu)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The prior, from scores of positives and of unlabelled texts that no score was learned from."""
    at = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), at) / len(x)
    p, u = above(positive), above(unlabelled)
    margin = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (positive, unlabelled))
    best = int(np.argmin((u + margin) / p))
    return float(min(1.0, u[best] / p[best]))


class Network:
    """One hidden layer over standardised features; linear terms beside it."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS):
        rng = np.random.default_rng(SEED)
        self.prior = prior
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
        p, u = self._standard(positive), self._standard(unlabelled)
        d = p.shape[1]
        self.w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(d), np.zeros(1)]
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        for t in range(1, steps + 1):
            for i, g in enumerate(self.gradient(p, u)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def gradient(self, p: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        """Of the weights: the step's slopes by standardised samples, and half the decay's squares."""
        dp, du = risk_slopes(self.logit(p), self.logit(u), self.prior)
        return [a + b + DECAY * w for a, b, w in zip(self._back(p, dp), self._back(u, du), self.w, strict=True)]

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, direct, bias = self.w
        return np.tanh(x @ a + b) @ c + x @ direct + bias[0]

    def _back(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        a, b, c, _, _ = self.w
        h = np.tanh(x @ a + b)
        inner = np.outer(g, c) * (1 - h * h)
        return [x.T @ inner, inner.sum(0), h.T @ g, x.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self._standard(x)), -30, 30)))


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    only = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            f = pa.array([features(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], f], names=[*keep, "features"])

    return only.mapInArrow(tidied(run), T.StructType([*[only.schema[c] for c in keep], T.StructField("features", T.ArrayType(T.DoubleType()))]))


#: Positives that a prior can be estimated from; with fewer it is FEW_PRIOR.
LEAST, FEW_PRIOR = 40, 0.5


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the best bin over halves that learn for each other."""
    if min(len(positive), len(unlabelled)) < LEAST:
        return FEW_PRIOR
    found = []
    for i in (0, 1):
        net = Network(positive[i::2], unlabelled[i::2], FEW_PRIOR, PRIOR_STEPS)
        found.append(best_bin(net.logit(net._standard(positive[1 - i :: 2])), net.logit(net._standard(unlabelled[1 - i :: 2]))))
    return min(0.99, max(0.01, float(np.mean(found))))


def _some_ids(ids: DataFrame, sample: int, salt: str) -> DataFrame:
    """At most `sample` distinct ids, those of least hash. A cut by the hash goes first, so that tasks do not send so many each."""
    ids = ids.where("doc_id is not null").select("doc_id")
    n = ids.agg(F.approx_count_distinct("doc_id")).first()[0]
    h = F.xxhash64("doc_id", F.lit(salt))
    if n > 4 * sample:
        ids = ids.where(h < int(-(2**63) + 2**64 * 2 * sample / n))
    return ids.distinct().orderBy(h, "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network, from at most `sample` trusted positives and `sample` unlabelled documents."""
    known = labels.where(~held_out() & (F.col("quality") == 1))
    trusted = _some_ids(known, sample, "trusted").withColumn("trusted", F.lit(True))
    ids = F.broadcast(trusted.union(_some_ids(docs, sample, "web").withColumn("trusted", F.lit(False))))  # at most 2 * sample ids
    text = F.col("text").cast("string")
    # one row an id, however often it repeats
    one = docs.select("doc_id", text.alias("text")).join(ids, "doc_id").groupBy("doc_id", "trusted").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = _featured(one.select("doc_id", "trusted", F.col("t.text").alias("text")), ["doc_id", "trusted"]).toPandas().sort_values(["trusted", "doc_id"])
    if got.empty:
        return None
    x = np.array(got["features"].tolist())
    mine = got["trusted"].to_numpy(bool)
    if not mine.any() or mine.all():
        return None
    shuffled = np.random.default_rng(SEED).permutation  # ids may follow the order in which texts were written
    positive, unlabelled = x[mine][shuffled(int(mine.sum()))], x[~mine][shuffled(int((~mine).sum()))]
    return Network(positive, unlabelled, estimate_prior(positive, unlabelled))


def with_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """The columns (all by default) with score and predicted."""
    keep = [c for c in (columns or docs.columns) if c not in ("score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    only = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*[only.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in slices(batches, len(keep)):
            texts = batch.column(len(keep)).to_pylist()
            if net is None or not texts:
                score = np.full(len(texts), 0.5)
            else:
                score = net.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return only.mapInArrow(tidied(run), schema)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's columns."""
    return with_score(docs, labels, sample, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
