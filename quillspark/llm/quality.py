"""Quality classification with a linear-chain conditional random field over lines.

Every line gets the label good or bad. Its potential comes from features of the line and of both neighbours;
transitions tie the labels of adjacent lines. Forward-backward gives each line's marginal probability of being
good; a document's quality is the mean of these, weighted by line length, passed through a logistic calibration.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, held_out

#: Bounds of what is learned from: labelled documents in all, and lines of one of them.
MAX_TRAIN = 2000
MAX_LINES = 100
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_MARK = b"!?"
FEATURES = 23


def line_features(line: bytes) -> list[float]:
    """Features of one line, each between 0 and 1."""
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [1.0, 1.0] + [0.0] * (FEATURES - 2)
    letters = n - len(line.translate(None, _UPPER + _LOWER)) or 1
    upper = (n - len(line.translate(None, _UPPER))) / letters
    digit = (n - len(line.translate(None, _DIGIT))) / n
    symbol = (n - len(line.translate(None, _SYMBOL))) / n
    pipe = line.count(b"|") / k
    mark = (n - len(line.translate(None, _MARK))) / k
    distinct = len(set(words)) / k
    stutter = sum(map(eq, words, words[1:])) / k
    end = line.rstrip()[-1:]
    mean = n / k
    return [
        1.0,
        0.0,
        min(1.0, np.log1p(k) / 8),
        float(k <= 3),
        float(k >= 20),
        upper,
        float(upper > 0.3),
        float(upper > 0.7),
        digit,
        float(digit > 0.1),
        symbol * 4 if symbol < 0.25 else 1.0,
        float(symbol > 0.01),
        float(symbol > 0.05),
        min(1.0, pipe),
        float(pipe > 0.2),
        min(1.0, mark),
        float(mark > 0.3),
        1 - distinct,
        float(k >= 10 and distinct < 0.4),
        stutter,
        float(stutter > 0.15),
        float(end in (b".", b"?", b"!", b'"', b":")),
        min(1.0, mean / 20),
    ]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the lines' lengths, at least 1; a null or empty text is one blank line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return np.array([line_features(x) for x in lines], np.float32), np.array([max(1, len(x)) for x in lines], np.float64)


def neighbourhood(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each line, the one before and the one after; zeros beyond a document's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[np.r_[starts[1:], len(x)] - 1] = 0
    return np.concatenate([x, before, after], 1)


class Chains:
    """Chains of several documents, laid out so that all lines of one position are handled together."""

    def __init__(self, sizes: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        self.steps = []
        alive = len(sizes)
        sizes, starts = sizes[order], starts[order]
        for t in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes, -t, side="left"))  # documents with more than t lines
            self.steps.append(starts[:alive] + t)

    def marginals(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transitions (2 x 2), and the log partition sum.

        unary: the log potential of good, that of bad is 0. trans[i, j]: of label j (1 is good) after label i.
        """
        u = np.stack([np.zeros_like(unary), unary], 1)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        for t, at in enumerate(self.steps):
            alpha[at] = u[at] if not t else u[at] + np.logaddexp(alpha[at - 1, 0, None] + trans[0], alpha[at - 1, 1, None] + trans[1])
        for t in range(len(self.steps) - 2, -1, -1):
            nxt = self.steps[t + 1]
            m = u[nxt] + beta[nxt]
            beta[nxt - 1] = np.logaddexp(trans[:, 0] + m[:, 0, None], trans[:, 1] + m[:, 1, None])
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        expected = np.zeros((2, 2))
        for nxt in self.steps[1:]:
            m = u[nxt] + beta[nxt]
            expected += np.exp(alpha[nxt - 1][:, :, None] + trans + m[:, None, :] - z[nxt][:, None, None]).sum(0)
        return np.exp(both[:, 1] - z), expected, float(z[self.steps[0]].sum()) if self.steps else 0.0


class LineField:
    """The field and the calibration of document scores."""

    def __init__(self):
        self.w = np.zeros(3 * FEATURES)
        self.trans = np.zeros((2, 2))
        self.a, self.b = 1.0, 0.0

    def fit(self, docs: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> "LineField":
        """Learn from documents' line features and labels 1 or 0; at first every line has its document's label.

        A second pass lets the lines of bad documents that look good, such as shared notices, be good.
        """
        if not len(docs) or len(set(labels.tolist())) < 2:
            self.a, self.b = 0.0, 30.0 if not len(docs) or labels[0] == 1 else -30.0
            return self
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        x = neighbourhood(np.concatenate(docs), starts).astype(np.float64)
        chains, doc = Chains(sizes), np.repeat(np.arange(len(docs)), sizes)
        length = np.concatenate(lengths)
        y = labels[doc].astype(np.float64)
        self._climb(x, y, chains, starts, steps, ridge)
        p = chains.marginals(x @ self.w, self.trans)[0]
        y = np.where((labels[doc] == 0) & (p > 0.5), 1.0, y)
        worst = np.minimum.reduceat(p, starts)
        y[(labels[doc] == 0) & (p <= worst[doc])] = 0.0  # each bad document keeps a bad line
        self._climb(x, y, chains, starts, steps, ridge)
        s = self._logit(self.raw(docs, lengths))
        for _ in range(50):  # Newton steps of the calibration, both classes weighing the same
            p = 1 / (1 + np.exp(-(self.a * s + self.b)))
            each = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
            g = np.array([((p - labels) * each * s).sum(), ((p - labels) * each).sum()]) + 1e-3 * np.array([self.a - 1, self.b])
            v = p * (1 - p) * each
            h = np.array([[(v * s * s).sum(), (v * s).sum()], [(v * s).sum(), v.sum()]]) + 1e-3 * np.eye(2)
            self.a, self.b = np.array([self.a, self.b]) - np.linalg.solve(h, g)
        self.a = max(self.a, 0.1)
        return self

    def _climb(self, x, y, chains, starts, steps, ridge) -> None:
        """Adam on the penalised mean log likelihood."""
        pairs = np.zeros((2, 2))
        first = np.zeros(len(y), bool)
        first[starts] = True
        inner = np.flatnonzero(~first)
        np.add.at(pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        theta = np.concatenate([self.w, self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            p, expected, _ = chains.marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
            g = np.concatenate([x.T @ (y - p), (pairs - expected).ravel()]) / len(y) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)

    @staticmethod
    def _logit(q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def raw(self, docs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """The length-weighted mean of the lines' marginals."""
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        unary = neighbourhood(np.concatenate(docs), starts) @ self.w
        p, length = Chains(sizes).marginals(unary, self.trans)[0], np.concatenate(lengths)
        return np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts)

    def score(self, docs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self._logit(self.raw(docs, lengths)) + self.b)))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> LineField:
    """A field from documents (doc_id, text) with a label (doc_id, quality 0 or 1) that are not held out.

    At most about `max_train` documents, drawn by a hash of doc_id, and of each at most `max_lines` neighbouring
    lines are learned from. Rows without label or id teach nothing; without both labels every score is equal.
    """
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.where(draw < min(1.0, max_train / max(1, n))).orderBy(F.xxhash64(F.lit(9), "doc_id"), "quality").limit(2 * max_train)

    def lines(batches):
        for b in batches:
            xs, ls = [], []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                x, length = text_features(t)
                at = doc % max(1, len(x) - max_lines + 1)
                xs.append(x[at : at + max_lines].tobytes())
                ls.append(length[at : at + max_lines].tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(xs, pa.binary()), pa.array(ls, pa.binary())], names=["doc_id", "quality", "x", "length"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = source.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").mapInArrow(lines, "doc_id long, quality int, x binary, length binary")
    table = got.limit(4 * max_train).toPandas().sort_values(["doc_id", "quality", "x"])
    xs = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in table["x"]]
    return LineField().fit(xs, [np.frombuffer(x, np.float64) for x in table["length"]], table["quality"].to_numpy())


def score(docs: DataFrame, field: LineField, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column of scores, 0 to 1; a column of this name is replaced, all others stay.

    A null or empty text counts as one blank line. Every line of a text counts, however many there are.
    """
    source = docs.drop(name)
    at = source.columns.index(text)
    shared = Shared(docs.sparkSession, field)

    def run(batches):
        field = shared.load()
        for b in batches:
            out, xs, ls, size = [], [], [], 0
            for t in b.column(at):
                x, length = text_features(t.as_py())
                xs.append(x)
                ls.append(length)
                size += len(x)
                if size > 50_000:
                    out.append(field.score(xs, ls))
                    xs, ls, size = [], [], 0
            if xs:
                out.append(field.score(xs, ls))
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=[*b.schema.names, name])

    return source.mapInArrow(run, source.withColumn(name, F.lit(None).cast("double")).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents scored below the threshold; the columns stay as they were."""
    field = train(docs, labels)
    return score(docs, field, name="_quill_quality").where(F.col("_quill_quality") >= threshold).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, field)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
