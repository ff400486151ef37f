"""Language identification with a string kernel.

A text is the set of its byte n-grams of lengths 1 to 4 after lower-casing (a blended-spectrum presence
representation). The kernel of two texts is the size of the intersection over the root of the product of the
sizes. Landmark texts give a Nyström map, kernel ridge regression is solved once for each language against the
rest, and a batch is scored by two matrix products: presence of n-grams in the texts by their presence in the
landmarks, then kernel values by weights.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, held_out

#: Bounds of what is learned from: texts and landmarks in all, but no fewer of each language than these.
MAX_TRAIN = 1600
LANDMARKS = 96
LANGUAGE_TEXTS = 8
LANGUAGE_LANDMARKS = 2
RIDGE = 0.05
#: n-grams of 1 and 2 bytes have places of their own, longer ones share hashed places.
_PLACES = (256, 1 << 16, 1 << 17, 1 << 17)
_OFFSETS = np.cumsum((0, *_PLACES))
_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = "und"
#: Texts that are scored together.
BATCH = 256
#: Columns of a presence matrix that are laid out at once.
WIDE = 4096


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers such as fractions, which the pattern lets through, are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


class Spectrum:
    """Turns texts into sorted n-gram numbers; holds one flag for each number."""

    def __init__(self):
        self.seen = np.zeros(_OFFSETS[-1], bool)

    def of(self, text: str) -> np.ndarray:
        raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE) + b" "
        seen = self.seen
        for at in range(0, len(raw), 1 << 20):  # neighbouring blocks overlap by three bytes
            b = np.frombuffer(raw[at : at + (1 << 20) + 3], np.uint8).astype(np.uint32)
            seen[b] = True
            two = b[:-1] << 8 | b[1:]
            seen[two + np.uint32(_OFFSETS[1])] = True
            three = two[:-1] << 8 | b[2:]
            seen[(three * np.uint32(2654435761) >> 15) + np.uint32(_OFFSETS[2])] = True
            four = three[:-1] << 8 | b[3:]
            seen[((four ^ four >> 13) * np.uint32(2246822519) >> 15) + np.uint32(_OFFSETS[3])] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out.astype(np.int32)


class KernelModel:
    """Nyström kernel ridge regression, one language against the rest."""

    def __init__(self, spectra: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.labels = sorted(set(labels))
        by_label = [[i for i, y in enumerate(labels) if y == name] for name in self.labels]
        chosen: list[int] = []
        for turn in range(max(map(len, by_label), default=0)):  # the languages take turns
            chosen += [rows[turn] for rows in by_label if turn < len(rows)]
        chosen = chosen[: max(landmarks, LANGUAGE_LANDMARKS * len(self.labels))]
        self.place = np.full(_OFFSETS[-1], -1, np.int32)
        if not chosen:
            return
        used = np.unique(np.concatenate([spectra[i] for i in chosen]))
        self.place[used] = np.arange(len(used))
        self.presence = np.zeros((len(used), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.presence[self.place[spectra[i]], j] = 1 / np.sqrt(len(spectra[i]))
        self.weights = np.zeros((len(chosen), len(self.labels)))
        between = self.kernel([spectra[i] for i in chosen])
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        phi = self.kernel(spectra) @ root
        y = np.array([[float(name == x) for name in self.labels] for x in labels])
        count = y.sum(0)
        weight = (1 / count)[y.argmax(1)] * len(labels) / len(self.labels)  # rare languages weigh as much
        gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
        self.weights = root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ y)

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Kernel values of some texts with all landmarks: the texts' presence matrix times that of the landmarks.

        Only columns of n-grams that the texts have are laid out, a block of them at a time.
        """
        at = [self.place[s] for s in spectra]
        at = [a[a >= 0] for a in at]
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        column = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        used, column = np.unique(column, return_inverse=True)
        cuts = np.searchsorted(column, np.arange(0, len(used) + WIDE, WIDE))
        out = np.zeros((len(spectra), self.presence.shape[1]))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if hi > lo:
                some = used[k * WIDE : (k + 1) * WIDE]
                x = np.zeros((len(spectra), len(some)))
                x[row[lo:hi], column[lo:hi] - k * WIDE] = 1
                out += x @ self.presence[some]
        return out / np.sqrt([max(1, len(s)) for s in spectra])[:, None]

    def predict(self, spectra: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        if not self.labels:
            return [UNKNOWN] * len(spectra), np.zeros(len(spectra))
        f = self.kernel(spectra) @ self.weights
        best = f.argmax(1)
        return [self.labels[i] for i in best], np.clip(f.max(1), 0.0, 1.0).round(9)  # sums differ by batch in their last bits


def train(docs: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> KernelModel:
    """A model from rows (doc_id, text, lang) that are not held out; null languages and texts without a letter teach nothing.

    About `max_train` texts are used, as many of each language and at least 8 where it has them, drawn by a hash of doc_id. Workers send
    n-gram numbers, not texts; their number for each text is bounded.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return KernelModel([], [])
    each = max(max_train / len(counts), LANGUAGE_TEXTS)
    pairs = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * each / n))]
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(0.0)))

    def spectra(batches):
        spectrum = Spectrum()
        for b in batches:
            got = [spectrum.of(t).tobytes() if has_letter(t) else None for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("lang"), pa.array(got, pa.binary())], names=["doc_id", "lang", "spectrum"])

    got = picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    got = got.mapInArrow(spectra, "doc_id long, lang string, spectrum binary").where("spectrum is not null")
    table = got.limit(int(2 * max(max_train, each * len(counts))) + 200).toPandas()
    table["order"] = [(x * 0x9E3779B97F4A7C15) & (2**64 - 1) for x in table["doc_id"].fillna(-1).astype("int64").tolist()]
    table = table.sort_values(["order", "spectrum"]).groupby("lang", sort=True).head(int(each) + 1)
    return KernelModel([np.frombuffer(s, np.int32) for s in table["spectrum"]], table["lang"].tolist(), landmarks)


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1).

    A null text or one without a letter is `und` with score 0; so is everything if nothing was learned. Columns
    of these names are replaced, all others stay. The whole text counts, however long. Of languages with equal
    values the first by name is predicted, and repeated rows have equal results.
    """
    source = docs.drop("lang_pred", "score")
    at = source.columns.index(text)
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        spectrum, model = Spectrum(), shared.load()
        for b in batches:
            texts = b.column(at)
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, BATCH):
                part = [(i, t) for i in range(lo, min(lo + BATCH, b.num_rows)) if has_letter(t := texts[i].as_py())]
                if part:
                    names, values = model.predict([spectrum.of(t) for _, t in part])
                    for (i, _), name, value in zip(part, names, values):
                        lang[i], score[i] = name, value if name != UNKNOWN else 0.0
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    made = source.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return source.mapInArrow(run, made)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
