"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit, a logistic regression on character
n-grams, says on which side of the bit a text is. The decoder adds, over all bits, the logistic loss of the
classifier's margin against each codeword, weighted by how good that classifier was in training; the codeword
with the least loss wins. If the second is almost as near, or none is near, the text is flagged as ambiguous.

Fitting uses a bounded sample of the labelled rows (``PER_LANGUAGE`` expected per language, picked by a hash of key
and text); prediction reads every whole text and nothing but the text.

Defined results: ``und`` with score 0 for a null text or one without a letter; if nothing was learned (no
labelled row), every text is ``und``; repeated rows get the same answer; an empty table gives an empty one; columns
of the input are kept, and the added ones replace columns of the same name. More than ``MOST_LANGUAGES``
labels are an error, as labels are then no languages.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import map_text

UNKNOWN = "und"
PER_LANGUAGE = 400
MOST_LANGUAGES = 256
DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3)
BLOCK_CHARS = 1 << 20
ROWS = 256
ADDED = "lang_pred string, score double, ambiguous boolean"
CLOSE = 0.02  # difference of the two best scores below which a text is ambiguous


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of lower-cased letters; blanks mark word ends."""
    counts = np.zeros(DIMENSIONS, np.float64)
    for start in range(0, max(1, len(text)), BLOCK_CHARS):
        part = text[max(0, start - 2) : start + BLOCK_CHARS].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ascii_letter = (codes - 97 < 26) if len(codes) else np.zeros(0, bool)
        codes = np.where(ascii_letter | (codes >= 170), codes, np.uint64(32))
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))] if len(codes) else codes
        gram = np.zeros(len(codes), np.uint64)
        for order in ORDERS:
            if len(codes) < order:
                break
            gram = gram[: len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1 :]
            hashed = (gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) >> np.uint64(40)
            counts += np.bincount((hashed % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """One row of +1 / -1 per class. Up to 6 classes all different splits; else a random code that is far apart."""
    if classes <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, classes - 1))]
        return np.array([s for s in splits if -1 in s] or [(1,) * classes], np.float32).T
    random = np.random.default_rng(7)
    bits = int(np.ceil(8 * np.log2(classes)))
    best, far = None, -1
    for _ in range(64):
        code = np.where(random.random((classes, bits)) < 0.5, -1, 1)
        if (np.abs(code.sum(0)) == classes).any():
            continue
        nearest = ((bits - code @ code.T) // 2 + np.eye(classes, dtype=int) * bits).min()
        if nearest > far:
            best, far = code, nearest
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its score, and the gap to the second."""
        margins = rows @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        like = np.exp(-(loss - loss.min(1, keepdims=True)) / self.trust.sum() * self.code.shape[1])
        score = like / like.sum(1, keepdims=True)
        best = score.argmax(1)
        top = np.sort(score, 1)[:, ::-1]
        gap = top[:, 0] - top[:, 1] if len(self.languages) > 1 else top[:, 0]
        return best, top[:, 0], gap


def fit(rows: np.ndarray, names: list[str], steps: int = 150, decay: float = 1e-4) -> Model:
    """All bits at once by accelerated gradient descent on the logistic loss."""
    languages = sorted(set(names))
    code = codewords(len(languages))
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[n] for n in names]] if names else np.zeros((0, code.shape[1]), np.float32)
    n, bits = max(1, len(rows)), code.shape[1]
    per_class = np.array([names.count(name) for name in languages], np.float32)
    balance = np.array([n / (len(languages) * per_class[place[name]]) for name in names], np.float32)[:, None]
    w, b = np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    rate = 4.0  # rows have length 1, so the curvature is at most 1/4 (and 1/4 for the bias)
    for _ in range(steps if len(rows) else 0):
        aw, ab = w + 0.9 * vw, b + 0.9 * vb
        pull = balance * y / (1 + np.exp(np.clip(y * (rows @ aw + ab), -30, 30)))
        vw = 0.9 * vw + rate * (rows.T @ pull / n - decay * aw)
        vb = 0.9 * vb + rate * 0.25 * pull.mean(0)
        w, b = w + vw, b + vb
    right = (np.sign(rows @ w + b) == y).mean(0) if len(rows) else np.zeros(bits)
    trust = np.log(np.clip(right, 0.55, 0.995) / (1 - np.clip(right, 0.55, 0.995)))
    return Model(languages, code, w, b, trust.astype(np.float32))


def sample(labelled: DataFrame, key: str, text: str, label: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of key and text."""
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).take(MOST_LANGUAGES + 1)}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < share)


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE
) -> Model:
    """A model of the labelled documents. Features are made by the executors; the sample's rows are collected."""
    labelled = docs.select(key, text, label).where(F.col(label).isNotNull() & F.col(text).isNotNull())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = [], []
            for value, name in zip(batch.column(0), batch.column(1)):
                if has_letter(value.as_py()):
                    names.append(name.as_py())
                    rows.append(features(value.as_py()).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.binary())], names=["l", "v"])

    chosen = sample(labelled, key, text, label, per_language).select(text, label)
    found = sorted(tuple(r) for r in chosen.mapInArrow(vectors, "l string, v binary").collect())
    if not found:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    rows = np.stack([np.frombuffer(v, np.float16) for _, v in found]).astype(np.float32)
    return fit(rows, [name for name, _ in found])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    # Plain values, as classes of a broadcast would have to be installed on the executors. Bounded by DIMENSIONS
    # and MOST_LANGUAGES.
    values = (model.languages, model.code, model.weights, model.bias, model.trust)
    shared = docs.sparkSession.sparkContext.broadcast(values)

    def run(column: pa.Array) -> list[pa.Array]:
        known = Model(*shared.value)
        names: list[str] = [UNKNOWN] * len(column)
        scores, flags = np.zeros(len(column)), np.ones(len(column), bool)
        for start in range(0, len(column), ROWS):
            texts = column.slice(start, ROWS).to_pylist()
            clear = [i for i, t in enumerate(texts) if t is not None and known.languages and has_letter(t)]
            if clear:
                best, score, gap = known.predict(np.stack([features(texts[i]) for i in clear]))
                for i, b, s, g in zip(clear, best, score, gap):
                    names[start + i], scores[start + i], flags[start + i] = known.languages[b], min(1.0, float(s)), g < CLOSE
        return [pa.array(names, pa.string()), pa.array(scores), pa.array(flags)]

    return map_text(docs, run, ADDED, text, keep=True)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
