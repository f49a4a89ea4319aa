"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are all byte 2-, 3- and 4-grams of the lower-cased text, hashed into `buckets` rows of an
embedding table. A text is the average of its rows; a linear softmax sits on top; both are trained
by mini-batch stochastic gradient descent in numpy on a bounded sample (`per_lang` different rows and
SAMPLE_BYTES of text of each language, chosen by a hash of doc_id and text). As average and linear layer commute, scoring adds up
per-bucket class logits, so whole texts cost one table lookup per subword. The temperature and the
rejection threshold are calibrated on a fifth of the sample that training does not see.

Defined cases: null text or a text without a letter gives `und` with score 0 and is rejected; a
null doc_id or lang is never learned from but is scored; an empty training set predicts `und`
throughout; repeated rows are scored alike; extra columns are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

WIDTHS = (2, 3, 4)
SAMPLE_BYTES = 8 << 20  # text of a language in the sample

# Lower case of bytes: A-Z, and the second bytes of C3 80..9E (capital Latin-1 letters) without the sign C3 97.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0x9F] = True
_LATIN[0x97] = False


def lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    if len(out) > 1:
        hit = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]]) + 1
        out[hit] += 32
    return out


def subwords(data: np.ndarray, off: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width: bucket of each subword, and the subwords' offsets by document."""
    b = lowered(data).astype(np.uint32)
    out = []
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for k in WIDTHS:
        idx, ptr = tc.gram_ptr(off, k)
        n = len(b) - k + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint32), ptr))
            continue
        code = b[:n].copy()
        for j in range(1, k):
            code = code * np.uint32(257) + b[j : j + n]
        code = (code * np.uint32(2654435761) + np.uint32(k * 97)) * np.uint32(0x9E3779B1) >> shift
        out.append((code[idx], ptr))
    return out


def summed(table: np.ndarray, buckets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of table rows by document."""
    out = np.zeros((len(ptr) - 1, table.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(ptr) > 0)
    if len(full):
        for c in range(table.shape[1]):
            out[full, c] = np.add.reduceat(np.ascontiguousarray(table[:, c])[buckets], ptr[:-1][full])
    return out


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # buckets x langs: embedding times output layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.langs:
            return np.zeros((len(off) - 1, 0))
        z = np.zeros((len(off) - 1, len(self.langs)))
        count = np.zeros(len(off) - 1)
        for code, ptr in subwords(data, off, len(self.logits)):
            z += summed(self.logits, code, ptr)
            count += np.diff(ptr)
        z = (z / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 8, rate: float = 4.0, seed: int = 7, max_error: float = 0.001) -> Model:
    """Fit on the given rows; a fifth of them calibrates temperature and rejection."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    rows = []
    for _, _, data, off in tc.chunks(pa.array(texts, pa.large_string())):
        parts = subwords(data, off, buckets)
        for i in range(len(off) - 1):
            rows.append(np.unique(np.concatenate([c[p[i] : p[i + 1]] for c, p in parts]), return_counts=True))
    order = rng.permutation(len(rows))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    batch, steps, step = 16, max(1, epochs * -(-len(fit) // 16)), 0
    for _ in range(epochs):
        for at in range(0, len(fit), batch):
            some = rng.permutation(fit)[:batch] if len(fit) < batch else fit[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in some])
            w = np.concatenate([rows[i][1] / max(1, rows[i][1].sum()) for i in some]).astype(np.float32)
            ptr = np.cumsum([0] + [len(rows[i][0]) for i in some])
            avg = np.zeros((len(some), dim), np.float32)
            for i in range(len(some)):
                avg[i] = w[ptr[i] : ptr[i + 1]] @ emb[ids[ptr[i] : ptr[i + 1]]]
            z = avg @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            grad = p @ out.T
            out -= lr * avg.T @ p / len(some)
            bias -= 0.1 * lr * p.mean(axis=0)
            for i in range(len(some)):  # ids are distinct within a text
                emb[ids[ptr[i] : ptr[i + 1]]] -= (lr * 4 / len(some)) * w[ptr[i] : ptr[i + 1], None] * grad[i]
        rng.shuffle(fit)
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    return calibrate(model, [texts[i] for i in held], y[held], max_error)


def calibrate(model: Model, texts: list[str], y: np.ndarray, max_error: float) -> Model:
    """Temperature by likelihood over a grid; the threshold rejects at most `max_error` of the correctly identified texts."""
    p = np.concatenate([model.probabilities(d, o) for _, _, d, o in tc.chunks(pa.array(texts, pa.large_string()))])
    z = np.log(np.maximum(p, 1e-300))
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 4, 40):
        q = z / t
        q = q - np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - q.max(axis=1, keepdims=True)
        best = min(best, (float(-q[np.arange(len(y)), y].mean()), float(t)))
    model.temperature = best[1]
    p = np.concatenate([model.probabilities(d, o) for _, _, d, o in tc.chunks(pa.array(texts, pa.large_string()))])
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    cut = float(right[int(max_error * len(right))]) if len(right) else 0.0
    chance = 1.0 / max(2, len(model.langs))
    model.threshold = min(cut * 0.9, max(chance * 1.2, 0.5))
    model.info = {"held": len(y), "accuracy": float((p.argmax(axis=1) == y).mean()) if len(y) else 0.0, "nll": best[0]}
    return model


def sample(docs: DataFrame, per_lang: int, max_bytes: int = SAMPLE_BYTES, seed: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of the training rows of each language; see `common.drawn`."""
    rows = docs.where((tc.crc_mod("doc_id", 3) != 1) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = common.drawn(rows, "lang", per_lang, max_bytes, seed)
    return [r["text"] for r in got], [r["lang"] for r in got]


def has_letter(text: pa.Array) -> np.ndarray:
    """Whether a text has a letter (Unicode category L; number characters are none); a null has not."""
    return pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text."""
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (tc.crc_mod("doc_id", 3) == 1).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for b in batches:
            text = b.column("text")
            pred, conf = np.full(len(b), len(m.langs)), np.zeros(len(b))
            for a, z, data, off in tc.chunks(text):
                p = m.probabilities(data, off)
                if p.shape[1]:
                    pred[a:z], conf[a:z] = p.argmax(axis=1), p.max(axis=1)
            plain = has_letter(text)
            pred[~plain] = len(m.langs)
            conf[~plain] = 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names[pred], pa.string()), pa.array(conf), pa.array((conf < m.threshold) | (pred == len(m.langs)))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return cast.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def fit(docs: DataFrame, per_lang: int = 600) -> Model:
    """Model from a bounded sample: at most `per_lang` rows of each language."""
    return train(*sample(docs, per_lang))


def language(docs: DataFrame, per_lang: int = 600) -> DataFrame:
    return identify(docs, fit(docs, per_lang))


def keep_identified(docs: DataFrame, per_lang: int = 600) -> DataFrame:
    """The documents whose language is identified, with their columns; texts in no known language go.

    Scores the rows in place, so no join is needed and rows with equal ids are judged by their own text.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))
    common.given_back(docs.sparkSession)

    def keep(batches):
        m = model.value
        for b in batches:
            text = b.column("text")
            conf = np.zeros(len(b))
            for a, z, data, off in tc.chunks(text):
                p = m.probabilities(data, off)
                if p.shape[1]:
                    conf[a:z] = p.max(axis=1)
            plain = has_letter(text)
            yield b.filter(pa.array(plain & (conf >= m.threshold)))

    return docs.mapInArrow(keep, docs.schema)
