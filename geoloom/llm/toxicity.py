"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of letters and digits, lower-cased) is the sum of five rows of one hashed embedding
table: the word, its first four, five and six bytes and its last six. Filters of widths 1, 2 and 3
slide over the words of the whole text, are max-pooled, and feed a logistic output. The rows' first
coordinate starts from the contrast of the classes in the training rows, and rows that fewer than
`least` of those documents touch stay zero, so a small sample is not learned by its rare words. Training is Adagrad on a
bounded sample (`cap` labelled rows and SAMPLE_BYTES of text of each class, one text a doc_id, chosen
by a hash). A hash holds back a fifth of all labelled training rows (of under 40: all of them serve twice); all
of these, without bound, give the Platt scaling of the score and the decision thresholds by language.

Neither language, source, label nor doc_id enters a score; `flagged` compares the score with the
language's threshold (the overall one for a null or unseen language).

Defined cases: null and empty texts get the score of a text without words; labels without a
document or with a null are not learned from; several labels of one doc_id count as toxic if any
says so; without labelled rows every score is 0; repeated rows are scored alike; other columns are
left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

SAMPLE_BYTES = 16 << 20  # text of a class in the labelled sample
STEP = 256  # Platt scaling counts rows by raw scores rounded to 1 / STEP
CUTS = np.linspace(0.05, 0.95, 19)
PAD = 3
HEADS = (4, 5, 6)  # bytes of a word's beginning that have rows of their own
TAIL = 6  # bytes of its end
COLUMNS = len(HEADS) + 2
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (COLUMNS each), each document followed by PAD zero words; offsets by document."""
    starts, ends, ptr = tc.runs(_INSIDE[data], off)
    h = tc.prefix_hash(data, lower=True)
    heads = [tc.span_hash(h, starts, np.minimum(starts + k, ends)) ^ np.uint64(0x5555 + k) for k in HEADS]
    spans = (tc.span_hash(h, starts, ends), *heads, tc.span_hash(h, np.maximum(ends - TAIL, starts), ends) ^ np.uint64(0xAAAA))
    n = np.diff(ptr)
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(n + PAD, out=out_ptr[1:])
    ids = np.zeros((out_ptr[-1], COLUMNS), np.int32)
    at = np.arange(len(starts)) + np.repeat(out_ptr[:-1] - ptr[:-1], n)
    for c, s in enumerate(spans):
        ids[at, c] = (s % np.uint64(buckets - 1)).astype(np.int32) + 1  # row 0 stays zero
    return ids, out_ptr


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]  # by width: width x dim x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def maps(self, ids: np.ndarray) -> np.ndarray:
        """Filter outputs at every position, all widths side by side."""
        x = self.emb[ids[:, 0]]
        for c in range(1, COLUMNS):
            x += self.emb[ids[:, c]]
        n = len(x) - PAD + 1
        parts = []
        for w in self.filters:
            z = x[:n] @ w[0]
            for j in range(1, len(w)):
                z += x[j : j + n] @ w[j]
            parts.append(z)
        return np.concatenate(parts, axis=1)

    def raw(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        z = self.maps(ids)
        edge = np.stack([ptr[:-1], ptr[1:] - PAD + 1], axis=1).ravel()
        edge[-1] = min(edge[-1], len(z))
        top = np.maximum.reduceat(z, edge if edge[-1] < len(z) else edge[:-1], axis=0)[::2]
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros(0)
        z = self.raw(*features(data, off, len(self.emb))).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def contrasts(docs: list[np.ndarray], y: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each bucket, standardised excess of toxic ones among them)."""
    seen, toxic = np.zeros(buckets), np.zeros(buckets)
    for ids, label in zip(docs, y, strict=True):
        own = np.unique(ids)
        seen[own] += 1
        toxic[own] += label
    share = y.mean()
    return seen, (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 0.5)


def train(texts: list[str], labels: list[int], langs: list[str | None], hold: bool = True, buckets: int = 1 << 18, least: int = 3, dim: int = 12, filters: int = 16, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 8, rate: float = 0.02, batch: int = 32, seed: int = 5) -> Model | None:
    """A model of these rows; with `hold`, a fifth of them is held back and calibrates it."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    docs = []
    for _, _, data, off in tc.chunks(pa.array(texts, pa.large_string())):
        ids, ptr = features(data, off, buckets)
        docs += [ids[ptr[i] : ptr[i + 1]] for i in range(len(ptr) - 1)]
    order = rng.permutation(len(docs))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if hold and len(order) >= 40 else (order, order)
    m = Model(rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), [rng.normal(0, (1 / (k * dim)) ** 0.5, (k, dim, filters)).astype(np.float32) for k in widths], np.zeros(filters * len(widths), np.float32), rng.normal(0, 0.1, filters * len(widths)).astype(np.float32), 0.0)
    # The first coordinate starts from the contrast of the classes; words of fewer than `least` documents stay zero.
    seen, excess = contrasts([docs[i] for i in fit], y[fit], buckets)
    known = seen >= least
    known[0] = False
    m.emb *= 0.1
    m.emb[:, 0] = excess / max(1.0, np.abs(excess[known]).max(initial=0))
    m.emb[~known] = 0
    for w in m.filters:
        w[:, 0] = np.abs(w[:, 0])
    m.out[:] = np.abs(m.out)
    sq = {"emb": np.full(m.emb.shape, 1e-6, np.float32), "bias": 1e-6, "out": np.full(m.out.shape, 1e-6, np.float32), "ob": 1e-6, "f": [np.full(w.shape, 1e-6, np.float32) for w in m.filters]}
    lift = float(np.clip((1 - y[fit]).sum() / max(1.0, y[fit].sum()), 1, 10)) ** 0.5
    for epoch in range(epochs):
        rng.shuffle(fit)
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            some = fit[at : at + batch]
            ids = np.concatenate([docs[i] for i in some])
            ptr = np.cumsum([0] + [len(docs[i]) for i in some])
            z = m.maps(ids)
            arg = np.stack([z[ptr[i] : ptr[i + 1] - PAD + 1].argmax(axis=0) + ptr[i] for i in range(len(some))])
            top = np.take_along_axis(z, arg, axis=0) + m.bias
            hid = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hid @ m.out + m.out_bias, -30, 30)))
            g = (p - y[some]) * np.where(y[some] > 0, lift, 1.0).astype(np.float32)
            gh = g[:, None] * m.out * (top > 0)
            g_out, g_bias = hid.T @ g, gh.sum(axis=0)
            gw = [np.zeros_like(w) for w in m.filters]
            rows, grads = [], []
            for k, w in enumerate(m.filters):
                cols = slice(k * filters, (k + 1) * filters)
                pos, gk = arg[:, cols], gh[:, cols]
                for j in range(len(w)):
                    x = m.emb[ids[pos + j]].sum(axis=2)  # docs x filters x dim
                    gw[k][j] = np.einsum("bfd,bf->df", x, gk)
                    gx = gk[:, :, None] * w[j].T[None]
                    for c in range(COLUMNS):
                        rows.append(ids[pos + j, c].ravel())
                        grads.append(gx.reshape(-1, dim))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            keep = known[rows] & (np.abs(grads).sum(axis=1) > 0)
            uniq, inv = np.unique(rows[keep], return_inverse=True)
            total = np.zeros((len(uniq), dim), np.float32)
            np.add.at(total, inv, grads[keep])
            sq["emb"][uniq] += total**2
            m.emb[uniq] -= lr * total / np.sqrt(sq["emb"][uniq])
            for k in range(len(m.filters)):
                sq["f"][k] += gw[k] ** 2
                m.filters[k] -= lr * gw[k] / np.sqrt(sq["f"][k])
            sq["out"] += g_out**2
            m.out -= lr * g_out / np.sqrt(sq["out"])
            sq["bias"] = sq["bias"] + g_bias**2
            m.bias -= lr * g_bias / np.sqrt(sq["bias"])
            sq["ob"] += float(g.sum()) ** 2
            m.out_bias -= lr * float(g.sum()) / sq["ob"] ** 0.5
    return calibrate(m, [texts[i] for i in held], y[held], [langs[i] for i in held]) if hold else m


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps over n rows of each raw score and label."""
    total, toxic = n.sum(), (n * y).sum()
    mean = (n * z).sum() / total
    a, b = 1.0 / (((n * (z - mean) ** 2).sum() / total) ** 0.5 or 1.0), 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    t = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (total - toxic + 2))
    w = np.array([a, b])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (n * (p - t)) + 1e-3 * w)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (a, b)


def best_cut(hits: np.ndarray, flagged: np.ndarray, toxic: int) -> float:
    """The threshold of best F1, from the toxic and all rows at or above each of CUTS."""
    return float(max((2 * h / max(1, f + toxic), -abs(c - 0.5), c) for h, f, c in zip(hits, flagged, CUTS, strict=True))[2])


def calibrate(m: Model, texts: list[str], y: np.ndarray, langs: list[str | None]) -> Model:
    """Platt scaling, then for each language the threshold of best F1 (overall under None)."""
    z = np.concatenate([m.raw(*features(d, o, len(m.emb))) for _, _, d, o in tc.chunks(pa.array(texts, pa.large_string()))]).astype(np.float64)
    m.scale = platt(z, y, np.ones(len(z)))
    p = 1 / (1 + np.exp(-np.clip(m.scale[0] * z + m.scale[1], -40, 40)))
    lang = np.array([x or "" for x in langs], dtype=object)
    for name in [None, *sorted({x for x in langs if x})]:
        of = np.ones(len(y), bool) if name is None else lang == name
        if y[of].sum() >= 5:
            over = p[of][None, :] >= CUTS[:, None]
            m.thresholds[name] = best_cut((over & (y[of] > 0)).sum(axis=1), over.sum(axis=1), y[of].sum())
    m.thresholds.setdefault(None, 0.5)
    m.info = {"held": len(y), "accuracy": float(((p >= 0.5) == (y > 0)).mean()), "recall": float((p[y > 0] >= 0.5).mean()), "precision": float(y[p >= 0.5].mean()) if (p >= 0.5).any() else 0.0}
    return m


def calibrate_all(m: Model, docs: DataFrame, given: DataFrame) -> Model:
    """`calibrate` over all rows (doc_id, toxic) of given, one text a doc_id; the driver sees counts only.

    docs: those that may be given ones; texts are scored where they stand, and scores meet labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(m)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), "lang", F.xxhash64(F.lit("tox"), "doc_id", text).alias("u"))

    def run(batches):
        own = shared.value
        for b in batches:
            z = np.zeros(len(b))
            for a, e, data, off in tc.chunks(b.column("text"), tc.CHUNK_BYTES // 2):
                z[a:e] = own.raw(*features(data, off, len(own.emb)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("u"), pa.array(z)], ["doc_id", "lang", "u", "z"])

    scored = rows.mapInArrow(run, "doc_id long, lang string, u long, z double").join(given, "doc_id")
    held = common.kept(scored.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.struct("u", "z", "lang")).alias("m")).select("toxic", "m.z", "m.lang"))
    step = F.round(F.greatest(F.least("z", F.lit(1000.0)), F.lit(-1000.0)) * STEP).cast("long")
    bins = held.groupBy("toxic", step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("s", "toxic").collect()
    if len({r["toxic"] for r in bins}) == 2:
        m.scale = platt(*(np.array([r[c] for r in bins], float) / k for c, k in (("s", STEP), ("toxic", 1), ("n", 1))))
    # Scores of the scaled model at or above each cut, as raw scores.
    over = [F.col("z") >= F.lit(float((np.log(c / (1 - c)) - m.scale[1]) / m.scale[0])) for c in CUTS]
    sums = [F.sum(x.cast("long")).alias(f"f{i}") for i, x in enumerate(over)] + [F.sum((x & (F.col("toxic") == 1)).cast("long")).alias(f"h{i}") for i, x in enumerate(over)]
    by = held.groupBy("lang").agg(F.sum(F.col("toxic").cast("long")).alias("toxic"), F.count(F.lit(1)).alias("n"), *sums).collect()
    parts = {r["lang"]: np.array([r["toxic"], r["n"], *[r[f"f{i}"] for i in range(len(CUTS))], *[r[f"h{i}"] for i in range(len(CUTS))]]) for r in by}
    parts = {x: v for x, v in parts.items() if x} | {None: sum(parts.values(), np.zeros(2 + 2 * len(CUTS), np.int64))}
    for name, v in parts.items():
        if v[0] >= 5:
            m.thresholds[name] = best_cut(v[2 + len(CUTS) :], v[2 : 2 + len(CUTS)], v[0])
    m.thresholds.setdefault(None, 0.5)
    m.info = {"held": int(parts[None][1])}
    return m


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled training rows, each doc_id once."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (tc.crc_mod("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def held_back():
    """Whether a training row calibrates; from its doc_id alone, so texts need no join."""
    return F.pmod(F.xxhash64(F.lit("tox-held"), F.col("doc_id").cast("long")), F.lit(5)) == 0


def sample(docs: DataFrame, given: DataFrame, cap: int, max_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """A bounded sample of the labelled rows of each class; see `common.drawn_labelled`."""
    return common.drawn_labelled(docs, given, "toxic", cap, max_bytes, "tox", ("lang",))


def fit(docs: DataFrame, labels: DataFrame, cap: int = 3000) -> Model | None:
    given = known(labels)
    few = given.count() < 40
    got = sample(docs, given if few else given.where(~held_back()), cap)
    m = train([r["text"] or "" for r in got], [r["toxic"] for r in got], [r["lang"] for r in got], hold=False)
    if m is None:
        return None
    own = docs.where(F.col("doc_id").isNotNull() & (tc.crc_mod("doc_id", 5) != 0))
    return calibrate_all(m, own if few else own.where(held_back()), given if few else given.where(held_back()))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (tc.crc_mod("doc_id", 5) == 0).alias("held_out"))

    def run(batches):
        m = shared.value
        for b in batches:
            p = np.zeros(len(b))
            if m is not None:
                for a, z, data, off in tc.chunks(b.column("text"), tc.CHUNK_BYTES // 2):
                    p[a:z] = m.scores(data, off)
            cut = np.array([m.thresholds.get(x, m.thresholds[None]) if m else 1.0 for x in b.column("lang").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= cut)], ["doc_id", "held_out", "score", "predicted", "flagged"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame, cap: int = 3000) -> DataFrame:
    return score(docs, fit(docs, labels, cap))
