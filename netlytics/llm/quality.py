"""Quality scores by attention-based multiple-instance learning (after Ilse et al. 2018).

A text is a bag of passages of ``PASSAGE`` bytes.  Each passage is described by how often kinds of
characters, and pairs of kinds, occur in it.  An encoder maps passages to vectors; gated attention weighs
them; the weighted vector is scored.  Only documents are labelled: the attention learns which passages
matter.  All weights are trained here by gradient descent, on all passages of at most ``max_labelled`` labelled
documents, chosen by a hash of their ids and of ``max_bytes`` bytes together at most; the model (about 40 kB) travels with the scoring function.

Every passage of every text is scored, whatever its length.  Null and empty texts are one passage without
characters.  Labels, ids and all other columns are never inputs of a score.  Without labelled documents of
both kinds there is nothing to learn: every text then has the share of label 1 among those there are as its score,
and 0.5 without any.  Ids with several labels are not learned from; of rows that share an id, the smallest text is.
An empty table gives an empty result, repeated rows get equal scores, ids may be of any type.  Columns of the
input that have the name of an added column give way to it; no other name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import bounded, labelled_sample, text_bytes

PASSAGE = 512
_KINDS = 16


def _kinds() -> np.ndarray:
    kind = np.full(256, 15, np.int64)  # control characters and the like
    for k, chars in enumerate((b" ", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"#*$%&", b"|", b"<>", b"\"'`", b";:()[]{}-_/\\+=@~^")):
        kind[list(chars)] = k
    kind[128:192], kind[192:] = 13, 14  # later and first bytes of other characters
    return kind


_KIND = _kinds()
N_FEATURES = _KINDS + _KINDS * _KINDS


def passage_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and how many passages each text has."""
    size = np.array([len(r) for r in raws])
    passages = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate(([0], np.cumsum(passages)[:-1]))
    kind = _KIND[np.frombuffer(b"".join(raws), np.uint8)]
    n = len(kind)
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    which = np.repeat(first, size) + at // PASSAGE
    total = int(passages.sum())
    ones = np.bincount(which * _KINDS + kind, minlength=total * _KINDS).reshape(total, _KINDS)
    same = which[1:] == which[:-1] if n else np.zeros(0, bool)
    pairs = (which[1:] * _KINDS + kind[:-1]) * _KINDS + kind[1:] if n else np.zeros(0, np.int64)
    twos = np.bincount(pairs[same], minlength=total * _KINDS**2).reshape(total, _KINDS**2)
    x = np.concatenate((ones, twos), axis=1).astype(np.float32)
    return np.sqrt(x / np.maximum(1, ones.sum(1, keepdims=True))), passages


class AttentionModel:
    """Encoder, gated attention and classifier, trained with Adam on whole bags."""

    constant: float | None = None  # the score of all texts where there was nothing to learn

    def __init__(self, width: int = 24, attention: int = 12, seed: int = 1):
        r = np.random.RandomState(seed)
        w = lambda *s: (r.randn(*s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"E": w(N_FEATURES, width) * 4, "e": np.zeros(width), "V": w(width, attention), "U": w(width, attention), "a": w(attention), "c": w(width), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray):
        p = self.p
        start = np.concatenate(([0], np.cumsum(bags)[:-1]))
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, start), bags))
        alpha = s / np.repeat(np.add.reduceat(s, start), bags)
        z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return y, (start, h, t, g, alpha, z)

    def gradients(self, x: np.ndarray, bags: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        y, (start, h, t, g, alpha, z) = self.forward(x, bags)
        d = (y - target) * weight / weight.sum()
        dz = np.repeat(d[:, None] * p["c"], bags, axis=0)
        dalpha = (dz * h).sum(1)
        ds = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, start), bags))
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, bags: np.ndarray, target: np.ndarray, *, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> AttentionModel:
        r = np.random.RandomState(seed)
        start = np.concatenate(([0], np.cumsum(bags)))
        share = target.mean()
        weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                rows = np.concatenate([np.arange(start[j], start[j + 1]) for j in pick])
                step += 1
                for k, grad in self.gradients(x[rows], bags[pick], target[pick], weight[pick]).items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, raws: list[bytes], most_bytes: int = 1 << 21) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raws), self.constant)
        out, i = [], 0
        while i < len(raws):
            j, size = i, 0
            while j < len(raws) and (j == i or size + len(raws[j]) <= most_bytes):
                size += len(raws[j])
                j += 1
            out.append(self.forward(*passage_features(raws[i:j]))[0])
            i = j
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col) -> F.Column:
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 3000, max_bytes: int = 16 << 20, **options
) -> AttentionModel:
    """A model from the whole texts of at most ``max_labelled`` documents that are labelled and not held out, ``max_bytes`` together at most."""
    bounded(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label"), F.count_distinct("label").alias("k")).where("k = 1").drop("k")
    rows = labelled_sample(docs, known, id_col=id_col, text_col=text_col, max_labelled=max_labelled, max_bytes=max_bytes)

    def features(batches):
        for batch in batches:
            blobs, ns = [], []
            for value in batch.column(0):
                x, n = passage_features([text_bytes(value)])
                blobs.append(x.astype(np.float16).tobytes())
                ns.append(int(n[0]))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(blobs, pa.binary()), pa.array(ns, pa.int32()), batch.column(1)], names=["id", "x", "n", "label"])

    got = rows.mapInArrow(features, "id long, x binary, n int, label int").toArrow().sort_by("id")
    target = got.column("label").to_numpy().astype(float)
    model = AttentionModel()
    if len(set(target.tolist())) < 2:
        model.constant = float(target.mean()) if len(target) else 0.5
        return model
    x = np.concatenate([np.frombuffer(b.as_py(), np.float16).reshape(-1, N_FEATURES) for b in got.column("x")]).astype(np.float32)
    return model.fit(x, got.column("n").to_numpy().astype(np.int64), target, **options)


def score(docs: DataFrame, model: AttentionModel, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with ``score_col`` (double) and ``predicted_col`` (int) added; one narrow pass."""
    bounded(docs)
    docs = docs.drop(score_col, predicted_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            y = model.scores([text_bytes(v) for v in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64()), pa.array((y >= 0.5).astype(np.int32))], names=[*names, score_col, predicted_col])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())]))
