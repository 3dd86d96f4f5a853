"""Quality rules with line labels from a linear-chain conditional random field.

Lines are content or boilerplate.  The field's weights are learned on lines of labelled documents: a
line takes its document's label, a biased hint, since good documents have boilerplate lines and bad ones
content.  The Viterbi decoding of a text labels its lines together, and the share of word characters in
content lines decides whether the text is kept.

Words are maximal runs without ``[\\x20\\x09-\\x0D]``.  Null texts have no words; such texts, and all with
under ``min_words`` words or too many repeated windows, fail the base rules.  Texts of any length are judged whole.

The field is fitted on the whole texts of at most ``max_labelled`` documents, chosen by a hash of their ids and of ``max_bytes`` bytes together at most,
in sequences of ``BLOCK`` lines.  Ids with several labels are not learned from.
Without labelled documents of both kinds every line is content, so that the base rules alone decide.
An empty table gives an empty result.  Every row is judged by itself: ids may be of any type, absent or shared.
Only the id and text columns are looked at, so no other name clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, bounded, labelled_sample, mix, span_hashes, text_bytes, word_bounds

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[list(b"!?\"'`;:()[]{}-_/\\+=@~^")] = True
BLOCK = 64
FEATURES = ("one", "upper", "symbols", "marks", "digits", "words", "ended", "seen", "long_words")


def base_counts(raw: bytes, window: int = 8) -> dict[str, int]:
    """Word, symbol, repeated-line and repeated-window counts of a text."""
    a = np.frombuffer(raw, np.uint8)
    start, end = word_bounds(a)
    n = len(start)
    out = {"n_words": n, "word_chars": 0, "n_symbols": int(_SYMBOL[a].sum()), "n_dup_lines": 0, "n_repeat_words": 0}
    if n:
        chars = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
        out["word_chars"] = int((chars[end] - chars[start]).sum())
    if n >= window:
        h = span_hashes(a, start, end)
        s = np.zeros(n - window + 1, U64)
        for i in range(window):
            s += mix(h[i : n - window + 1 + i] + U64(i))
        _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        if again.any():
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.flatnonzero(again), 1)
            np.add.at(cover, np.flatnonzero(again) + window, -1)
            out["n_repeat_words"] = int((np.cumsum(cover)[:n] > 0).sum())
    return out


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and word characters (bytes) of the lines with a word, and how many of these equal an earlier one."""
    lines = [x for x in bytes(raw).split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    if not lines:
        return np.zeros((0, len(FEATURES))), np.zeros(0), 0
    a = np.frombuffer(b"".join(lines), np.uint8)
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size) - size
    count = lambda mask: np.add.reduceat(mask[a].astype(np.int64), start)
    gap = np.isin(a, (9, 11, 12, 13, 32))
    first = np.ones(len(a), bool)
    first[1:] = gap[:-1]
    first[start] = True
    words = np.add.reduceat((first & ~gap).astype(np.int64), start)
    chars = size - np.add.reduceat(gap.astype(np.int64), start)
    seen, again = set(), np.zeros(len(lines))
    for i, x in enumerate(lines):
        again[i] = x in seen
        seen.add(x)
    ended = np.array([x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines], float)
    letters = np.maximum(1, count(_LETTER))
    x = np.stack((np.ones(len(lines)), count(_UPPER) / letters, np.minimum(2, count(_SYMBOL) / words), np.minimum(2, count(_MARK) / words), count(_DIGIT) / chars, np.log1p(words) / 3, ended, again, np.minimum(3, chars / words / 8)), axis=1)
    return x, chars.astype(float), int(again.sum())


class LineField:
    """A linear-chain CRF with two labels (1: content): emission weights and symmetric transitions."""

    def __init__(self, emission: np.ndarray, stay: float):
        self.emission, self.stay = emission, stay  # log-odds of content; bonus for equal neighbours

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labels of one text's lines."""
        odds = (x @ self.emission).tolist()
        stay, back = self.stay, []
        no, yes = 0.0, odds[0]
        for o in odds[1:]:
            from_no, from_yes = no + stay >= yes, yes + stay >= no
            back.append((from_no, from_yes))
            no, yes = (no + stay if from_no else yes), (yes + stay if from_yes else no) + o
        labels = [yes > no]
        for from_no, from_yes in reversed(back):
            labels.append(from_yes if labels[-1] else not from_no)
        return np.array(labels[::-1], bool)

    @staticmethod
    def fit(texts: list[np.ndarray], labels: np.ndarray, *, rounds: int = 250, rate: float = 1.0, decay: float = 0.01) -> LineField:
        """Maximum penalised likelihood: forward-backward over all texts at once, one line of each at a time."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        texts, labels, size = [texts[i] for i in order], labels[order], size[order]
        at = np.cumsum(size) - size
        x = np.concatenate(texts)
        line_weight = np.repeat(np.where(labels > 0, 0.5 / max(1, (size * labels).sum()), 0.5 / max(1, (size * (1 - labels)).sum())), size) * len(x)
        live = [int((size > t).sum()) for t in range(size[0])]
        y = np.repeat(labels, size).astype(float)
        w, stay = np.zeros(x.shape[1]), 0.0
        pairs = max(1, len(x) - len(texts))
        for _ in range(rounds):
            odds = x @ w
            forward, backward = np.zeros(len(x)), np.zeros(len(x))
            step = lambda m: np.logaddexp(stay + m, 0) - np.logaddexp(stay, m)  # noqa: E731  log-odds passed to a neighbour
            forward[at] = odds[at]
            for t in range(1, len(live)):
                i = at[: live[t]] + t
                forward[i] = odds[i] + step(forward[i - 1])
            for t in range(len(live) - 1, 0, -1):
                i = at[: live[t]] + t
                backward[i - 1] = step(backward[i] + odds[i])
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -30, 30)))
            inner = np.ones(len(x), bool)
            inner[at] = False
            i = np.flatnonzero(inner)
            left, right = forward[i - 1], odds[i] + backward[i]
            agree = np.logaddexp(left + right, 0) + stay
            differ = np.logaddexp(left, right)
            equal = 1 / (1 + np.exp(np.clip(differ - agree, -30, 30)))
            w = w + rate * ((x * ((y - p) * line_weight)[:, None]).mean(0) - decay * w / 10)
            stay = max(0.0, stay + rate * ((1 - equal).sum() / pairs - decay * stay))
        return LineField(w, stay)


def all_content() -> LineField:
    """The field without anything to learn from: each line is content."""
    return LineField(np.eye(len(FEATURES))[0], 0.0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 1500, max_bytes: int = 8 << 20) -> LineField:
    """A field from the whole texts of at most ``max_labelled`` labelled documents, chosen by a hash of their ids, ``max_bytes`` together at most."""
    bounded(docs)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("label").alias("label"), F.min("label").alias("other")).where("label = other").drop("other")
    rows = labelled_sample(docs, known, id_col=id_col, text_col=text_col, max_labelled=max_labelled, max_bytes=max_bytes)

    def features(batches):
        for batch in batches:
            blobs, label, ids = [], [], []
            for value, y, doc in zip(*batch.columns, strict=True):
                x = line_features(text_bytes(value))[0].astype(np.float32)
                for i in range(0, len(x), BLOCK):  # a long text is a sequence for each block
                    blobs.append(x[i : i + BLOCK].tobytes())
                    label.append(y.as_py())
                    ids.append((doc.as_py(), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([k for _, k in ids], pa.int32()), pa.array(blobs, pa.binary()), pa.array(label, pa.int32())], names=["id", "k", "x", "label"])

    got = rows.mapInArrow(features, "id long, k int, x binary, label int").toArrow().sort_by([("id", "ascending"), ("k", "ascending")])
    texts = [np.frombuffer(b.as_py(), np.float32).reshape(-1, len(FEATURES)).astype(float) for b in got.column("x")]
    target = got.column("label").to_numpy()
    if len(set(target.tolist())) < 2:
        return all_content()
    return LineField.fit(texts, target)


def apply_rules(
    df: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat: tuple[int, int] = (30, 100), min_content: float = 0.5
) -> DataFrame:
    """(id, counts, content_share, base_failed, kept) of each whole text; one narrow pass."""
    bounded(df)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            rows, share, failed, kept = [], [], [], []
            for value in batch.column(1):
                raw = text_bytes(value)
                c = base_counts(raw)
                x, chars, c["n_dup_lines"] = line_features(raw)
                content = float(chars[field.viterbi(x)].sum() / chars.sum()) if len(x) else 0.0
                bad = c["n_words"] < min_words or max_repeat[1] * c["n_repeat_words"] > max_repeat[0] * c["n_words"]
                rows.append([c[k] for k in counts])
                share.append(content)
                failed.append(bad)
                kept.append(not bad and content >= min_content)
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(share, pa.float64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[id_col, *counts, "content_share", "base_failed", "kept"])

    added = StructType.fromDDL(", ".join(f"{c} long" for c in counts) + ", content_share double, base_failed boolean, kept boolean")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, StructType([df.schema[id_col], *added]))
