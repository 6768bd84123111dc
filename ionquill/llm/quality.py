"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; every passage of the whole text is
encoded. The model turns a passage's features into a hidden vector, weighs the
passages by gated attention (tanh and sigmoid branches, as in Ilse, Tomczak and
Welling 2018), and scores the weighted sum. Only documents have labels, so the
attention weights are learned from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
TEXTS_AT_ONCE = 256

#: Byte classes, each with the bytes that it holds; a byte counts for the first that has it, the rest are "other".
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r\x0b\x0c",
    "stop": b".", "comma": b",;:", "mark": b"!?", "quote": b"'\"`()", "dash": b"-_/", "bar": b"|\\[]{}<>", "sign": b"#$%&*+=@^~",
    "lead": bytes(range(0xC0, 0x100)), "inner": bytes(range(0x80, 0xC0)),
}
NAMES = [*CLASSES, "other"]
BY_BYTE = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in reversed(list(enumerate(CLASSES.values()))):
    BY_BYTE[list(_bytes)] = _k
IS_SPACE = np.zeros(257, bool)
IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True
UPPER, SIGNS = NAMES.index("upper"), [NAMES.index(n) for n in ("mark", "bar", "sign")]
WIDTH = len(NAMES) + 9


def passage_features(text: str | None) -> np.ndarray:
    """A row of features for each passage; one row of zeros where the text has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    codes = np.frombuffer(raw, np.uint8)
    gap = IS_SPACE[codes]
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True])
    kind = BY_BYTE[codes]
    first, last = kind[starts], kind[ends]
    second = kind[np.minimum(starts + 1, ends)]
    length = ends - starts + 1
    heads = np.arange(0, len(words), PASSAGE)
    n = len(heads)
    cuts = np.r_[0, starts[heads[1:]], len(raw)]
    size = np.diff(cuts)
    tally = np.bincount(np.repeat(np.arange(n) * len(NAMES), size) + kind, minlength=n * len(NAMES)).reshape(n, -1)
    count = np.diff(np.r_[heads, len(words)])
    share = lambda x: np.add.reduceat(x.astype(np.float64), heads) / count
    seen: set[bytes] = set()
    distinct, fresh = np.empty(n), np.empty(n)
    for k, head in enumerate(heads.tolist()):
        own = set(words[head : head + PASSAGE])
        distinct[k], fresh[k] = len(own) / count[k], len(own - seen) / len(own)
        seen |= own
    out = np.empty((n, WIDTH), np.float32)
    out[:, : len(NAMES)] = tally / size[:, None]
    out[:, len(NAMES) :] = np.column_stack([
        share(length) / 10, share(np.isin(last, SIGNS)), share(first == UPPER), share((first == UPPER) & (second == UPPER)),
        share(length == 1), share(length >= 20), distinct, fresh, np.log1p(count),
    ])
    return out


@dataclass
class AttentionModel:
    """Weights of the bag classifier; ``score`` gives the probability of label 1 for each bag."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(x: np.ndarray, hidden: int, gate: int, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        shapes = {"w": (x.shape[1], hidden), "b": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "o": (hidden,), "c": (1,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ao" else np.zeros(s) for k, s in shapes.items()}
        return AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        r = np.add.reduceat(att[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(r @ p["o"] + p["c"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "att": att, "r": r, "y": y, "bag": bag}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)["y"]

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)["att"]

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Of the mean logistic loss plus ``decay`` / 2 times the squared weights."""
        p, s = self.weights, self._forward(x, first)
        dy = (s["y"] - label) / len(label)
        dr = dy[:, None] * p["o"]
        dr_each = dr[s["bag"]]
        dh = s["att"][:, None] * dr_each
        datt = (s["h"] * dr_each).sum(axis=1)
        de = s["att"] * (datt - np.add.reduceat(s["att"] * datt, first)[s["bag"]])
        dgate = de[:, None] * p["a"]
        dt, dg = dgate * s["g"] * (1 - s["t"] ** 2), dgate * s["t"] * s["g"] * (1 - s["g"])
        dh = dh + dt @ p["v"].T + dg @ p["u"].T
        dz = dh * (1 - s["h"] ** 2)
        out = {"w": s["z"].T @ dz, "b": dz.sum(axis=0), "v": s["h"].T @ dt, "u": s["h"].T @ dg, "a": (s["t"] * s["g"]).T @ de, "o": s["r"].T @ dy, "c": dy.sum(keepdims=True)}
        return {k: d + decay * p[k] for k, d in out.items()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 12, gate: int = 6, rounds: int = 160, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam over all bags at once; the same bags in the same order give the same model."""
    x = np.concatenate(bags).astype(np.float64)
    first = np.cumsum([0] + [len(b) for b in bags[:-1]])
    model = AttentionModel.start(x, hidden, gate, seed)
    label = np.asarray(labels, np.float64)
    m = {k: np.zeros_like(w) for k, w in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    for step in range(1, rounds + 1):
        for k, d in model.gradients(x, first, label, decay).items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            model.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a row belongs to the part that labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def _sampled(labels: DataFrame, id_col: str, label_col: str, bound: int, seed: int) -> DataFrame:
    """Labelled rows to learn from, about ``bound`` of them, chosen by a hash of their id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = known.count()
    buckets = 1 << 30
    below = buckets if n <= bound else int(buckets * bound / n)
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)) < below)


def _spread(bag: np.ndarray, most: int) -> np.ndarray:
    """A bag's rows, or ``most`` of them from its first to its last."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 3000, seed: int = 7, passages: int = 128) -> AttentionModel | None:
    """The model, learned from about ``bound`` labelled documents; None without labels.

    A text of more than ``passages`` passages is learned from as many of them,
    spread evenly over the whole text. These two bounds are the only samples
    here: ``bound * passages * WIDTH`` floats reach the driver at most. Scoring
    reads every passage of every document.
    """
    chosen = _sampled(labels, id_col, label_col, bound, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_spread(passage_features(t), passages).astype("<f4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, bag binary")
    rows = sorted((r["doc_id"], bytes(r["bag"]), r["label"]) for r in found.toLocalIterator())
    if not rows:
        return None
    bags = [np.frombuffer(bag, "<f4").reshape(-1, WIDTH) for _, bag, _ in rows]
    return fit(bags, np.array([label for *_, label in rows]), seed=seed)


def _score_batches(model: AttentionModel | None):
    def score(texts: list[str | None]) -> np.ndarray:
        if model is None:
            return np.full(len(texts), 0.5)
        bags = [passage_features(t) for t in texts]
        first = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return model.score(np.concatenate(bags), first)

    return score


def scores(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Null and empty texts are one passage of zeros and get the score that the
    model gives that. Without any labels the model is None and every score 0.5.
    Very long texts are scored over all their passages; repeated rows get equal
    scores; a null id is not held out; an empty table gives no rows; other
    columns play no part.
    """
    score = _score_batches(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                y = score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    score = _score_batches(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                yield part.filter(pa.array(score(part.column(at).cast(pa.string()).to_pylist()) >= threshold))

    at = names.index(text_col)
    return docs.mapInArrow(run, docs.schema)
