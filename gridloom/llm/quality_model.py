"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of about PASSAGE bytes. Each passage is encoded by what its bytes look like: frequencies of
pairs of character classes, word length and shape, and how many of its words are new in it and in the text. One
hidden layer embeds a passage; gated attention (tanh times sigmoid) weighs the passages of a text, and the weighted
mean is scored. The labels are of texts only; the attention learns which passages carry them.

Fitted on a bounded sample of labelled rows (SAMPLE texts, FITTED passages of each: 160 MB of features at most); every passage of every text is encoded and scored.

Defined cases: null and empty texts are one empty passage; with one label value only, the score is that of the share of
label 1 (0.5 without labels); repeated rows get equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, fold, labelled_sample, shared, whole_text

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
PASSAGE = 512
#: Passages of a text that the model is fitted on, at most; of a longer text, as many at equal distances over the whole of it.
FITTED = 64
HIDDEN, ATTENTION = 24, 12
STEPS, RATE, DECAY, SEED = 400, 0.01, 1e-3, 7
#: Bytes encoded at once.
STEP_BYTES = 1_000_000


def _classes() -> np.ndarray:
    out = np.full(256, 11, np.uint8)
    for number, chars in enumerate((b"aeiouy", b"bcdfghjklmnpqrstvwxz", bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"-()", b"#*$%&|<>=_~^@+/\\")):
        out[list(chars)] = number
    out[128:] = 10
    return out


CLASS, CLASSES = _classes(), 12
EXTRA = 8
FEATURES = CLASSES * CLASSES + EXTRA


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows of FEATURES float32), and the number of passages of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)  # every text ends with a gap
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    gaps = np.flatnonzero(gap)
    # A passage ends at the first gap from each multiple of PASSAGE on.
    n = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), n)
    wanted = starts[owner] + PASSAGE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    first = wanted.copy()
    inner = wanted > starts[owner]
    first[inner] = gaps[np.searchsorted(gaps, wanted[inner])]
    last = first == (starts + sizes)[owner]  # nothing but the end of the text follows: no passage of its own
    keep = ~(last & inner)
    keep[1:] &= ~((first[1:] == first[:-1]) & inner[1:])
    owner, first = owner[keep], first[keep]
    n = np.bincount(owner, minlength=len(texts))
    p = len(first)
    length = np.diff(np.append(first, len(data)))
    passage = np.repeat(np.arange(p), length)
    kind = CLASS[data].astype(np.int64)
    following = np.append(kind[1:], 5)
    following[starts + sizes] = 5  # nothing of the next text
    pairs = np.bincount(passage * (CLASSES * CLASSES) + kind * CLASSES + following, minlength=p * CLASSES * CLASSES).reshape(p, -1)
    out = np.zeros((p, FEATURES), np.float32)
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / length[:, None]) * 3
    out[:, -4] = np.log1p(1) / 4  # as for a passage of one word; a text without words looks the same in any batch
    # Words and their hashes: a polynomial over the bytes, from prefix sums modulo 2^64.
    word_start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if len(word_start):
        word_end = gaps[np.searchsorted(gaps, word_start)]
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        power = np.multiply.accumulate(np.full(int((word_end - word_start).max()) + 1, 0x100000001B3, np.uint64))
        lead = word_start[0]
        place = np.zeros(len(data), np.int64)
        place[lead:] = np.arange(lead, len(data)) - np.repeat(word_start, np.diff(np.append(word_start, len(data))))
        term = np.where(gap, np.uint64(0), (mixed ^ (mixed >> np.uint64(31))) * power[np.minimum(place, len(power) - 1)])
        h = np.add.reduceat(term, word_start)
        of, text = passage[word_start], owner[passage[word_start]]
        words = np.maximum(np.bincount(of, minlength=p), 1)
        letters = np.bincount(of, word_end - word_start, minlength=p)

        def fresh(group: np.ndarray) -> np.ndarray:
            order = np.lexsort((np.arange(len(h)), h, group))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
            back = np.empty(len(h), bool)
            back[order] = new
            return back

        same = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])
        out[:, -8] = np.bincount(of, fresh(of), minlength=p) / words
        out[:, -7] = np.bincount(of, fresh(text), minlength=p) / words
        out[:, -6] = np.bincount(of, same, minlength=p) / words
        out[:, -5] = np.log1p(letters / words)
        out[:, -4] = np.log1p(words) / 4
        out[:, -3] = np.bincount(of, (word_end - word_start) > 20, minlength=p) / words
    out[:, -2] = (np.log1p(sizes) / 8)[owner]
    out[:, -1] = np.log1p(n)[owner] / 4
    return out, n


class Model:
    """Weights, and the forward and backward pass over bags given as runs of passages."""

    def __init__(self, features: np.ndarray, n: np.ndarray, labels: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.usable = len(labels) > 1 and 0 < labels.sum() < len(labels)
        if not self.usable:
            return
        self.center, self.scale = features.mean(0), features.std(0) + 0.05
        self.weights = {
            "w": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION),
            "c": rng.normal(0, 0.3, HIDDEN), "d": np.array([np.log(self.prior / (1 - self.prior))]),
        }
        x = (features - self.center) / self.scale
        first, second = {k: np.zeros_like(v) for k, v in self.weights.items()}, {k: np.zeros_like(v) for k, v in self.weights.items()}
        # both labels weigh alike while fitting; the intercept is set back to the true shares below
        cost = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
        for step in range(1, STEPS + 1):
            for k, g in self._gradients(x, n, labels, cost).items():
                g = g + DECAY * self.weights[k] * (k != "d")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray, n: np.ndarray):
        w, starts = self.weights, np.cumsum(n) - n
        h = np.tanh(x @ w["w"] + w["b"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
        attention = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(attention[:, None] * h, starts)
        return h, t, g, attention, z, z @ w["c"] + w["d"]

    def _gradients(self, x, n, y, cost):
        w = self.weights
        h, t, g, attention, z, logit = self._forward(x, n)
        d = (1 / (1 + np.exp(-logit)) - y) * cost
        dz = np.repeat(d, n)[:, None] * w["c"]
        dot = (dz * h).sum(1)
        ds = attention * (dot - np.repeat(np.add.reduceat(attention * dot, np.cumsum(n) - n), n))
        dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
        dh = (attention[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ d, "d": np.array([d.sum()])}

    def score(self, features: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the texts, and the attention of the passages."""
        if not self.usable:
            return np.full(len(n), self.prior), np.repeat(1 / n, n)
        out = self._forward((features - self.center) / self.scale, n)
        return 1 / (1 + np.exp(-np.clip(out[5], -30, 30))), out[3]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", most: int = SAMPLE):
    """The model on executors; its size is fixed by the numbers of features and hidden units."""
    kind = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("n", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], STEP_BYTES):
                x, n = encode(texts[a:b])
                ends = np.cumsum(n)
                rows = [x[e - k + (np.arange(min(k, FITTED)) * k) // min(k, FITTED)].tobytes() for e, k in zip(ends, n)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.minimum(n, FITTED), pa.int32()), pa.array(rows, pa.binary())], schema=kind)

    sample = labelled_sample(docs, labels, label, allowed, most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    got = sample.mapInArrow(run, "doc_id bigint, label int, n int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return shared(docs.sparkSession, Model(x, got["n"].to_numpy(), got["label"].to_numpy().astype(float)))


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_passages, top_passage): top_passage is the number of the passage with the most attention."""

    def run(batches):
        own = model()
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], STEP_BYTES):
                x, n = encode(texts[a:b])
                value, attention = own.score(x, n)
                ends = np.cumsum(n)
                top = [int(attention[e - k : e].argmax()) for e, k in zip(ends, n)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(value), pa.array(n, pa.int64()), pa.array(top, pa.int64())], ["key", "score", "n_passages", "top_passage"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, n_passages bigint, top_passage bigint").withColumnRenamed("key", key)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, fold("doc_id", 5) != 0))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage")
