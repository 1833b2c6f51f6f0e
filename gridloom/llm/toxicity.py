"""Toxic passages as maximal-scoring segments over token log-odds.

Lexicon: the log-odds of a token between toxic and other labelled texts, with Dirichlet priors in a hierarchy: a
word's prior mean is the estimate of its six-letter prefix, whose prior is that of its four-letter prefix, whose
prior is the rate over all tokens. So rare and unseen forms of a word lean on what its prefix shows. What is left of the log-odds, for
or against, beyond ERRORS standard errors is the token's evidence; its score is that less COST, what a token more in a passage must bring.

Segments: the linear scan of Ruzzo and Tompa finds all maximal segments of positive total. Extreme-value
theory (Karlin and Altschul) gives each a p-value for a text of its length, and the best sums of them one for the
text; its evidence is -ln of that, and a logistic curve fitted on held-back labelled rows maps it to 0..1. The decay lambda solves
the theory's equation over the tokens of texts that are not toxic; K is the maximum-likelihood estimate from the best segments of the held-back texts
that are not toxic.

Fitted on a bounded sample of labelled rows (SAMPLE); every whole text is scored.

Defined cases: null and empty texts have no segments and the score of no evidence; with no toxic or no other
labelled text all scores are 0; repeated rows get equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fold, labelled_sample, shared, whole_text

#: Labelled documents that the lexicon and the calibration are fitted on, at most.
SAMPLE = 20_000
#: One labelled row in CALIBRATION fits the logistic curve; the others fit the lexicon.
CALIBRATION = 5
#: What each token of a segment costs; the score of a token without evidence.
COST = 0.5
NEUTRAL = -COST
#: Pseudo-tokens of each prior.
STRENGTH = 1.0
#: Standard errors by which log-odds are shrunk towards none.
ERRORS = 1.64
#: Largest p-value of a significant segment.
SIGNIFICANT = 0.05
#: Words whose scores a worker keeps at hand.
REMEMBERED = 300_000
PREFIXES = (4, 6)
TOKEN = re.compile(r"[^\W_]+")


def evidence_of(toxic, n, mean, rate: float):
    """Log-odds of a share with a prior, against the rate, shrunk by ERRORS standard errors; for numbers and arrays."""
    p = (toxic + STRENGTH * mean) / (n + STRENGTH)
    odds = np.log(p / (1 - p)) - math.log(rate / (1 - rate))
    error = np.sqrt(1 / (toxic + STRENGTH * rate) + 1 / (n - toxic + STRENGTH))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - ERRORS * error)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Lexicon:
    """Scores of tokens, and the scale of segment scores."""

    def __init__(self, counts: pd.DataFrame, stems: pd.DataFrame):
        """stems: stem (of a size in PREFIXES), n (times that a labelled text has a word with it), toxic (of those, in toxic texts), for all
        words, but for long stems of one text; counts: word, n, toxic, for words that two texts have or more. One text alone shows nothing beyond the error."""
        self.scores: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        self.k = 1.0
        short = stems[stems["stem"].str.len() <= PREFIXES[0]]
        n, toxic = float(short["n"].sum()), float(short["toxic"].sum())
        self.usable = 0 < toxic < n
        self.decay = 1.0
        if not self.usable:
            return
        rate = toxic / n
        mean = dict(zip(short["stem"], (short["toxic"] + STRENGTH * rate) / (short["n"] + STRENGTH)))
        self.stems = dict(zip(short["stem"], evidence_of(short["toxic"].to_numpy(float), short["n"].to_numpy(float), rate, rate).tolist()))
        long = stems[stems["stem"].str.len() > PREFIXES[0]]
        outer = long["stem"].str.slice(0, PREFIXES[0]).map(mean).to_numpy(float)
        self.stems |= dict(zip(long["stem"], evidence_of(long["toxic"].to_numpy(float), long["n"].to_numpy(float), outer, rate).tolist()))
        mean |= dict(zip(long["stem"], (long["toxic"] + STRENGTH * outer) / (long["n"] + STRENGTH)))
        inner = counts["word"].str.slice(0, PREFIXES[1]).map(mean).to_numpy(float)
        self.scores = dict(zip(counts["word"], (evidence_of(counts["toxic"].to_numpy(float), counts["n"].to_numpy(float), inner, rate) - COST).tolist()))
        self.stems = {w: s - COST for w, s in self.stems.items()}
        # words of one text count with their stem's score
        clean = (counts["n"] - counts["toxic"]).to_numpy(float)
        ends = long if len(long) else short
        whole = (ends["n"] - ends["toxic"]).to_numpy(float)
        given = np.concatenate([np.array([self.scores[w] for w in counts["word"]]), np.array([self.stems[w] for w in ends["stem"]])])
        counted = pd.Series(clean).groupby(counts["word"].str.slice(0, PREFIXES[1]).to_numpy(str)).sum()
        left = np.maximum(0, whole - ends["stem"].map(counted).fillna(0).to_numpy(float))
        self._fit_decay(given, np.concatenate([clean, left]))

    def score(self, word: str) -> float:
        s = self.scores.get(word)
        if s is None:
            s = self.stems.get(word[: PREFIXES[1]])
        if s is None:
            s = self.stems.get(word[: PREFIXES[0]])
        return NEUTRAL if s is None else s

    def _fit_decay(self, scores: np.ndarray, clean: np.ndarray) -> None:
        """lambda > 0 with sum p(s) exp(lambda s) = 1 over the token scores of texts that aren't toxic."""
        # half a token of the best score stands for what the sample did not show
        values, weights = np.append(scores, max(1.0, float(scores.max(initial=1.0)))), np.append(clean, 0.5) / (clean.sum() + 0.5)
        low, high = 0.0, 60.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if (weights * np.exp(np.minimum(mid * values, 600))).sum() > 1 else (mid, high)
        self.decay = max(low, 0.05)

    def fit_k(self, best: np.ndarray, words: np.ndarray) -> None:
        """K from the best segment scores (0 for none) and the lengths of texts that aren't toxic: K m exp(-lambda best) is exponential of mean 1."""
        total = (words * np.exp(-self.decay * best)).sum()
        self.k = float(max((best > 0).sum(), 0.5) / total) if total > 0 else 1.0

    def _scored(self, words: list[str]) -> list[float]:
        known = self.__dict__.setdefault("known", {})
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.score(w)
        return [known[w] for w in words]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments as (first word, end, score), in one pass over the words with a score above zero.

        Words between two of those only lower the sum, so they are passed as one step of their total.
        """
        scores = self._scored(words)
        found = [i for i, s in enumerate(scores) if s > 0]
        if not found:
            return []
        sums = list(accumulate(scores, initial=0.0))
        kept: list[list] = []  # start, end, sum before it, sum up to its end, the segment that its start is held against
        for i in found:
            now = [i, i + 1, sums[i], sums[i + 1]]
            while True:
                j = len(kept) - 1
                while j >= 0 and kept[j][2] >= now[2]:
                    j = kept[j][4]
                now[4:] = [j]
                if j < 0 or kept[j][3] >= now[3]:
                    kept.append(now)
                    break
                now = [kept[j][0], now[1], kept[j][2], now[3]]
                del kept[j:]
        return [(a, b, right - left) for a, b, left, right, _ in kept]

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """-ln of the text's p-value, and its segments as (first word, end, p) from the most significant down to SIGNIFICANT.

        The p-value is the least, over r, of that of the sum of the r best normalised scores (the sum statistic of
        Karlin and Altschul), so several weak passages count as well as one strong passage.
        """
        words = tokens(text)
        found = self.segments(words)
        if not found:
            return 0.0, []
        norm = math.log(self.k * max(len(words), 1))
        scaled = sorted(((self.decay * s - norm, a, b) for a, b, s in found), reverse=True)
        best, total = 0.0, 0.0
        for r, (x, _, _) in enumerate(scaled, 1):
            total += x
            if total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) if total > r else 0.0)
        spans = [(a, b, -math.expm1(-math.exp(-x))) for x, a, b in scaled if x > 0]
        return best, [s for s in spans if s[2] <= SIGNIFICANT]


def word_counts(sample: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(word, n, toxic) of words that two texts of the sample have or more, and (stem, n, toxic) of all. A text counts once for a word, so repetition proves nothing."""

    def run(batches):
        for batch in batches:
            own = [sorted(set(tokens(t))) for t in batch.column(1).to_pylist()]
            label = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.record_batch([pa.array([w for x in own for w in x], pa.string()), pa.array(label)], ["word", "label"])

    words = cut(sample.select("label", "text").mapInArrow(run, "word string, label int").groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")))
    each = words.select("n", "toxic", F.explode(F.array_distinct(F.array(*[F.substring("word", 1, k) for k in PREFIXES]))).alias("stem"))
    stems = each.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter((F.col("n") > 1) | (F.char_length("stem") <= PREFIXES[0]))
    return words.filter("n > 1").toArrow().to_pandas().sort_values("word", ignore_index=True), stems.toArrow().to_pandas().sort_values("stem", ignore_index=True)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _evidence(rows: DataFrame, lexicon, extra: str, kind: str) -> DataFrame:
    def run(batches):
        lex = lexicon()
        for batch in batches:
            got = [lex.evidence(t) if lex.usable else (0.0, []) for t in batch.column(1).to_pylist()]
            spans = pa.array([[{"first": a, "end": b, "p": p} for a, b, p in s] for _, s in got], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))
            yield pa.record_batch([batch.column(0), pa.array([e for e, _ in got], pa.float64()), spans], [extra, "evidence", "segments"])

    return rows.mapInArrow(run, f"{extra} {kind}, evidence double, segments array<struct<first:bigint,end:bigint,p:double>>")


def _best(rows: DataFrame, lexicon) -> DataFrame:
    """rows: label, text. (best, words): the best segment score and the number of tokens of each text."""

    def run(batches):
        lex = lexicon()
        for batch in batches:
            own = [tokens(t) for t in batch.column(1).to_pylist()]
            best = [max((s for _, _, s in lex.segments(w)), default=0.0) for w in own]
            yield pa.record_batch([pa.array(best, pa.float64()), pa.array([len(w) for w in own], pa.int64())], ["best", "words"])

    return rows.mapInArrow(run, "best double, words bigint")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", most: int = SAMPLE):
    """The lexicon (broadcast; bounded by the sample) and the calibration curve."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, allowed, most).select("*", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(CALIBRATION)) == 0).alias("later"))
    sample = cut(sample)
    made = Lexicon(*word_counts(sample.filter("NOT later")))
    rows = sample.filter("later").select("label", "text")
    if made.usable:
        best = _best(rows.filter("label = 0"), shared(spark, made)).toPandas().sort_values(["best", "words"])
        made.fit_k(best["best"].to_numpy(float), best["words"].to_numpy(float))
    lexicon = shared(spark, made)
    found = _evidence(rows, lexicon, "label", "int").select("label", "evidence").toPandas().sort_values(["evidence", "label"])
    y = found["label"].to_numpy(float)
    if made.usable and 0 < y.sum() < len(y):
        return lexicon, logistic(np.log1p(found["evidence"].to_numpy()), y)
    return lexicon, ((4.0, -6.0) if made.usable else (0.0, -math.inf))


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, evidence, segments): segments are the significant passages as word positions with p-values."""
    lexicon, (slope, start) = model
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    found = _evidence(rows, lexicon, "key", rows.schema["key"].dataType.simpleString())
    value = F.lit(0.0) if start == -math.inf else 1 / (1 + F.exp(-(F.log1p("evidence") * slope + start)))
    return found.select(F.col("key").alias(key), value.alias("score"), "evidence", "segments")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, fold("doc_id", 3) != 1))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))
