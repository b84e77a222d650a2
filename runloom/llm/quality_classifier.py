"""Quality by logistic regression over hashed word n-grams, learnt with follow-the-regularised-leader.

Features are one- and two-word n-grams of the words in lower case, hashed, each with the square root of
its share. A word that repeats one of the three before it becomes one mark, and the run of punctuation at the
end of a word is a word of its own, so that stutter and litter of unknown words are seen. The weights are those
of FTRL-proximal with per-feature rates; its L1 part keeps few of them, and a document is scored as a
sparse dot product. It is learnt on a bounded labelled sample.

Defined results: a null or empty text has no features and gets the score of the bias. Repeated rows get
equal scores, other columns are ignored, an empty table gives an empty table. Without labelled rows every
score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import WordHashes, crc_rest, lower_words, n_grams
from runloom.llm.toxicity import PUNCTUATION
from runloom.llm.training import DIMENSIONS, SAMPLE_ROWS, fit, labelled_sample, logistic, places, scorer

THRESHOLD = 0.5
MIN_DOCUMENTS = 3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
REPEAT = np.uint64(0x5265706561746564)


class Features:
    """The features of texts; hashes of words are kept as long as this object is."""

    def __init__(self):
        self.words = WordHashes()
        self.ends = WordHashes(lambda word: b"end" + word[len(word.rstrip(PUNCTUATION)) :])
        self.no_end = np.uint64(self.ends[b""])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = lower_words(text)
        if not words:
            return np.array([], np.int64), np.array([])
        raw = self.words.of(words)
        repeated = np.zeros(len(raw), bool)
        for back in (1, 2, 3):
            repeated[back:] |= raw[back:] == raw[:-back]
        marked = np.where(repeated, REPEAT, raw)
        ends = self.ends.of(words)
        every = np.concatenate([n_grams(marked, 1), n_grams(marked, 2), n_grams(ends[ends != self.no_end], 1)])
        at, counts = np.unique(every % np.uint64(DIMENSIONS), return_counts=True)
        return at.astype(np.int64), np.sqrt(counts / len(words))


def learn(y: np.ndarray, examples: list) -> dict[str, np.ndarray]:
    every = np.bincount(np.concatenate([a for a, _ in examples] or [np.array([], np.int64)]), minlength=DIMENSIONS)
    known = np.flatnonzero(every >= MIN_DOCUMENTS)
    at = places(known)
    # The last weight is the bias, a feature of value 1 that every document has.
    rows = []
    for a, v in examples:
        r = at[a]
        rows.append((np.append(r[r >= 0], len(known)), np.append(v[r >= 0], 1.0)))
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)

    def leader(r: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[r]) <= L1, 0.0, -(z[r] - np.sign(z[r]) * L1) / ((BETA + np.sqrt(n[r])) / ALPHA + L2))

    draw = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)):
            r, x = rows[k]
            w = leader(r)
            g = (logistic(float(w @ x)) - y[k]) * x
            step = (np.sqrt(n[r] + g * g) - np.sqrt(n[r])) / ALPHA
            z[r] += g - step * w
            n[r] += g * g
    weights = leader(np.arange(len(known) + 1))
    used = np.flatnonzero(weights[:-1])
    return {"known": known[used].astype(np.int64), "weights": weights[used], "bias": weights[-1:].copy()}


def judge(model: dict[str, np.ndarray]):
    dense, bias = np.zeros(DIMENSIONS), float(model["bias"][0])
    dense[model["known"]] = model["weights"]
    features = Features()

    def score(text: str | None) -> float:
        at, values = features(text)
        return float(logistic(bias + float(dense[at] @ values)))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_rest(doc_id, 3) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    model = fit(labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id")), sample_rows), Features, learn)
    return model or learn(np.array([]), [])


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    judged = scorer(docs, train(docs, labels, sample_rows), judge)
    scored = docs.select("doc_id", judged(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
