"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words in lower case without punctuation around them, their beginnings,
and marks for shouting, hashed. The machine adds a weight per term and, for each pair of terms, the product of their short vectors, so that an
insult beside the mention of a group can weigh more than both alone. Terms are those that go with the label
by more than chance (a two-sided z-score over the labelled sample), and those that do so among the documents of a term already
found, however neutral they are elsewhere; the others cannot carry weight in long texts. A pair whose terms are both neutral
is not found. It is learnt on a bounded labelled sample by stochastic gradients with per-weight rates.

Defined results: a null or empty text has no terms and gets the score of the bias. Repeated rows get equal
scores, other columns are ignored, an empty table gives an empty table. Without labelled rows every score
is the bias alone, below the threshold.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import crc_rest, lower_words
from runloom.llm.training import DIMENSIONS, SAMPLE_ROWS, fit, labelled_sample, logistic, places, scorer

THRESHOLD = 0.3
FACTORS = 4
MIN_DOCUMENTS = 5
MIN_Z = 4.0
#: For a term beside another one. There are many more pairs than terms, so chance reaches further.
MIN_PAIR_Z = 8.0
EPOCHS = 12
RATE, BIAS_RATE, DECAY = 0.15, 0.03, 1e-4
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Lengths in bytes of the beginnings of words that are terms as well; inflected forms of an insult share them.
STEMS = (4, 5, 6, 7)
#: Words that a task keeps while it scores, at about 150 bytes each; twice as many at most. While it learns a word
#: comes with all its terms, at about 500 bytes, and a fourth as many are kept.
CACHED_WORDS = 120_000


def hashed(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % DIMENSIONS


def word_terms(word: bytes) -> tuple[int, ...]:
    """The hashed terms that a word in lower case stands for."""
    bare = word.strip(PUNCTUATION)
    return (hashed(bare), *(hashed(bare[:n] + b"-") for n in STEMS if len(bare) > n))


def shouted(text: str) -> list[int]:
    """Hashed marks for the share of words in capitals and of words that end in two exclamation marks."""
    words = text.split()
    counts = (("upper", sum(map(str.isupper, words))), ("calls", sum(word.endswith("!!") for word in words) if "!!" in text else 0))
    return [hashed(f"{name} over {share} percent".encode()) for name, count in counts for share in (10, 30, 60) if 100 * count > share * len(words)]


class _ByWord(dict):
    """What a function says of a word, kept for words met lately.

    When it is full its words become the older ones; of these only what is met again comes back.
    """

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, word: bytes):
        value = self.older.pop(word, None)
        if value is None:
            value = self.function(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Terms:
    """The distinct hashed terms of texts, each with the value 1; terms of words are kept as long as this object is."""

    def __init__(self):
        self.known = _ByWord(word_terms, CACHED_WORDS // 4)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = {*chain.from_iterable(map(self.known.__getitem__, set(lower_words(text)))), *shouted(text or "")}
        at = np.array(sorted(found), np.int64)
        return at, np.ones(len(at))


def _beyond_chance(toxic: np.ndarray, every: np.ndarray, rate: float, least: float, floor: float) -> np.ndarray:
    """Where the toxic share differs from the rate by `least` times the spread or more; `floor` bounds the spread from below."""
    spread = np.maximum(np.sqrt(every * rate * (1 - rate)), floor)
    return (every >= MIN_DOCUMENTS) & (np.abs(toxic - every * rate) >= least * spread)


def _chosen(y: np.ndarray, examples: list) -> np.ndarray:
    """Terms whose share among toxic documents differs from that among the others beyond chance, alone or beside such a term."""
    none = np.array([], np.int64)
    every = np.bincount(np.concatenate([a for a, _ in examples] or [none]), minlength=DIMENSIONS)
    known = np.flatnonzero(every >= MIN_DOCUMENTS)
    at = places(known)
    rows = [(r := at[a])[r >= 0] for a, _ in examples]

    def count(some: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([rows[k] for k in some] or [none]), minlength=len(known))

    found = _beyond_chance(count(np.flatnonzero(y)), every[known], y.mean() if len(y) else 0.0, MIN_Z, 1e-9)
    new = np.flatnonzero(found)
    while len(new):
        # The documents of each term found last.
        is_new = np.zeros(len(known), bool)
        is_new[new] = True
        held = [r[is_new[r]] for r in rows]
        terms_held, documents = np.concatenate(held), np.repeat(np.arange(len(rows)), [len(h) for h in held])
        order = np.argsort(terms_held, kind="stable")
        ends = np.searchsorted(terms_held[order], new, side="right")
        before = found.copy()
        for part in np.split(documents[order], ends[:-1]):
            found |= _beyond_chance(count(part[y[part] > 0]), count(part), y[part].mean(), MIN_PAIR_Z, 1.0)
        new = np.flatnonzero(found & ~before)
    return known[found]


def learn(y: np.ndarray, examples: list) -> dict[str, np.ndarray]:
    known = _chosen(y, examples)
    at = places(known)
    rows = [(r := at[a])[r >= 0] for a, _ in examples]
    draw = np.random.default_rng(3)
    weights, vectors = np.zeros(len(known)), draw.normal(0, 0.05, (len(known), FACTORS))
    rate = min(max(y.mean() if len(y) else 0.0, 0.01), 0.99)
    bias, seen, seen_v, seen_b = float(np.log(rate / (1 - rate))), np.ones(len(known)), np.ones((len(known), FACTORS)), 1.0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)):
            r = rows[k]
            v = vectors[r]
            total = v.sum(0)
            margin = bias + weights[r].sum() + 0.5 * (total @ total - (v * v).sum())
            error = logistic(margin) - y[k]
            seen_b += error * error
            bias -= BIAS_RATE * error / np.sqrt(seen_b)
            if len(r):
                g = error + DECAY * weights[r]
                seen[r] += g * g
                weights[r] -= RATE * g / np.sqrt(seen[r])
                gv = error * (total - v) + DECAY * v
                seen_v[r] += gv * gv
                vectors[r] -= RATE * gv / np.sqrt(seen_v[r])
    return {"known": known.astype(np.int64), "weights": weights, "vectors": vectors.ravel(), "bias": np.array([bias])}


def judge(model: dict[str, np.ndarray]):
    """A function from a text to its score. Only terms with a weight are looked at."""
    row_of = {k: r for r, k in enumerate(model["known"].tolist())}
    weights = model["weights"]
    vectors, bias = model["vectors"].reshape(len(weights), FACTORS), float(model["bias"][0])
    rows = _ByWord(lambda word: tuple(row_of[k] for k in word_terms(word) if k in row_of), CACHED_WORDS)

    def score(text: str | None) -> float:
        found = set(chain.from_iterable(map(rows.__getitem__, set(lower_words(text)))))
        found.update(row_of[k] for k in shouted(text or "") if k in row_of)
        r = np.array(sorted(found), np.int64)
        v = vectors[r]
        total = v.sum(0)
        return float(logistic(bias + weights[r].sum() + 0.5 * (total @ total - (v * v).sum())))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_rest(doc_id, 4) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    model = fit(labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id")), sample_rows), Terms, learn)
    return model or learn(np.array([]), [])


def toxic_score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """A function from the text column to the score column, learnt from the labelled rows outside the fold."""
    return scorer(docs, train(docs, labels, sample_rows), judge)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", toxic_score(docs, labels, sample_rows)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    return docs.where(toxic_score(docs, labels, sample_rows)(docs["text"]) < THRESHOLD)
