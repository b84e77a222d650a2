"""Language of texts by a string kernel: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression.

1. A text is folded: lower case, every run of other characters than letters one blank, a blank at both ends. Its spectrum is
   the set of its n-grams of 1 to MAX_N characters, each hashed to one of DIMENSIONS places.
2. The kernel of two texts is the number of n-grams they share, divided by the geometric mean of their numbers of n-grams.
3. A bounded sample of labelled texts, about equally many per language, is drawn by a hash of the id. The first of each
   language are landmarks. With K the kernels of the sample against the landmarks and L those of the landmarks among
   themselves, the weights of all languages solve (K'K + ridge * rows * L) A = K'Y, where Y is 1 for a text's language and -1
   for the others: kernel ridge regression within the span of the landmarks, one language versus the rest.
4. Texts are scored in batches: a matrix of presence bits of the landmarks' n-grams times the landmarks gives the
   kernels, these times A the margins. The largest margin wins, ties go to the language that sorts first.

The spectrum of a text of any length has at most DIMENSIONS places, so a batch of BATCH_TEXTS is bounded whatever its texts are.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be learnt. The score is
the winning margin, from -1 to 1, brought to 0 to 1. Rows without id belong to the training part, as they are not held out; rows of
one id with several texts or languages count as the smallest. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import crc_rest, stored

UNKNOWN = "und"
#: Documented bounds: texts of the sample and landmarks, over all languages.
SAMPLE_ROWS, LANDMARKS = 4000, 192
MAX_N, BITS, RIDGE, BATCH_TEXTS = 4, 18, 1e-4, 128
DIMENSIONS = 1 << BITS
#: Characters of a text that are hashed at once.
PIECE = 1 << 20
_STEPS = 1 << 30
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- Spectra ------------------------------------------------------------------------


@cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark that belongs to one, else 0."""
    import unicodedata

    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def folded(text: str | None) -> np.ndarray:
    """Code points in lower case between single blanks (0); empty without any letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[points]
    if not (kind == 2).any():
        return np.array([], np.uint32)
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(kind > 0, points, 0)
    # Of a run of blanks the last one stays.
    keep = padded != 0
    keep[:-1] |= padded[1:] != 0
    keep[-1] = True
    return padded[keep]


def spectrum(text: str | None, marks: np.ndarray) -> np.ndarray:
    """The places of a text's n-grams, distinct and sorted. marks: DIMENSIONS flags, all off, for use here."""
    points = folded(text)
    shift = np.uint64(64 - BITS)
    for start in range(0, len(points), PIECE):
        piece = points[start : start + PIECE + MAX_N - 1].astype(np.uint64)
        rolling = np.zeros(len(piece), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(MAX_N, len(piece)) + 1):
                rolling = rolling[: len(piece) - n + 1] * np.uint64(0x100000001B3) + piece[n - 1 :] + np.uint64(1)
                hashed = (rolling ^ (rolling >> np.uint64(29)) ^ np.uint64(n << 60)) * _ODD
                marks[hashed >> shift] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    return found


# --- Learning -----------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_rest(doc_id, 4) == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """key, lang, text of about `rows` labelled texts outside the fold, about equally many of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(seed), "doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    # One pass counts the languages; the texts are read in the second one.
    counts = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    each = max(1, rows // max(1, counts.count()))
    shares = counts.select(F.col("lang").alias("_lang"), (F.least(F.lit(1.0), F.lit(each) / F.col("n")) * _STEPS).cast("long").alias("_below"))
    drawn = known.join(shares, F.col("lang") == F.col("_lang")).where(F.pmod("key", F.lit(_STEPS)) < F.col("_below"))
    return drawn.groupBy("key").agg(F.min(F.struct("lang", "text")).alias("first")).select("key", "first.lang", "first.text")


def fit(drawn: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Spectra are made in parallel; the bounded sample is learnt in one task, in an order that the ids fix."""

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(DIMENSIONS, bool)
        for batch in batches:
            found = [spectrum(t, marks).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "lang", "at"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        model = solve(group["lang"].tolist(), [np.frombuffer(a, "<u4").astype(np.int64) for a in group["at"]], landmarks, ridge)
        return pd.DataFrame({"name": list(model), "kind": [m.dtype.str for m in model.values()], "data": [m.tobytes() for m in model.values()]})

    made = stored(drawn.select("key", "lang", "text").mapInArrow(spectra, "key long, lang string, at binary").where("octet_length(at) > 0"), "spectra")
    found = made.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "name string, kind string, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]) for r in found}


def _presence(rows: list[np.ndarray], column_of: np.ndarray, columns: int) -> np.ndarray:
    """A matrix of ones where a row has an n-gram that has a column."""
    matrix = np.zeros((len(rows), columns), np.float32)
    for line, at in zip(matrix, rows, strict=True):
        held = column_of[at]
        line[held[held >= 0]] = 1
    return matrix


def solve(langs: list[str], rows: list[np.ndarray], landmarks: int, ridge: float) -> dict[str, np.ndarray]:
    """The model: names (of the languages, in UTF-8), known (places of the landmarks' n-grams), marks (the landmarks' bits), sizes, weights."""
    names = sorted(set(langs))
    of_lang = {name: [k for k, lang in enumerate(langs) if lang == name] for name in names}
    each = max(1, landmarks // len(names))
    chosen = [k for name in names for k in of_lang[name][:each]]
    known = np.unique(np.concatenate([rows[k] for k in chosen]))
    marks = _presence([rows[k] for k in chosen], column_of(known), len(known))
    sizes = np.array([len(rows[k]) for k in chosen], float)
    model = {"known": known.astype(np.int64), "marks": np.packbits(marks.astype(bool), axis=1).ravel(), "sizes": sizes}
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    kernels = Kernels(model)
    parts = range(0, len(rows), BATCH_TEXTS)
    against = np.concatenate([kernels.of(rows[k : k + BATCH_TEXTS]) for k in parts])
    among = kernels.of([rows[k] for k in chosen])
    # Each language weighs the same, however many of its texts were drawn.
    weight = np.array([len(langs) / len(names) / len(of_lang[lang]) for lang in langs])[:, None]
    left = against.T @ (weight * against) + ridge * len(rows) * among
    weights = np.linalg.lstsq(left, against.T @ (weight * target), rcond=1e-10)[0]
    return model | {"weights": weights.ravel(), "names": np.frombuffer("\0".join(names).encode(), np.uint8)}


def column_of(known: np.ndarray) -> np.ndarray:
    at = np.full(DIMENSIONS, -1, np.int32)
    at[known] = np.arange(len(known))
    return at


class Kernels:
    """Normalised kernels of texts against the landmarks, as matrix products."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.columns, self.sizes = column_of(model["known"]), model["sizes"]
        count = len(model["known"])
        bits = np.unpackbits(model["marks"].reshape(len(self.sizes), -1), axis=1)[:, :count]
        self.landmarks = np.ascontiguousarray(bits.T.astype(np.float32))

    def of(self, rows: list[np.ndarray]) -> np.ndarray:
        shared = _presence(rows, self.columns, len(self.landmarks)) @ self.landmarks
        sizes = np.array([max(1, len(r)) for r in rows], float)
        return shared / np.sqrt(sizes[:, None] * self.sizes)


# --- Scoring ------------------------------------------------------------------------


def judge(model: dict[str, np.ndarray]):
    """A function from texts to their languages and scores."""
    if not model:
        return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
    names = model["names"].tobytes().decode().split("\0")
    kernels, weights = Kernels(model), model["weights"].reshape(-1, len(names))
    marks = np.zeros(DIMENSIONS, bool)

    def of(texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [spectrum(t, marks) for t in texts]
        margins = kernels.of(rows) @ weights
        best = margins.argmax(1)
        score = np.clip((margins[np.arange(len(rows)), best] + 1) / 2, 0, 1)
        return (
            [names[b] if len(r) else UNKNOWN for b, r in zip(best.tolist(), rows, strict=True)],
            [s if len(r) else 0.0 for s, r in zip(score.tolist(), rows, strict=True)],
        )

    return of


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict[str, np.ndarray]:
    return fit(sample(docs, rows), landmarks, ridge)


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The model is bounded by the landmarks' bits and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                langs, scores = of(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def score(docs: DataFrame, rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learnt from the labelled texts outside the fold."""
    return predict(docs, train(docs, rows, landmarks, ridge))
