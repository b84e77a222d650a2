"""A word-pair language model in an Elias-Fano trie, learnt from the corpus and asked for all of it.

Level 1 is the vocabulary: sorted word hashes with counts. Level 2 has for each context (a word or the start of a
text) its successors; pointers from contexts to successors and the successors themselves, made monotone by adding the context's
base, are Elias-Fano sequences, and each successor has a smoothed log10 probability quantised to one byte. The
levels are files in the shared folder, mapped into memory by the tasks that read them. A pair is looked up by its context's
pointers and a successor search between them.

Smoothing is Bayesian with the unigrams as prior: p(w | c) = (n(c, w) + m * p(w)) / (n(c) + m), where
p(w) = (n(w) + 0.1) / (N + 0.1 * (V + 1)) also covers one unknown word. Pairs that are not in the trie and pairs with an unknown
word follow from the same formula with a count of 0; after an unknown word it is p(w).

Level 2 is cut into blocks of about equally many pairs of the corpus, along (context, word); a frequent context spans several blocks.
Texts are read in batches; each batch sends a block its distinct pairs with their counts in training texts, and the task of a block
adds the counts up, builds and maps its part of the trie, and answers each pair once per batch. The sums per text are made with the batch, which
keeps for each token the place of its pair. So counts and answers share one shuffle, a pair weighs at most one entry per batch
in its block however often it occurs, and nothing is broadcast.

Defined results: null and empty texts are the end token alone. A row without id belongs to the training part, as one that is not held
out. Repeated rows are texts of their own. An empty table gives an empty table; without training rows all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import WordHashes, crc_rest, lower_words, sized, stored
from runloom.llm.elias_fano import EliasFano, encode, from_buffer, nested, to_bytes
from runloom.llm.shared_files import SharedFolder
from runloom.session import scratch_dir

PRIOR = 50.0
ADDED = 0.1
#: Pairs of a block, the least number of blocks, and tokens that a batch of texts sends at once.
BLOCK_PAIRS, MIN_BLOCKS, BATCH_TOKENS = 2_000_000, 64, 1_000_000


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words and of the end, which is the empty word, as no other word is."""
    return hashes.of([*lower_words(text), b""])


# --- Level 1 ----------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """hash, n over all tokens of the column `text`."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, words = [], 0, WordHashes()

        def send() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py(), words))
                total += len(held[-1])
                if total >= 4 * BATCH_TOKENS:
                    yield send()
                    held, total = [], 0
        if held:
            yield send()

    return texts.mapInArrow(apply, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def write_vocabulary(counts: DataFrame, folder: str) -> list[tuple[int, int, int, int]]:
    """Sorted pieces of the vocabulary as files; of each its number, first hash, words and tokens."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        hashes, counts = table.column("hash").to_numpy(), table.column("n").to_numpy()
        before = np.cumsum(counts) - counts
        piece = TaskContext.get().partitionId()
        SharedFolder(folder).write(f"words-{piece}", to_bytes({"hashes": hashes.astype("<i8"), "counts": counts.astype("<i8"), "before": before.astype("<i8")}))
        yield pa.RecordBatch.from_pydict({"piece": [piece], "first": [int(hashes[0])], "words": [len(hashes)], "tokens": [int(counts.sum())]})

    found = stored(counts.orderBy("hash").mapInArrow(apply, "piece long, first long, words long, tokens long"), "lm-pieces")
    return [tuple(r) for r in found.orderBy("first").collect()]


def _by_piece(piece: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each piece with the wanted rows that it holds."""
    rows = np.flatnonzero(wanted)
    rows = rows[np.argsort(piece[rows].astype(np.uint32), kind="stable")]
    held = piece[rows]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(rows) else []
    for part in np.split(rows, starts[1:]) if len(rows) else []:
        yield int(piece[part[0]]), part


class Vocabulary:
    """Level 1, mapped. A word's id is its place among all sorted hashes; the id after the last is the start of a text."""

    def __init__(self, folder: str, pieces: tuple, training_texts: int):
        self.pieces = [from_buffer(SharedFolder(folder).map(f"words-{p[0]}")) for p in pieces]
        self.firsts = np.array([p[1] for p in pieces], np.int64)
        self.starts = np.cumsum([0, *[p[2] for p in pieces]])
        self.tokens = np.cumsum([0, *[p[3] for p in pieces]])
        self.size, self.total, self.training_texts = int(self.starts[-1]), int(self.tokens[-1]), training_texts
        self.floor = self.total + ADDED * (self.size + 1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes; -1 for words that training has not seen."""
        out = np.full(len(hashes), -1, np.int64)
        piece = np.searchsorted(self.firsts, hashes, side="right") - 1
        for p, rows in _by_piece(piece, piece >= 0):
            known = self.pieces[p]["hashes"]
            at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
            hit = known[at] == hashes[rows]
            out[rows[hit]] = self.starts[p] + at[hit]
        return out

    def _of(self, ids: np.ndarray, column: str) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        piece = np.searchsorted(self.starts, ids, side="right") - 1
        for p, rows in _by_piece(piece, (ids >= 0) & (ids < self.size)):
            out[rows] = self.pieces[p][column][ids[rows] - self.starts[p]] + (self.tokens[p] if column == "before" else 0)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Tokens with these ids, 0 for -1; for the start, the training texts."""
        return np.where(ids == self.size, self.training_texts, self._of(ids, "counts"))

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Tokens with smaller ids."""
        return np.where(ids == self.size, self.total, self._of(ids, "before"))

    def log_unigram(self, ids: np.ndarray) -> np.ndarray:
        return np.log10((self._of(ids, "counts") + ADDED) / self.floor)

    def context_at(self, place: int) -> int:
        """The context whose pairs hold this place in the order of (context, word)."""
        if place >= self.total:
            return self.size
        p = int(np.searchsorted(self.tokens, place, side="right")) - 1
        return int(self.starts[p]) + int(np.searchsorted(self.pieces[p]["before"], place - self.tokens[p], side="right")) - 1


@cache
def vocabulary(folder: str, pieces: tuple, training_texts: int) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(folder, pieces, training_texts)


# --- Level 2 ----------------------------------------------------------------------


def build_block(keys: np.ndarray, counts: np.ndarray, first: int, words: Vocabulary, prior: float) -> bytes:
    """A block of the trie. keys: sorted, (context - first) * V + word; counts: how often training has the pair."""
    contexts, successors = keys // words.size, keys % words.size
    span = int(contexts[-1]) + 1 if len(keys) else 1
    pointers = np.searchsorted(contexts, np.arange(span + 1))
    smoothed = np.log10((counts + prior * 10.0 ** words.log_unigram(successors)) / (words.counts(contexts + first) + prior))
    # 256 even steps: no probability is off by more than a 510th of the range.
    book = np.linspace(smoothed.min(), smoothed.max(), 256) if len(keys) else np.zeros(1)
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, smoothed).astype(np.uint8)
    parts = {"codes": codes, "book": book.astype("<f8"), "first": np.array([first, span], "<i8")}
    parts |= {f"p.{k}": a for k, a in encode(pointers, len(keys) + 1).items()}
    parts |= {f"s.{k}": a for k, a in encode(keys, span * words.size).items()}
    return to_bytes(parts)


class Block:
    """A mapped block of level 2."""

    def __init__(self, buffer):
        parts = from_buffer(buffer)
        self.codes, self.book = parts["codes"], parts["book"]
        self.first, self.span = (int(x) for x in parts["first"])
        self.pointers, self.successors = EliasFano(nested(parts, "p.")), EliasFano(nested(parts, "s."))

    def log_probability(self, keys: np.ndarray, words: Vocabulary, prior: float) -> np.ndarray:
        """log10 p(word | context) for sorted keys."""
        contexts, successors = keys // words.size, keys % words.size
        out = np.log10(prior) + words.log_unigram(successors) - np.log10(words.counts(contexts + self.first) + prior)
        inside = np.flatnonzero(contexts < self.span)
        if len(inside) and len(self.codes):
            asked, at = np.unique(contexts[inside], return_inverse=True)
            start = self.pointers.access(asked).astype(np.int64)[at]
            end = self.pointers.access(asked + 1).astype(np.int64)[at]
            found = self.successors.find(keys[inside].astype(np.uint64), start, end)
            out[inside[found >= 0]] = self.book[self.codes[found[found >= 0]]]
        return out


# --- Counting and answering in one shuffle ------------------------------------------


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Values in as many bytes as the largest needs."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(width: int, data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :width] = short
    return wide.view("<u8").ravel().astype(np.int64)


_SENT = "block long, batch long, width int, keys binary, count_width int, counts binary, owners binary, doc_id array<long>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, rest array<double>"


def _batch(rows: list[tuple], batch: int, words: Vocabulary, block_pairs: int, prior: float) -> pa.RecordBatch:
    """Rows for the blocks and one row (with a block of its own, below 0) of what is known of the texts themselves, with the place of each token's pair."""
    ids_of, hashes, held = [r[0] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows], bool)
    lengths = np.array([len(h) for h in hashes])
    values, at = np.unique(np.concatenate(hashes).view(np.int64), return_inverse=True)
    ids = words.ids(values)[at]
    owner = np.repeat(np.arange(len(rows)), lengths)
    base = words.log_unigram(ids)
    first = np.cumsum(lengths) - lengths
    contexts = np.append(-1, ids[:-1])
    contexts[first] = words.size
    routed = (ids >= 0) & (contexts >= 0)
    # After an unknown word p(w); an unknown word after a known one from the same formula.
    rest = np.where(contexts < 0, base, np.log10(prior) + base - np.log10(words.counts(np.maximum(contexts, 0)) + prior))
    rest[routed] = 0
    sums = lambda weights: np.bincount(owner, weights, len(rows))
    contexts, successors, owner_routed = contexts[routed], ids[routed], owner[routed]
    learn = ~held[owner_routed]
    pairs, at = np.unique(contexts * max(words.size, 1) + successors, return_inverse=True)
    counts = np.bincount(at, learn, len(pairs)).astype(np.int64)
    contexts, successors = pairs // max(words.size, 1), pairs % max(words.size, 1)
    place = words.before(contexts) + (words.counts(contexts) * (successors / max(words.size, 1))).astype(np.int64)
    # Places rise with the pairs, so the blocks of sorted pairs are sorted.
    block = place // block_pairs
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.array([], int)
    out: list[list] = [[] for _ in range(13)]

    def add(*row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=False):
        number = int(block[a])
        keys = (contexts[a:b] - words.context_at(number * block_pairs)) * words.size + successors[a:b]
        add(number, batch, *_narrow(keys), *_narrow(counts[a:b]), *[None] * 7)
    known = sums((ids >= 0).astype(float)).astype(np.int64)
    routed_tokens = np.bincount(owner_routed, minlength=len(rows)).astype("<u4").tobytes()
    add(-1 - batch, batch, *_narrow(at), None, None, routed_tokens, ids_of, held.tolist(), lengths.tolist(), known.tolist(), sums(base).tolist(), sums(rest).tolist())
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [part.split()[0] for part in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)


def _deal(texts: DataFrame, load, block_pairs: int, prior: float) -> DataFrame:
    """texts: doc_id, held_out, text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes, rows, total, sent = load(), WordHashes(), [], 0, 0
        # Batches are numbered apart by task: up to 2^24 of each.
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc_id, held, token_hashes(text, hashes)))
                total += len(rows[-1][2])
                if total >= BATCH_TOKENS:
                    yield _batch(rows, number + sent, words, block_pairs, prior)
                    rows, total, sent = [], 0, sent + 1
        if rows:
            yield _batch(rows, number + sent, words, block_pairs, prior)

    return texts.mapInArrow(apply, _SENT)


_ANSWERED = "batch long, block long, score binary, width int, keys binary, owners binary, doc_id array<long>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, rest array<double>"
_TEXT_COLUMNS = ["width", "keys", "owners", "doc_id", "held", "tokens", "known", "base", "rest"]


def _answer(load, folder: str, block_pairs: int, prior: float):
    """The task of a block: count, build, write, map, and answer per batch and distinct pair."""

    def apply(table: pa.Table) -> pa.Table:
        names = [part.split()[0] for part in _ANSWERED.split(", ")]
        block = table.column("block")[0].as_py()
        if block < 0:
            return pa.table([table.column("batch"), table.column("block"), pa.nulls(table.num_rows, pa.binary()), *[table.column(c) for c in _TEXT_COLUMNS]], names=names)
        words = load()
        both = lambda width, data: [_widen(w, d) for w, d in zip(table.column(width).to_pylist(), table.column(data).to_pylist(), strict=True)]
        sent, counts = both("width", "keys"), both("count_width", "counts")
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        seen = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
        name, files = f"pairs-{block}", SharedFolder(folder)
        files.write(name, build_block(keys[seen > 0], seen[seen > 0], words.context_at(block * block_pairs), words, prior))
        value = Block(files.map(name)).log_probability(keys, words, prior)[at]
        ends = np.cumsum([len(s) for s in sent])
        scores = [value[end - len(s) : end].astype("<f8").tobytes() for end, s in zip(ends.tolist(), sent, strict=True)]
        texts = [pa.nulls(table.num_rows, table.schema.field(c).type) for c in _TEXT_COLUMNS]
        return pa.table([table.column("batch"), table.column("block"), pa.array(scores, pa.binary()), *texts], names=names)

    return apply


def _assemble(table: pa.Table) -> pa.Table:
    """The texts of one batch with the sums over their tokens, in the order of the text whatever the shuffle did."""
    blocks = table.column("block").to_numpy()
    own = int(np.flatnonzero(blocks < 0)[0])
    texts = {c: table.column(c)[own].as_py() for c in _TEXT_COLUMNS}
    answers = table.column("score")
    value = np.concatenate([np.zeros(0), *[np.frombuffer(answers[int(k)].as_py(), "<f8") for k in np.argsort(blocks) if blocks[k] >= 0]])
    owner = np.repeat(np.arange(len(texts["rest"])), np.frombuffer(texts["owners"], "<u4"))
    score = np.array(texts["rest"], float) + np.bincount(owner, value[_widen(texts["width"], texts["keys"])], len(texts["rest"]))
    columns = [texts["doc_id"], texts["held"], texts["tokens"], texts["known"], texts["base"], score.tolist()]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_rest(doc_id, 10) == 0, F.lit(False))


def score(docs: DataFrame, prior: float = PRIOR, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learnt from the rows that are not held out; its levels stay in `folder`.
    """
    folder = folder or scratch_dir(docs.sparkSession, "lm")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = texts.where(~F.col("held_out"))
    pieces = tuple(write_vocabulary(count_words(training.select("text")), folder))
    n_texts, total = training.select(F.count(F.lit(1))).first()[0], sum(p[3] for p in pieces)
    block_pairs = max(1, min(BLOCK_PAIRS, -(-(total + n_texts) // MIN_BLOCKS)))

    def load() -> Vocabulary:
        return vocabulary(folder, pieces, n_texts)

    sized(texts, 8 * (total + n_texts))
    sent = _deal(texts, load, block_pairs, prior)
    answered = sent.groupBy("block").applyInArrow(_answer(load, folder, block_pairs, prior), _ANSWERED)
    scored = answered.groupBy("batch").applyInArrow(_assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
