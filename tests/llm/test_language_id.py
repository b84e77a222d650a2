"""Language identification: kernels against plain sets, ridge regression against a direct solution, held-out accuracy."""

import random
import unicodedata

import numpy as np
import pytest

from runloom.llm import language_id
from runloom.llm.common import table
from runloom.llm.queries import QUERIES

SCHEMA = "doc_id long, lang string, text string, key string, n string, first string, at string, score string"
SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung ber ein zu", "cc": "é ou eau que ç"}


def plain_grams(text):
    """The n-grams of a folded text as strings."""
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in letters):
        return set()
    padded = " " + " ".join(letters.split()) + " "
    return {padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1)}


def written(draw, lang, words):
    return " ".join("".join(draw.choices(SYLLABLES[lang].split(), k=draw.randint(1, 4))) for _ in range(words))


def places(text):
    return language_id.spectrum(text, np.zeros(language_id.DIMENSIONS, bool))


@pytest.mark.parametrize("text", ["abc", "a", " a ", "..Ab--cD  e!", "é1ü", "x́y", "日本 語", "İ", "aaaaaaaa", "a\nb\tc" * 3])
def test_spectrum(text):
    assert len(places(text)) == len(plain_grams(text))


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    text = written(random.Random(1), "aa", 3000)
    whole = places(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (places(text) == whole).all()


def test_kernels_and_weights():
    draw = random.Random(2)
    langs = [draw.choice(["aa", "bb", "cc"]) for _ in range(60)]
    texts = [written(draw, lang, draw.randint(2, 12)) for lang in langs]
    model = language_id.solve(langs, [places(t) for t in texts], landmarks=9, ridge=1e-2)
    grams = [plain_grams(t) for t in texts]
    names = sorted(set(langs))
    chosen = [k for name in names for k in [i for i, lang in enumerate(langs) if lang == name][:3]]
    kernel = np.array([[len(a & grams[b]) / np.sqrt(len(a) * len(grams[b])) for b in chosen] for a in grams])
    hashed = language_id.Kernels(model).of([places(t) for t in texts])
    # A few n-grams of different texts share a place.
    assert np.abs(hashed - kernel).max() < 0.03 and np.abs(hashed - kernel).mean() < 1e-3
    kernel = hashed
    weight = np.array([len(langs) / 3 / langs.count(lang) for lang in langs])[:, None]
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    left = kernel.T @ (weight * kernel) + 1e-2 * len(langs) * kernel[chosen]
    margins = kernel @ np.linalg.solve(left, kernel.T @ (weight * target))
    found, scores = language_id.judge(model)(texts)
    assert found == [names[k] for k in margins.argmax(1)]
    assert np.allclose(scores, np.clip((margins.max(1) + 1) / 2, 0, 1), atol=1e-4)


def frame(llm, rows):
    return llm.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def test_edges(llm):
    draw = random.Random(3)
    rows = [(i, lang, written(draw, lang, 30)) for i, lang in enumerate(draw.choices(["aa", "bb", "cc"], [8, 1, 1], k=400))]
    rows += [(1000, None, None), (1001, "aa", ""), (1002, "aa", "12 .. 7"), (1003, None, written(draw, "bb", 40_000)), (None, "cc", written(draw, "cc", 9))]
    rows += [(1004, None, written(draw, "cc", 3))] * 2
    got = language_id.score(frame(llm, rows)).collect()
    assert len(got) == len(rows)
    wanted = {i: lang for i, lang, _ in rows} | {1003: "bb", 1004: "cc"}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == wanted[r.doc_id]


def test_nothing_to_learn(llm):
    assert [tuple(r)[2:] for r in language_id.score(frame(llm, [(1, None, "some words"), (2, "aa", "...")])).collect()] == [("und", 0.0)] * 2
    assert language_id.score(frame(llm, [])).count() == 0


def test_labels_of_the_fold_teach_nothing(llm):
    import zlib

    draw = random.Random(4)
    rows = [(i, "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "wrong", written(draw, "aa", 20)) for i in range(200)]
    assert {r.lang_pred for r in language_id.score(frame(llm, rows)).collect()} == {"aa"}


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op13_language_id"](spark, sf_dir)
    truth = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS wanted")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang_pred == r.wanted for r in rows) >= 0.97 * len(rows) > 0
