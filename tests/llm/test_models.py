"""Near copies and the language model against brute force; classifiers on what they must catch."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import elias_fano, language_model, ngram_join, quality_classifier, toxicity
from runloom.llm.components import components


# --- components -----------------------------------------------------------------


def union(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(llm):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]] + [(60, 0), (5, 5)]
    got = {r.node: r.component for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union([e for e in edges if e[0] != e[1]])
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join ----------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    edges = []
    for k, (i, a) in enumerate(sets):
        edges.append((k, k))
        for m in range(k):
            b = sets[m][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                edges.append((k, m))
    root = union(edges)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[root[k]].append(i)
    smallest = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted((str(i), len(s), str(smallest[root[k]])) for k, (i, s) in enumerate(sets))


def corpus(seed):
    draw = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(60))
    rows, number = [], 0
    for _ in range(40):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 5, 8, 30, 120, 400]))]
        for _ in range(draw.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(draw.randrange(0, 1 + len(own) // 25)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9000)}"
            text = " ".join(own)
            rows.append((number, text.upper() if draw.random() < 0.1 else text, "s"))
            number += 1
        rows.append((number, passage + " " + " ".join(f"u{number}x{i}" for i in range(draw.choice([5, 15, 60]))), "s"))
        number += 1
    chain = [f"c{i}" for i in range(100)]
    for k in range(0, 60, 6):  # each links with its neighbours only
        rows.append((1000 - k, " ".join(chain[k:] + [f"d{i}" for i in range(k)]), "s"))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "  \n", "s"), (2003, "a b", "s"), (2004, "A  b", "s"), (2005, "a b c", "s"), (None, "a b", "s"), (None, "no id here", "s"), (3, rows[3][1], "s")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups(documents, seed):
    rows = corpus(seed)
    got = ngram_join.near_groups(documents(rows, clash=seed == 2)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == groups(rows)


def test_exhaustive_tiles_alone_find_all(documents, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", 50)
    docs = documents(rows)
    sets = ngram_join.candidates(docs, 20_000)
    found = [{(bytes(r.node), bytes(r.component)) for r in ngram_join.linked_classes(sets, star_rounds=n).collect()} for n in (0, 1, 2)]
    assert found[0] == found[1] == found[2] and found[0]


def test_a_large_group_of_near_copies(documents):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(400):
        own = list(words)
        own[draw.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = ngram_join.near_groups(documents(rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_signature_bounds_the_overlap():
    draw = np.random.default_rng(0)
    for n in (5, 300, 3000):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], draw.integers(0, 2**63, n).astype(np.uint64)]))
        differ = int(np.bitwise_count(ngram_join.signature(a) ^ ngram_join.signature(b)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def test_keep_one(documents):
    rows = corpus(4)
    docs = documents(rows, clash=True)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {i for i, _, c in groups(rows) if i == c}
    assert {str(i) for i in ids} == want and sum(i == 3 for i in ids) <= 1
    assert ngram_join.keep_one(documents([])).count() == 0


# --- language model -------------------------------------------------------------


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (6, 9), (900, 3000), (4000, 10**11), (3000, 70)])
def test_elias_fano(n, universe):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, universe, n)).astype(np.uint64)
    made = elias_fano.EliasFano(elias_fano.from_buffer(elias_fano.to_bytes(elias_fano.encode(values, universe))))
    assert n == 0 or (made.access(np.arange(n)) == values).all()
    values = np.unique(values)
    if len(values):
        made = elias_fano.EliasFano(elias_fano.encode(values, universe))
        asked = np.unique(np.concatenate([values, draw.integers(0, universe, 300).astype(np.uint64)]))
        start, end = np.full(len(asked), len(values) // 3), np.full(len(asked), len(values) - len(values) // 4)
        place = {int(v): i for i, v in enumerate(values)}
        want = [place.get(int(v), -1) for v in asked]
        assert made.find(asked, start, end).tolist() == [p if len(values) // 3 <= p < end[0] else -1 for p in want]


def test_a_frequent_context_is_searched_by_halves(monkeypatch):
    # One context with very many successors beside very many rare ones: all its values fall into few buckets.
    values = np.concatenate([np.arange(40_000) * 3, (np.arange(1, 40_000) << 24)]).astype(np.uint64)
    made, asked = elias_fano.EliasFano(elias_fano.encode(values, 1 << 40)), []
    low = made.low
    monkeypatch.setattr(made, "low", lambda at: asked.append(len(at)) or low(at))
    n = np.full(len(values), len(values), np.int64)
    assert (made.find(values, np.zeros_like(n), n) == np.arange(len(values))).all()
    missing = made.find(values + np.uint64(1), np.zeros_like(n), n)
    assert (missing == -1).all()
    assert sum(asked) <= 2 * len(values) * 18



def expected(rows, prior):
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in texts:
        if not held(i):
            words.update(w)
            met = list(zip(["<s>", *w[:-1]], w, strict=True))
            pairs.update(met)
            contexts.update(c for c, _ in met)
    total, size = sum(words.values()), len(words)
    p = lambda w: (words[w] + 0.1) / (total + 0.1 * (size + 1))
    for i, w in texts:
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pairs[c, x] + prior * p(x)) / (contexts[c] + prior)) for c, x in zip(["<s>", *w[:-1]], w, strict=True))
        yield str(i), held(i), len(w), sum(words[x] > 0 for x in w), total, round(base, 6), score


@pytest.mark.parametrize("clash", [False, True])
def test_language_model(documents, monkeypatch, clash):
    draw = random.Random(6)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % 60}" for _ in range(draw.randrange(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "w1 W2"), (902, "w1 w2"), (902, "w1 w2"), (903, "hot " * 5000)]
    got = language_model.score(documents(rows, clash)).collect()
    key = lambda r: (r[0], r[2], round(r[6], 1))
    ours = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got), key=key)
    want = sorted(expected(rows, language_model.PRIOR), key=key)
    assert [o[:5] for o in ours] == [w[:5] for w in want]
    for o, w in zip(ours, want, strict=True):
        assert o[5] == pytest.approx(w[5], abs=1e-5)
        assert o[6] == pytest.approx(w[6], abs=0.02 * w[2])


def test_a_frequent_pair_is_sent_once_per_batch(documents, tmp_path):
    docs = documents([(i, "hot " * 3000 + f"w{i}") for i in range(20)]).withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text").coalesce(1)
    pieces = tuple(language_model.write_vocabulary(language_model.count_words(docs.select("text")), str(tmp_path)))
    sent = language_model._deal(docs, lambda: language_model.Vocabulary(str(tmp_path), pieces, 20), 1000, 50.0).where("block >= 0").collect()
    assert len({r.batch for r in sent}) == 1
    # <s> hot, hot hot, and of each text hot w and w </s>.
    assert sum(len(r["keys"]) // r.width for r in sent) == 42
    assert sum(int(language_model._widen(r.count_width, r.counts).sum()) for r in sent) == 20 * 3002


def test_language_model_without_training(documents):
    assert language_model.score(documents([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = language_model.score(documents([(held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


# --- classifiers ----------------------------------------------------------------


def test_factorization_machine_learns_pairs():
    """Neither term alone is toxic, both together are."""
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        a, b = draw.random(2) < 0.4
        rows.append((np.array(sorted({1} if a else set()) + ([2] if b else []) + [int(draw.integers(10, 200))]), None))
        labels.append(float(a and b))
    model = toxicity.learn(np.array(labels), [(a.astype(np.int64), np.ones(len(a))) for a, _ in rows])
    vectors, known = model["vectors"].reshape(-1, toxicity.FACTORS), model["known"].tolist()
    one, two = known.index(1), known.index(2)
    margin = lambda *r: model["bias"][0] + model["weights"][list(r)].sum() + (vectors[one] @ vectors[two] if len(r) == 2 else 0)
    assert margin(one, two) > 0 > max(margin(one), margin(two))


def test_factorization_machine_keeps_a_neutral_term_that_matters_in_a_pair():
    """Term 2 has the base rate by itself; beside term 1 it is always toxic, elsewhere never."""
    draw = np.random.default_rng(2)
    examples, labels = [], []
    for k in range(6000):
        one, two, other = k % 10 == 0, k // 10 % 10 == 0, k // 100 % 10 == 0
        examples.append((np.array([1] * one + [2] * two + [int(draw.integers(10, 200))], np.int64), np.ones(1 + one + two)))
        labels.append(float(one if two else other))
    y = np.array(labels)
    assert y[[2 in a for a, _ in examples]].mean() == pytest.approx(y.mean())
    model = toxicity.learn(y, examples)
    known = model["known"].tolist()
    assert {1, 2} <= set(known)
    one, two = known.index(1), known.index(2)
    vectors = model["vectors"].reshape(-1, toxicity.FACTORS)
    margin = lambda *r: model["bias"][0] + model["weights"][list(r)].sum() + (vectors[one] @ vectors[two] if len(r) == 2 else 0)
    assert margin(one, two) > 0 > max(margin(one), margin(two))


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_held_out_accuracy(llm, module, label):
    sf = "/root/testdata/sf0.1"
    docs, labels = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/labels.parquet")
    got = module.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    right = sum(r["predicted"] == r[label] for r in got) / len(got)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifier_edges(llm, documents, module, label):
    rows = [(i, f"good words number {i}" if i % 3 else f"bad awful number {i}") for i in range(60)] + [(90, None), (91, ""), (None, "x"), (92, "y " * 30_000), (5, "good words number 5")]
    kinds = "doc_id long, quality int, toxic int, score string"
    labels = llm.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0), "") for i in range(60)] + [(None, 1, 1, ""), (70, None, None, ""), (1, 1, 0, "")], kinds)
    got = module.score(documents(rows, clash=True), labels).collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert {str(r.doc_id): r.held_out for r in got}["None"] is False
    for some in (labels.where("false"), labels.where("doc_id = 1")):
        assert module.score(documents(rows), some).count() == len(rows)
    assert module.score(documents([]), labels).count() == 0


# --- plain loops beside the vectorised ones ---------------------------------------


def plain_machine(y, rows, size, epochs):
    """A factorization machine, pair by pair and number by number, in the same order of examples."""
    import math

    draw, k = np.random.default_rng(3), toxicity.FACTORS
    w, v = [0.0] * size, draw.normal(0, 0.05, (size, k)).tolist()
    rate = min(max(sum(y) / len(y), 0.01), 0.99)
    bias, n, n_v, n_b = math.log(rate / (1 - rate)), [1.0] * size, [[1.0] * k for _ in range(size)], 1.0
    for _ in range(epochs):
        for e in draw.permutation(len(rows)):
            terms = rows[e]
            margin = bias + sum(w[i] for i in terms)
            margin += sum(sum(v[i][f] * v[j][f] for f in range(k)) for x, i in enumerate(terms) for j in terms[x + 1 :])
            error = 1 / (1 + math.exp(-margin)) - y[e]
            n_b += error * error
            bias -= toxicity.BIAS_RATE * error / math.sqrt(n_b)
            total = [sum(v[i][f] for i in terms) for f in range(k)]
            steps = {i: [error * (total[f] - v[i][f]) + toxicity.DECAY * v[i][f] for f in range(k)] for i in terms}
            for i in terms:
                g = error + toxicity.DECAY * w[i]
                n[i] += g * g
                w[i] -= toxicity.RATE * g / math.sqrt(n[i])
                for f, g in enumerate(steps[i]):
                    n_v[i][f] += g * g
                    v[i][f] -= toxicity.RATE * g / math.sqrt(n_v[i][f])
    return w, v, bias


def test_factorization_machine_equals_a_plain_one():
    draw = random.Random(8)
    names = [f"t{k}" for k in range(12)]
    texts = [" ".join(draw.sample(names, draw.randint(1, 6))) for _ in range(150)]
    y = np.array([float("t0" in t.split() and "t1" in t.split()) if draw.random() < 0.95 else 1.0 for t in texts])
    of = toxicity.Terms()
    examples = [of(t) for t in texts]
    model = toxicity.learn(y, examples)
    at = {int(term): k for k, term in enumerate(model["known"])}
    assert at
    rows = [[at[int(term)] for term in a if int(term) in at] for a, _ in examples]
    w, v, bias = plain_machine(y.tolist(), rows, len(at), toxicity.EPOCHS)
    assert np.allclose(model["weights"], w, atol=1e-9) and np.allclose(model["vectors"], np.ravel(v), atol=1e-9)
    assert model["bias"][0] == pytest.approx(bias, abs=1e-9)
    judge = toxicity.judge(model)
    for text, terms in zip(texts[:20], rows, strict=False):
        margin = bias + sum(w[i] for i in terms) + sum(sum(p * q for p, q in zip(v[i], v[j], strict=True)) for x, i in enumerate(terms) for j in terms[x + 1 :])
        assert judge(text) == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_quality_model_equals_a_plain_follow_the_leader_loop():
    import math

    draw = random.Random(9)
    good, bad = [f"good{k}" for k in range(8)], [f"bad{k}" for k in range(8)]
    texts = [" ".join(draw.choices(good if k % 2 else bad, k=draw.randint(1, 9))) for k in range(120)]
    y = np.array([float(k % 2) for k in range(120)])
    of = quality_classifier.Features()
    examples = [of(t) for t in texts]
    model = quality_classifier.learn(y, examples)
    often = {}
    for a, _ in examples:
        for term in a.tolist():
            often[term] = often.get(term, 0) + 1
    rows = [{**{t: x for t, x in zip(a.tolist(), v.tolist(), strict=True) if often[t] >= quality_classifier.MIN_DOCUMENTS}, "bias": 1.0} for a, v in examples]
    z, n = {}, {}

    def weight(t):
        if abs(z.get(t, 0.0)) <= quality_classifier.L1:
            return 0.0
        shrunk = z[t] - math.copysign(quality_classifier.L1, z[t])
        return -shrunk / ((quality_classifier.BETA + math.sqrt(n[t])) / quality_classifier.ALPHA + quality_classifier.L2)

    order = np.random.default_rng(3)
    for _ in range(quality_classifier.EPOCHS):
        for e in order.permutation(len(rows)):
            now = {t: weight(t) for t in rows[e]}
            error = 1 / (1 + math.exp(-sum(now[t] * x for t, x in rows[e].items()))) - y[e]
            for t, x in rows[e].items():
                g, before = error * x, n.get(t, 0.0)
                z[t] = z.get(t, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality_classifier.ALPHA * now[t]
                n[t] = before + g * g
    plain = {t: weight(t) for t in z}
    assert model["bias"][0] == pytest.approx(plain.pop("bias"), abs=1e-9)
    assert dict(zip(model["known"].tolist(), model["weights"].tolist(), strict=True)) == pytest.approx({t: x for t, x in plain.items() if x}, abs=1e-9)
