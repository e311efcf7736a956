"""Whitening, language model and divergence against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import diff, duck
from tests.llm.conftest import frame, rows_of
from voxledger.llm import divergence, language, queries, whitening

VECTORS = "vec_id long, embedding array<double>, component string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], VECTORS)


def _plain(x):
    """Covariance, eigenvalues and components by numpy."""
    y = x - x.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / len(x))
    return y, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("spread", [1.0, 1e3])
def test_whitening(spark, spread):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 12)) @ np.diag(np.linspace(spread, 1, 12)) / 8
    odd = [(None, c[0]), (7, c[7]), (900, None), (901, []), (902, [float("nan")] * 12), (903, [None] * 12), (904, c[0][:5]), (905, [float("inf")] * 12), (906, [1e300] * 12)]
    df = _vectors(spark, list(enumerate(c)) + odd)
    used = np.concatenate([c, c[[0, 7]]])
    x = np.floor(1024 * used) + 100000
    y, values, vectors = _plain(x)
    got = whitening.component_rows(df).toPandas()
    assert len(got) == 302 * 8 and set(got.n) == {302} and got.identity_error.max() < 1e-9
    first = got[got.vec_id == 5].sort_values("component")
    np.testing.assert_allclose(first.explained, values[:8] / values.sum(), rtol=1e-9)
    np.testing.assert_allclose(np.abs(first.whitened), np.abs(y[5] @ vectors[:, :8] / np.sqrt(values[:8])), rtol=1e-6, atol=1e-9)
    whole = x.astype(int).astype(object)
    assert set(first.deviation) == {int(((302 * whole[5] - whole.sum(0)) ** 2).sum())}
    assert got.vec_id.isna().sum() == 8 and (got.vec_id == 7).sum() == 16


def test_whitening_of_few_dimensions(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(50, 4))
    c[:, 2], c[:, 3] = 1.5, c[:, 0]  # constant, and a copy
    got = whitening.component_rows(_vectors(spark, enumerate(c))).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9
    for rows in ([], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(1, None)]):
        out = whitening.component_rows(_vectors(spark, rows))
        assert out.count() == 0 and "identity_error" in out.columns


def test_deviation_beyond_64_bits():
    x = np.array([[2**40, 5], [0, 5]])
    assert whitening._deviation(x, 2, (2**40, 10)) == [None, None]
    assert whitening._deviation(x // 2**20, 2, (2**20, 0)) == [2**40, 2**40]


def _tokens(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def _held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def test_language_base_scores(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    rows += [(None, "Some words"), (5000, None), (5001, ""), (5002, "Ünknown \xa0 WORD " * 3), (rows[0][0], rows[0][1])]
    got = language.document_scores(frame(spark, rows, "word")).collect()
    train = Counter(t for i, text in rows if not _held(i) for t in _tokens(text))
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, text in rows:
        own = _tokens(text)
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        want.append((i, _held(i), len(own), sum(train[t] > 0 for t in own), total, round(base, 5)))
    assert sorted([(*r[:5], round(r.base_score, 5)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_beats_counts_and_is_normalised(spark, documents):
    model = language.learn(documents.where(~language.held_out()))
    got = [r for r in language.scored(documents, model).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)
    vocab, p = model.vocabulary, model.parameters
    context = [5, 9, 2, 3][: language.CONTEXT]
    chances = [10 ** p.log10_classes(np.array([*context, k]))[0] for k in range(1, vocab.size)]
    assert sum(chances) == pytest.approx(1, abs=1e-5)
    counts = {r["word"]: r["n"] for r in model.counts.collect() if r["word"]}
    of = vocab.classifier()
    sums, words = Counter(), Counter()
    for word, n in counts.items():
        k = of([word.encode()])[0]
        sums[k] += n
        words[k] += 1
    assert all((vocab.class_tokens[k], vocab.class_words[k]) == (sums[k], words[k]) for k in range(2, vocab.size))
    # the score is the class's probability times the word's share of it
    text, tokens = "the and zzzq onre", [language.START] * language.CONTEXT
    tokens += [of([w.encode()])[0] for w in text.split()] + [language.END]
    want = p.log10_classes(np.array(tokens)).sum()
    for word, k in zip(text.split(), tokens[language.CONTEXT :]):
        if k >= 2 + len(vocab.own):
            want += math.log10((counts.get(word, 0) + 0.1) / (sums[k] + 0.1 * (words[k] + 1)))
    one = language.scored(frame(spark, [(1, text)]), model).first()
    assert one.score == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("spread", [1, 6])
def test_normaliser_equals_the_direct_sum(spread):
    """Also where tables lose their digits: probabilities of 1e-120 and less."""
    draw, n = np.random.default_rng(4), 40
    arrays = draw.normal(0, 0.6 * spread, (n, language.SIZE)), draw.normal(0, 0.6, (n, language.SIZE)), draw.normal(0, 0.25, (language.CONTEXT, language.SIZE, language.SIZE)), draw.normal(0, 2, (n, 1))
    p = language.Parameters(*[a.astype(np.float32) for a in arrays])
    tokens = draw.integers(0, n, 3000)
    want = p.log10_classes(tokens)
    np.testing.assert_allclose(language.Normaliser(p).log10_classes(tokens), want, atol=1e-4)
    assert (want[tokens[language.CONTEXT :] == language.START] == 0).all()


def test_language_of_odd_tables(spark):
    assert language.document_scores(frame(spark, [])).count() == 0
    only_held = [(i, "a b c") for i in range(200) if _held(i)]
    got = language.document_scores(frame(spark, only_held)).collect()
    assert len(got) == len(only_held) and {(r.train_tokens, r.n_known) for r in got} == {(0, 0)} and all(math.isfinite(r.score) for r in got)
    long = language.document_scores(frame(spark, [(1, "some text here"), (2, "word by word " * 120_000), (3, "x" * 3_000_000)])).collect()
    assert {r.doc_id: r.n_tokens for r in long} == {1: 4, 2: 360_001, 3: 2}


def _divergences(rows, min_docs=3, top=200):
    """By definition, with whole numbers; rows are (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(divergence.TERM, "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        inside = Counter(t for _, _, terms in here for t in set(terms))
        kept = sorted(t for t, n in inside.items() if n >= min_docs)
        count = {s: Counter(t for _, source, terms in here if source == s for t in terms) for s in {d[1] for d in here}}
        every = Counter(t for _, _, terms in here for t in terms)

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in count:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return out


def _texts(spark, rows):
    return spark.createDataFrame([(i, *r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long")


def test_divergence(spark, monkeypatch):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for i in range(150):
        words = [rnd.choice(vocabulary[: 20 + rnd.randrange(40)]) for _ in range(rnd.randrange(40))]
        text = " ".join(rnd.choice([w, w.upper(), f"({w},", f"{w}-{rnd.choice(vocabulary)}", f"{w}{rnd.randrange(9)}"]) for w in words)
        rows.append((text, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b\0c", "\\d", None, "é"])))
    rows += [(None, "en", "a"), ("", "xx", "only"), ("123 !!", "xx", "b"), (None, None, None), ("Ünï ünï\xa0x ÜNÏ", "yy", "a")] + [rows[0]] * 3
    rows += [("twice twice,(twice)", "zz", "a"), ("twice", "zz", "b"), ("once rare", "zz", "b"), ("rare. twice!", "zz", "c"), ("x " * 200_000, "zz", "c")]
    want = sorted(_divergences(rows), key=repr)
    assert rows_of(divergence.divergence(_texts(spark, rows))) == want
    monkeypatch.setattr(divergence, "TILE", 2)
    assert rows_of(divergence.divergence(_texts(spark, rows).repartition(7), top_terms=3)) == sorted(_divergences(rows, top=3), key=repr)
    assert divergence.divergence(_texts(spark, [])).count() == 0


def test_divergence_passes_on_early(spark, monkeypatch):
    """Chunks that a task passes on before its end are counted as one that holds them all."""
    rows = [(f"common {chr(97 + i % 26)}{chr(97 + i // 26)} both{chr(97 + i % 5)}", "en", f"s{i % 3}") for i in range(80)]
    monkeypatch.setattr(divergence, "HELD", 8)
    assert rows_of(divergence.divergence(_texts(spark, rows).coalesce(1))) == sorted(_divergences(rows), key=repr)


def test_divergence_agrees_with_sql(spark, small):
    assert diff(spark, duck(small), queries.QUERIES["op13_divergence"], queries.SQL["op13_divergence"], small) is None


def test_language_holds_few_words(spark, documents, monkeypatch):
    """Words that the driver does not hold are joined: the scores stay."""
    some = documents.limit(40)
    model = language.learn(some)
    want = {r.doc_id: (r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in language.scored(some, model).collect()}
    for most in (0, 100):
        monkeypatch.setattr(language, "FREQUENT", most)
        vocab = language.vocabulary(model.counts)
        assert len(vocab.counts) <= max(most, language.OWN_WORDS) and vocab.class_words == model.vocabulary.class_words
        fewer = language.Model(vocab, model.parameters, model.counts)
        got = {r.doc_id: (r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in language.scored(some, fewer).collect()}
        assert all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)
