"""The pipeline against a plain version of its stages, and over odd rows."""

import pytest

import corpus_pipeline as pipe
from tests.llm.conftest import frame, rows_of
from tests.llm.test_duplicates import _close, _fingerprint, _roots
from tests.llm.test_plain import _statistics
from voxledger.llm import decontamination, mixing, quality, simhash

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in pipe.STAGES:
        docs = spark.createDataFrame((d := stage(spark, docs, small)).collect(), d.schema)
        out.append(docs)
    return out


def test_stages(spark, small, documents, steps):
    rules = quality.fit(documents, spark.read.parquet(f"{small}/labels.parquet"))
    plain = [r for r in documents.collect()]
    names = {n for rule in rules for c in rule for n in quality.RATIOS[c.feature]} - set(quality.BASE)
    assert names <= set(quality.COUNTS)

    def good(r):
        s = dict(zip(quality.BASE, _statistics(r.text), strict=True))
        return s["n_words"] >= 50 and 100 * s["n_repeat_words"] <= 50 * s["n_words"]

    kept = {r.doc_id for r in steps[0].collect()}
    judged = {r.doc_id: r.kept for r in quality.judged(documents, rules).collect()}
    assert kept == {r.doc_id for r in plain if good(r) and judged[r.doc_id]} and len(kept) > 0.5 * len(plain)

    rows = sorted((r for r in plain if r.doc_id in kept), key=lambda r: r.doc_id)
    root = _roots(range(len(rows)), _close([_fingerprint(r.text) for r in rows]))
    left = [r for k, r in enumerate(rows) if root[k] == k]
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in left}

    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(r):
        t = " " + " ".join(decontamination.tokens(r.text)) + " "
        return any(f" {' '.join(i)} " in t for i in items)

    clean = [r for r in left if not leaks(r)]
    assert {r.doc_id for r in steps[2].collect()} == {r.doc_id for r in clean}

    copies = {r.doc_id: r.copies for r in mixing.mix_copies(spark.createDataFrame(clean)).collect()}
    mix = rows_of(steps[3].select(*NAMES))
    assert mix == sorted((tuple(r) for r in clean for _ in range(copies[r.doc_id])), key=repr)

    assert rows_of(steps[4].select(*NAMES)) == mix
    places = sorted((r.shard, r.slot) for r in steps[4].collect())
    assert places == sorted((i % 16, i // 16) for i in range(len(mix)))


def test_run(spark, small, steps):
    got = pipe.run(spark, small)
    assert got.columns == [*NAMES, "shard", "slot"]
    assert rows_of(got.select(*NAMES)) == rows_of(steps[4].select(*NAMES))
    assert all(s.columns == NAMES for s in steps[:4])


def test_odd_rows(spark, small):
    text = " ".join(f"w{i} the of" for i in range(40))
    rows = [(1, text, None), (1, text, None), (2, text + " x", "b"), (None, None), (3, ""), (4, "a " * 50_000, "c")]
    for docs in (frame(spark, rows, "_row"), frame(spark, []), frame(spark, [(None, None, None)] * 3, "slot")):
        names = docs.columns
        for k, (_, stage) in enumerate(pipe.STAGES):
            docs = stage(spark, docs, small)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert k == 4 or docs.columns == names
    one = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in one if r.text == text), key=repr) == [1]
