"""Decontamination against benchmarks of many items."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.conftest import frame, rows_of
from tests.llm.test_texts import _edited
from voxledger.llm import decontamination


def _benchmark(rnd, count, words=20_000):
    return [(i, " ".join(f"w{rnd.randrange(words)}" for _ in range(rnd.randint(14, 59)))) for i in range(count)]


def _numbers(block, text):
    return np.array([block.vocabulary.get(w, 0) for w in decontamination.tokens(text)], dtype=np.uint64)


def test_memory_of_many_items():
    """What a task holds of an item is its words and pieces, not every walk over it: 10 kB at most."""
    items = _benchmark(random.Random(3), 1500)
    tracemalloc.start()
    block = decontamination.Items(items)
    decontamination.Segments(block)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1500 * 10_000


def test_items_are_prepared_once(monkeypatch):
    """A Python worker that runs several tasks prepares a block for the first of them only."""
    items = _benchmark(random.Random(4), 50)
    shared, made = SimpleNamespace(value=decontamination.Items(items)), []
    monkeypatch.setattr(decontamination, "Segments", lambda block, make=decontamination.Segments: made.append(block) or make(block))
    for _ in range(3):
        batch = pa.record_batch({"id": [1, 2], "text_hash": [5, 6], "text": [f"a b {items[7][1]} c", "nothing here"]})
        got = [r for b in decontamination._search(shared, False)(iter([batch])) for r in b.to_pylist()]
        assert [(r["doc_id"], r["text_hash"], r["item_id"], r["start_word"], r["distance"]) for r in got] == [(1, 5, 7, 2, 0)]
    assert len(made) == 1


def test_many_items_in_one_text():
    """A text that is the benchmark itself, edited, among others; found where the exact search finds them."""
    rnd = random.Random(5)
    items = _benchmark(rnd, 300)
    block = decontamination.Items(items)
    edited = [" ".join(_edited(rnd, t.split(), int(0.1 * len(t.split())))) for _, t in items]
    texts = [_numbers(block, t) for t in ["x y z", " q ".join(edited), "", edited[5], " ".join(edited[6].split()[:7])]]
    exact = list(block.matches(texts))
    got = list(decontamination.Segments(block).matches(texts))
    assert {x[:2] for x in exact} == {(1, k) for k in range(300)} | {(3, 5)}
    assert len(set(got) & set(exact)) >= 0.98 * len(exact) and {x[:2] for x in got} <= {x[:2] for x in exact}


def test_blocks_by_bytes(spark, monkeypatch):
    """Long items make blocks of their own; rows of items of equal words are as many as the items."""
    rnd = random.Random(6)
    items = _benchmark(rnd, 40)
    items += [(1000 + i, t) for i, t in items[:5]] + [(None, items[0][1])]
    rows = [(i, f"before {t} after") for i, t in items[:10]] + [(99, None), (None, items[20][1].upper())]
    docs, query = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole = rows_of(decontamination.leaks(docs, query))
    assert len(whole) == 11 + 5 + 1
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontamination, "ROWS_AT_ONCE", 2)
    blocks = []
    prepare = decontamination.Items.__init__
    monkeypatch.setattr(decontamination.Items, "__init__", lambda self, rows: blocks.append(len(rows)) or prepare(self, rows))
    assert rows_of(decontamination.leaks(docs, query)) == whole
    assert len(blocks) > 3 and sum(blocks) == len(items)


def test_stage_with_many_items(spark, tmp_path):
    """The pipeline's stage reads the documents once for 12,000 items, and drops those that hold one."""
    rnd = random.Random(7)
    items = _benchmark(rnd, 12_000)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, items[5][1]), (2, "nothing here"), (2, f"one {items[11_999][1]} two"), (None, items[7000][1]), (3, None), (None, "")]
    left = corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path))
    assert rows_of(left.select("doc_id", "text")) == sorted([(2, "nothing here"), (3, None), (None, "")], key=repr)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
