"""Sharding, mixing, quality rules: laws, SQL, brute force and odd rows."""

import collections
import re
import zlib

import pytest

from tests.compare import diff, duck
from tests.llm.conftest import frame, rows_of
from voxledger.llm import mixing, quality, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, small, name):
    assert diff(spark, duck(small), queries.QUERIES[name], queries.SQL[name], small) is None


def test_shards_are_even_and_gapless(spark, documents):
    got = sharding.document_shards(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shards_are_shuffled_and_repeat(spark):
    d = frame(spark, [(i, "t") for i in range(2000)])
    a, b = (rows_of(sharding.shard_rows(d, 4).select("doc_id", "shard", "slot")) for _ in range(2))
    assert a == b
    order = [i for i, s, _ in sorted(a, key=lambda r: (r[1], r[2])) if s == 0]
    assert order != sorted(order) and abs(sum(order) / len(order) - 999.5) < 150
    other = rows_of(sharding.shard_rows(d, 4, seed=5).select("doc_id", "shard", "slot"))
    assert other != a


def test_shards_of_odd_rows(spark):
    rows = [(1, "same")] * 5000 + [(None, None), (None, ""), (7, "x" * 300_000)]
    got = sharding.shard_rows(frame(spark, rows, "shard"), 3, bucket_bytes=10_000).collect()
    assert len(got) == len(rows) and got[0].__fields__.count("shard") == 1
    places = sorted((r.shard, r.slot) for r in got)
    assert places == sorted((i % 3, i // 3) for i in range(len(rows)))
    assert sharding.shard_rows(frame(spark, []), 3).count() == 0
    assert sharding.document_shards(frame(spark, [(1, None)])).first()["size"] == 1


def test_whole_documents_are_sharded(spark, documents, tmp_path, monkeypatch):
    """The digest is that of rows written with their texts, a text in many rows included."""
    monkeypatch.setattr(sharding, "scratch", lambda spark: str(tmp_path / "shards"))
    odd = frame(spark, [(100_000 + i, "hot " * 3000) for i in range(300)] + [(200_000, None), (200_001, "")])
    docs = documents.union(odd)
    got = {r.doc_id: r for r in sharding.document_shards(docs).collect()}
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert rows_of(written.select(docs.columns)) == rows_of(docs)
    for r in written.collect():
        raw, d = (r.text or "").encode(), got[r.doc_id]
        assert (d.size, d.text_crc32, d.shard, d.slot) == (len(raw) + 1, zlib.crc32(raw), r.shard, r.slot)


def _targets(sizes: dict, cap=3):
    """Shares by weight; what is above cap is given to the others again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and free and left * weight[s] / free > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else left * weight[s] / free for s in names}
        capped |= over


def test_mix(spark, documents):
    got = mixing.mix_copies(documents.select("doc_id", "text", "source")).collect()
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    target = _targets(sizes)
    taken, biggest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 1.01 * biggest[s] for s in sizes)
    assert rows_of(mixing.mix_copies(documents)) == rows_of(mixing.mix_copies(documents.repartition(7)))


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "a b", "y"), (None, "a b", "y")]
    rows += [(9, "w " * 50, "hot")] * 400
    d = frame(spark, rows, "copies")
    got = mixing.mix_copies(d).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 51
    assert {r.source_size for r in got if r.source == "x"} == {0} and {r.taken for r in got if r.source == "x"} == {0}
    mix = mixing.mixed(d)
    assert mix.columns == d.columns and mix.count() == sum(r.copies for r in got)
    assert mixing.mix_copies(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [(1, None)])).count() == 0


def _statistics(text):
    w, t = WORD.findall(text or ""), text or ""
    seen, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, documents):
    odd = frame(spark, [
        (-1, None), (-2, ""), (-3, " \n\t"), (-4, "a"), (-5, "a a"), (-6, "a a a"), (-7, "a a a a"), (-8, "a\x0bb\x0cc a b c"),
        (-9, "é é é é\n\n é"), (-10, "a b c x a b c y a b c"), (-11, "ab c d a bc d"), (-12, "x y\nx y\n x y\n#$%&|<>*"),
        (-13, "long " * 60_000),
    ])
    docs = documents.union(odd)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.with_statistics(docs, quality.BASE).collect():
        assert tuple(r[n] for n in quality.BASE) == _statistics(texts[r.doc_id]), r.doc_id


def test_learned_list():
    def row(sym, cap, bad, i):
        return dict.fromkeys(quality.RATIOS, 1.0) | {"symbols_per_word": sym, "capitals": cap, "bad": bad, "fold": i % 3}

    data = [row(i % 10, 5, False, i) for i in range(300)] + [row(50 + i % 9, 5, True, i) for i in range(60)]
    data += [row(3, 90, True, i) for i in range(60)] + [row(30, 5, i % 2 == 0, i) for i in range(4)]
    rules = quality.learn_rules(data)
    fires = [any(all(c.holds(r) for c in rule) for rule in rules) for r in data[:420]]
    assert fires == [False] * 300 + [True] * 120
    assert quality.learn_rules([]) == [] and quality.learn_rules([r for r in data if not r["bad"]]) == []


def test_quality_end_to_end(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = quality.fit(documents, labels)
    got = quality.judged(documents, rules)
    marked = got.join(labels.groupBy("doc_id").min("quality").toDF("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in marked) >= 0.97 * len(marked)
    plain = rows_of(got.where("kept").select(*documents.columns))
    assert rows_of(quality.passing(documents, rules)) == plain
    clash = frame(spark, [(1, "w " * 60), (2, None)], "kept")
    assert quality.passing(clash, rules).columns == clash.columns
    assert rows_of(quality.judged(clash, rules).select("doc_id", "base_failed", "kept")) == [(1, True, False), (2, True, False)]
    assert quality.judged(frame(spark, []), rules).count() == 0
    assert quality.fit(frame(spark, []), labels) == []
