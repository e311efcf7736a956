"""Substring dedup, SimHash, components and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import frame, rows_of
from voxledger.llm import lines, simhash, substrings, work
from voxledger.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _without_repeats(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, gone = WORD.findall(t or ""), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone |= set(range(s, s + window))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows_of(substrings.document_repeats(documents)) == _without_repeats(rows, 20)


def test_substrings_at_every_alignment(spark, monkeypatch):
    """Passages of 19 to 60 words from a few sources, at all offsets, in small chunks and batches."""
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 500)
    rnd = random.Random(5)
    source = [f"s{i}" for i in range(200)]
    rows = []
    for i in range(150):
        a, n = rnd.randrange(140), rnd.randrange(19, 60)
        text = [f"u{i}_{j}" for j in range(rnd.randrange(15))] + source[a : a + n] + [f"v{i}_{j}" for j in range(rnd.randrange(5))]
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, "go " * (15 + i)) for i in range(20)] + [(2000, rows[0][1]), (2001, rows[0][1] + "\n")]
    rows += [(3000, None), (3001, ""), (3002, "é ñ " * 40), (-5, rows[3][1])]
    d = frame(spark, rows, "k1")
    assert rows_of(substrings.document_repeats(d)) == _without_repeats(rows, 20)
    small = [(i, n, g) for i, n, g, _ in _without_repeats(rows, 7)]
    got = substrings.without_repeats(d, window=7, period=3, cover=(0, 1)).select("doc_id", "n_words", "n_removed")
    assert rows_of(got) == sorted(small, key=repr)


def test_substrings_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    same = substrings.document_repeats(frame(spark, [(1, text), (1, text), (2, text), (None, text + " x")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in same) == [(0, 30), (1, 0), (1, 0), (2, 30)]
    assert substrings.document_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(frame(spark, []), cover=(0, 1))


def _fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _roots(nodes, links):
    up = {i: i for i in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def _close(fps):
    x = np.array(fps, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3):
            yield i, i + 1 + int(j)


def test_simhash_of_documents(spark, documents):
    odd = frame(spark, [(100_000, None), (100_001, ""), (100_002, "A b"), (100_003, "a\tB"), (100_004, "É x"), (None, "a b")])
    docs = documents.union(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [_fingerprint(t) for _, t in rows]
    root = _roots(range(len(rows)), _close(fps))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(x for x in (least.get(root[k]), i) if x is not None) if i is not None or root[k] in least else None
    want = sorted(((i, f"{fps[k]:016x}", least[root[k]]) for k, (i, _) in enumerate(rows)), key=repr)
    assert rows_of(simhash.near_duplicates(docs)) == want
    left = rows_of(simhash.one_of_each(docs).select("doc_id"))
    assert left == sorted(((x,) for x in set(least.values())), key=repr)


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_anchors_cover(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 500, dtype=np.uint64)
    row, anchor = simhash.anchors(x, bits)
    assert (np.bitwise_count(x[row] ^ anchor) <= 2).all() and len(set(zip(row, anchor, strict=True))) == len(row)
    mine = [set(anchor[row == i].tolist()) for i in range(len(x))]
    for k in range(bits):
        r, a = simhash.anchors(x ^ np.uint64(1 << k), bits)
        assert all(mine[i] & set(a[r == i].tolist()) for i in range(0, len(x), 7))


@pytest.mark.parametrize("most", [4, 2048])
def test_crowded_anchors(spark, tmp_path, most):
    """One dense cloud of fingerprints: chains of 3-bit steps and near misses of 4; small groups go through all levels."""
    rng = np.random.default_rng(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(250):
        base = list(fps)[rng.integers(len(fps))]
        flips = rng.choice(64, rng.integers(1, 6), replace=False)
        fps.add(base ^ sum(1 << int(k) for k in flips))
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.fingerprint_links(d, str(tmp_path / "steps"), most).collect()
    at = {f: k for k, f in enumerate(signed)}
    got = _roots(range(len(fps)), [(at[r.a], at[r.b]) for r in links])
    assert got == _roots(range(len(fps)), _close(fps))


def test_components(spark):
    rnd = random.Random(9)
    chain = [(i, i + 1) for i in range(300)]
    star = [(5000, 6000 + i) for i in range(300)]
    some = [(rnd.randrange(7000, 7400), rnd.randrange(7000, 7400)) for _ in range(250)]
    links = chain + star + some + [(-3, -3), (-9, 2**62)]
    rnd.shuffle(links)
    links = [e for e in links if e[0] != e[1]] + [(-3, -3)]
    want = _roots({x for e in links[:-1] for x in e}, links[:-1])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert dict(rows_of(got)) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark):
    shared = "Visit our page today for more news"
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i]} line of its own\n{shared}\n\nVote {i} of {i * 7} cast by user{i}") for i in range(12)]
    rows += [(50, shared + "\nrare words only once"), (51, None), (52, ""), (53, "12\n" + shared), (None, shared), (None, shared)]
    got = {r.doc_id: r for r in lines.without_recurring_lines(frame(spark, rows, "line"), min_docs=10).collect()}
    assert got[3].kept_text == "d line of its own\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert (got[50].kept_text, got[51].kept_text, got[52].kept_text) == ("rare words only once", "", "")
    assert (got[51].n_lines, got[52].n_lines) == (0, 1) and got[53].kept_text == "12" and got[None].kept_text == ""
    few = lines.without_recurring_lines(frame(spark, rows[:9]), min_docs=10)
    assert few.agg({"n_dropped": "sum"}).first()[0] == 0
    assert lines.document_lines(frame(spark, [])).count() == 0


def test_fields_are_found_by_frequency(spark):
    """A field without digits: words at its place differ from document to document."""
    rows = [(i, f"User {chr(97 + i)}{chr(98 + i)} has joined the room") for i in range(14)]
    rows += [(100 + i, f"User {chr(97 + i)} left {chr(98 + i)} with {chr(99 + i)} too") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(frame(spark, rows), min_docs=10).collect()}
    assert {got[i] for i in range(14)} == {1} and {got[100 + i] for i in range(3)} == {0}


@pytest.mark.parametrize("n", [400, 20_000])
def test_fields_in_a_large_corpus(spark, n):
    """The same template is found whether the values of its fields stand in few documents or in many."""
    rnd = random.Random(n)
    value = lambda kind: f"{kind}{''.join(chr(97 + int(c)) for c in str(rnd.randrange(50)))}"
    rows = [(i, f"This article was written by {value('F')} {value('L')} in {value('C')}\n{i}") for i in range(n)]
    rows += [(n + i, f"This is the {value('p')} {value('q')} {value('r')} {value('s')} {value('t')} {value('u')}") for i in range(n // 2)]
    got = lines.without_recurring_lines(frame(spark, rows), min_docs=10)
    assert got.where(f"n_dropped <> CAST(doc_id < {n} AS INT)").count() == 0


def test_fields_among_the_first_words(spark):
    """Wildcards stand for rare second and third words; what differs in most words stays."""
    name = lambda i: f"{chr(97 + i)}{chr(98 + i)}"
    rows = [(i, f"User {name(i)} has joined the room") for i in range(14)]
    rows += [(100 + i, f"User {name(i)} {name(i)}son has left the room") for i in range(14)]
    rows += [(200 + i, f"Dear {name(i)} {name(i + 1)} {name(i + 2)} {name(i + 3)} {name(i + 4)}") for i in range(14)]
    rows += [(300 + i, f"User {name(i)} left {name(i)} with {name(i)} too") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(frame(spark, rows), min_docs=10).collect()}
    assert got == {i: int(i < 200) for i, _ in rows}


def _recurring(texts, min_docs):
    """Lines (masked, trimmed) whose template recurs, by the rules of lines.py one after the other."""
    n, white = Counter(), " \t\n\x0b\f\r"
    for t in set(texts):
        n.update({x for x in (re.sub(lines.VARIABLE, lines.FIELD, x).strip(white) for x in t.split("\n")) if x})
    w = {x: WORD.findall(x) for x in n}
    leaf, wild = {x: (len(w[x]), w[x][0]) for x in n}, dict.fromkeys(n, False)

    def docs(of):
        c = Counter()
        for x in leaf:
            c[of(x)] += n[x]
        return c

    for k in range(1, lines.DEPTH):
        c = docs(lambda x: leaf[x])
        leaf = {x: v for x, v in leaf.items() if c[v] >= min_docs}
        word = lambda x, k=k: w[x][k] if k < len(w[x]) else ""
        c = docs(lambda x: (leaf[x], word(x)))
        known = {x: c[leaf[x], word(x)] >= min_docs for x in leaf}
        wild = {x: wild[x] or not known[x] for x in leaf}
        leaf = {x: (v, word(x) if known[x] else None) for x, v in leaf.items()}
    total = docs(lambda x: leaf[x])
    leaf = {x: v for x, v in leaf.items() if total[v] >= min_docs}
    here, found, often = Counter(), [], Counter()
    for x in leaf:
        for place, word in enumerate(w[x]):
            here[leaf[x], place, word] += n[x]
    for x, v in leaf.items():
        for relative in (False, True):
            least = max(min_docs, lines.USUAL * total[v] if relative else 0)
            fixed = [(p, y) for p, y in enumerate(w[x]) if y != lines.FIELD and here[v, p, y] >= least]
            after = len(w[x]) - lines.DEPTH
            holds = after > 0 and sum(p >= lines.DEPTH for p, _ in fixed) >= after / 2
            if fixed and len(fixed) >= len(w[x]) / 2 and (holds or not (wild[x] or relative)):
                found.append((x, (v, relative, tuple(fixed))))
                often[found[-1][1]] += n[x]
    return {x for x, template in found if often[template] >= min_docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_brute_force(spark, seed):
    """Lines of all lengths in which every place, every second one or any half of them is constant."""
    rnd = random.Random(seed)

    def line():
        size, kind = rnd.randrange(1, 12), rnd.randrange(4)
        free = lambda p: rnd.random() < 0.15 if kind == 0 else p % 2 == kind - 1 if kind < 3 else (p * 7 + size) % 5 < 2
        w = [rnd.choice([f"f{chr(97 + rnd.randrange(26))}", "7", "a@b"]) if free(p) else f"{'uvw'[kind % 3]}{'klm'[p % 3]}" for p in range(size)]
        if kind == 3 and rnd.random() < 0.5:
            w[1:2] = [chr(97 + rnd.randrange(26)) for _ in w[1:2]]
        return rnd.choice([" "] * 6 + ["  ", "\t"]).join(w) + rnd.choice([""] * 5 + [" ", "\r"])

    texts = ["\n".join(line() for _ in range(rnd.randrange(5))) for _ in range(400)]
    texts += texts[:40] + [None]
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(frame(spark, list(enumerate(texts))), min_docs=5).collect()}
    gone = _recurring([t for t in texts if t], 5)
    masked = lambda x: re.sub(lines.VARIABLE, lines.FIELD, x).strip(" \t\n\x0b\f\r")
    want = {i: sum(masked(x) in gone for x in (t or "").split("\n")) for i, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < sum(len(t.split("\n")) for t in texts if t)


def test_line_dedup_leaves_no_tables(spark, tmp_path, monkeypatch):
    """Tables of lines are dropped after their last reader; the two that the lazy result reads stay."""
    monkeypatch.setattr(lines, "scratch", lambda _, n=iter(range(99)): f"{tmp_path}/{next(n)}")
    rows = [(i, f"own line {i}\nVisit our page today for more news\nUser {chr(97 + i)} has joined the room") for i in range(14)]
    got = lines.without_recurring_lines(frame(spark, rows), min_docs=10)
    assert len(list(tmp_path.iterdir())) == 2 and {r.n_dropped for r in got.collect()} == {3}


@pytest.mark.parametrize("chunk_bits", [1, 2, 1 << 15])
def test_lines_by_full_bitmaps(spark, monkeypatch, chunk_bits):
    """Where bitmaps name too many lines, the exact table of dropped lines decides; blank lines and null texts never lose any."""
    monkeypatch.setattr(work, "CHUNK_BITS", chunk_bits)
    monkeypatch.setattr(work, "BITMAP_BITS", 2 * chunk_bits)
    shared = "Visit our page today for more news"
    texts = [f"{chr(97 + i)} line of its own\n{shared}\n \nand{' so' * i} on\n\n{shared}" for i in range(14)] + [None, "", f"{shared}\nno more of this"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.without_recurring_lines(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        kept = [x for x in (t or "").split("\n") if x != shared]
        n = 0 if t is None else len(t.split("\n"))
        assert got[i] == (n, n - len(kept) if t else 0, "\n".join(kept))


def _made(df):
    """Rows from each Generate of words or pairs of words that has run, by the plans of Spark's SQL store."""
    store = df.sparkSession._jsparkSession.sharedState().statusStore()
    found = {}
    for i in range(store.executionsList().size()):
        run = store.executionsList().apply(i)
        values = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if node.name() == "Generate":
                for m in range(node.metrics().size()):
                    value = values.get(node.metrics().apply(m).accumulatorId())
                    if node.metrics().apply(m).name() == "number of output rows" and value.isDefined():
                        found[run.executionId(), node.id()] = (node.desc(), int(value.get().replace(",", "")))
    return found


def test_only_words_of_likely_lines_are_rows(spark):
    """Of many lines in the leaf of a template, only words become rows that a likely line has at the same place."""
    word = lambda i, k: "".join(chr(97 + int(c)) for c in f"{i * 97 + k * 13 + 1000}")
    rows = [(i, f"The {word(i, 50)} {word(i, 51)} " + " ".join(word(0, k) for k in range(17))) for i in range(12)]
    rows += [(100 + i, "The " + " ".join(word(i + 20, k) for k in range(19))) for i in range(500)]
    before = set(_made(frame(spark, [])))
    got = {r.doc_id: r.n_dropped for r in lines.without_recurring_lines(frame(spark, rows), min_docs=10).collect()}
    assert got == {i: int(i < 100) for i, _ in rows}
    own = [n for at, (desc, n) in _made(frame(spark, [])).items() if at not in before and ("explode(filter(" in desc or "posexplode(split(line" in desc)]
    assert own and max(own) < 2 * 512
