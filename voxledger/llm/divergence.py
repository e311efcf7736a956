"""Divergence of the sources of a language by chunk factorization.

Words between white space (chunks) are counted per document; every globally
distinct chunk is cut into terms once, and its terms are joined back to the
counts of the chunk.  Distinct documents of a term need no row per document and
term: a chunk in ``min_docs`` documents proves its terms by itself, and of a
rarer chunk the documents are named one by one.

All figures are whole numbers.  A term with ``count`` occurrences in a group
(or language) with N occurrences of V kept terms has the share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``; the divergence of p from q is
``floor((p - q)**2 / q)``.

The sum over all kept terms for two sources is not taken term by term for terms
that one of them lacks: these depend on the count alone, so a table of counts
per source serves.  Terms that both have are compared in blocks of terms and
tiles of sources.

Defined cases: null text, language or source count as the empty text; every row
is a document of its own, repeated rows and doc_ids included; a language
without kept terms has pairs of value 0 and no terms; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.work import scratch, small_batches, stored, word_blocks

#: Fixed by the contract: what a term is, in lower case of A to Z only.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Distinct (group, chunk) that a task counts before it passes them on.
HELD = 400_000
#: Written counts that a task remembers as read, and their longest.
READ, READ_BYTES = 50_000, 256
#: Sources of one block of pairs.
TILE = 128

_CHUNKS = "chunk string, lang string, first long, last long, sources binary"
_TERMS = "lang string, term string, sure boolean, rows array<long>, groups array<struct<source: string, n: long>>"
_TERM_BYTES = re.compile(rb"[A-Za-z\x80-\xff]+")


def _tag(source: str) -> bytes:
    """A source's name between zero bytes; a zero byte in the name is written as \\0."""
    return source.replace("\\", "\\\\").replace("\0", "\\0").encode() + b"\0"


def _untag(tag: bytes) -> str:
    return re.sub(r"\\(.)", lambda m: "\0" if m[1] == "0" else m[1], tag.decode())


class _Written(dict):
    """Counts of a source as they travel, by count."""

    def __init__(self, source: str) -> None:
        self.tag = _tag(source)

    def __missing__(self, n: int) -> bytes:
        self[n] = out = b"%s%d\0" % (self.tag, n)
        return out


class _Chunks:
    """Chunks of one language: the first documents of each, fewer than min_docs, or that it has enough; and occurrences by source."""

    def __init__(self, min_docs: int) -> None:
        #: The k-th document of each chunk that is not sure.
        self.rows: list[dict[bytes, int]] = [{} for _ in range(max(1, min_docs - 1))]
        self.min_docs = min_docs
        self.sure: set[bytes] = set()
        self.sources: dict[str, Counter] = {}

    def add(self, source: str, row: int, text: bytes) -> None:
        own, chunks = self.sources.setdefault(source, Counter()), set()
        for words in word_blocks(text):
            own.update(words)
            chunks.update(words)
        left = chunks.difference(self.sure)
        for known in self.rows[: self.min_docs - 1]:
            new = left.difference(known)
            known.update(dict.fromkeys(new, row))
            left -= new
        self.sure |= left
        for known in self.rows:
            for chunk in left:
                known.pop(chunk, None)

    def __len__(self) -> int:
        return len(self.rows[0]) + len(self.sure)

    def batch(self, lang: str) -> pa.RecordBatch:
        sources = dict.fromkeys(sorted(self.sure.union(self.rows[0])), b"")  # sorted, neighbours compress better
        for source, own in self.sources.items():
            written = _Written(source)
            for chunk, n in own.items():
                sources[chunk] += written[n]
        first, last = (pa.array(list(map(known.get, sources)), pa.int64()) for known in (self.rows[0], self.rows[-1]))
        if len(self.rows) == 1:
            last = pa.nulls(len(sources), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(sources, pa.binary()).cast(pa.string()), pa.array([lang] * len(sources)), first, last, pa.array(sources.values(), pa.binary())],
            names=["chunk", "lang", "first", "last", "sources"],
        )


def _count_chunks(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Chunks] = {}
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, row, text in zip(langs, sources, batch.column("row").to_pylist(), batch.column("text")):
                known = held.get(lang)
                if known is None:
                    known = held[lang] = _Chunks(min_docs)
                known.add(source, row, text.as_py().lower())  # of bytes: only A to Z change
                if sum(map(len, held.values())) > HELD:
                    yield from (c.batch(k) for k, c in held.items())
                    held = {}
        yield from (c.batch(k) for k, c in held.items() if len(c))

    return run


def _lists(values: pa.Array, lengths: Iterable[int]) -> pa.ListArray:
    """The values in lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(list(lengths), dtype=np.int64)]), pa.int32()), values)


def _cut_chunks(min_docs: int):
    """Rows sorted by chunk: each chunk is cut once, its counts are added to its terms."""

    def passed_on(held):
        keys, facts = list(held), list(held.values())
        rows = [() if sure else own for sure, own, _ in facts]
        counts = [fact[2] for fact in facts]
        tags = list(chain.from_iterable(counts))
        names = {t: _untag(t) for t in set(tags)}
        pairs = pa.StructArray.from_arrays(
            [pa.array([names[t] for t in tags], pa.string()), pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int64())], names=["source", "n"]
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys]), pa.array([t for _, t in keys], pa.binary()).cast(pa.string()), pa.array([f[0] for f in facts], pa.bool_()),
             _lists(pa.array(list(chain.from_iterable(rows)), pa.int64()), map(len, rows)), _lists(pairs, map(len, counts))],
            names=["lang", "term", "sure", "rows", "groups"],
        )

    def columns(batch: pa.RecordBatch) -> list[list]:
        """chunk, lang and sources as they are; first and last with -1 for null, as no row has it."""
        values = [batch.column(0).cast(pa.binary()), batch.column("lang"), batch.column("sources")]
        values += [pc.fill_null(batch.column(c), -1) for c in ("first", "last")]
        return [v.to_numpy(zero_copy_only=False).tolist() for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list] = {}
        read: dict[bytes, dict[bytes, int]] = {}
        last, terms = None, []
        for batch in batches:
            for chunk, lang, sources, one, two in zip(*columns(batch)):
                if chunk != last:
                    last, terms = chunk, _TERM_BYTES.findall(chunk)
                if not terms:
                    continue
                counted = read.get(sources)
                if counted is None:
                    parts = sources.split(b"\0")
                    counted = dict(zip(parts[:-1:2], map(int, parts[1::2])))
                    if len(sources) <= READ_BYTES:
                        if len(read) > READ:
                            read.clear()
                        read[sources] = counted
                for term in terms:
                    fact = held.get((lang, term))
                    if fact is None:
                        held[lang, term] = fact = [False, set(), counted.copy()]
                    else:
                        counts = fact[2]
                        for source, n in counted.items():
                            counts[source] = counts.get(source, 0) + n
                    if not fact[0]:
                        if one < 0:
                            fact[0] = True
                        else:
                            fact[1].add(one)
                            if two >= 0:
                                fact[1].add(two)
                            fact[0] = len(fact[1]) >= min_docs
            if len(held) > HELD // 4:
                yield passed_on(held)
                held = {}
        if held:
            yield passed_on(held)

    return run


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term, exact for counts of any size."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + kept).cast("decimal(20,0)")) + 1


def apart(p: str, q: str) -> Column:
    """Divergence of p from q."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, lang, term, total, groups[(source, n)]) of the terms in at least ``min_docs`` documents of a language, written and read again."""
    if min_docs > 3:
        raise ValueError("the two rows kept of a chunk prove at most three documents")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select(_named("lang"), _named("source"), text, F.monotonically_increasing_id().alias("row"))
    # dealt by its letters, a chunk with all its counts is in one task, and mostly so is a term with all its chunks
    chunks = rows.mapInArrow(_count_chunks(min_docs), _CHUNKS).repartition(F.regexp_replace("chunk", NO_TERM, ""))
    here = chunks.sortWithinPartitions("chunk").mapInArrow(_cut_chunks(min_docs), _TERMS).repartition("lang", "term")
    none, no_row = F.lit(None).cast("string"), F.lit(None).cast("long")

    def fact(source, n, row, sure):
        return F.struct(source, n, row, sure).cast("struct<source: string, n: bigint, row: bigint, sure: boolean>")

    facts = F.concat(
        F.transform("groups", lambda g: fact(g["source"], g["n"], no_row, F.lit(False))),
        F.transform("rows", lambda r: fact(none, F.lit(0), r, F.lit(False))),
        F.array(fact(none, F.lit(0), no_row, F.col("sure"))),
    )
    terms = (
        here.select("lang", "term", F.inline(facts))
        .groupBy("lang", "term", "source", "row").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"))
        .groupBy("lang", "term")
        .agg(
            F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("groups"),
            F.sum("n").alias("total"), F.count("row").alias("docs"), F.max("sure").alias("sure"),
        )
        .where(F.col("sure") | (F.col("docs") >= min_docs)).select("lang", "term", "groups", "total")
    )
    kept = stored(terms, f"{scratch(spark)}/terms")
    return kept.withColumn("id", F.monotonically_increasing_id())


def _named(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring (lang, source) with its number in the language, N, V and the share of a term that it lacks."""
    sums = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(
        F.sum("g.n").alias("total"), F.count(F.lit(1)).alias("own")
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("long")
    return (
        docs.select(_named("lang"), _named("source")).distinct()
        .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "own", "kept", "lang_total"])
        .withColumn("lacking", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))))
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms that sources a and b both have: what their divergence adds to that of terms that one or both lack."""

    def f(p, q):
        d = p - q
        return d * d // q

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            groups = batch.column("groups").filter(pa.array(langs == lang))
            lengths = np.diff(groups.offsets.to_numpy())
            flat = groups.flatten()
            term = np.repeat(np.arange(len(lengths)), lengths)
            at, p, lacking = (flat.field(k).to_numpy() for k in ("at", "p", "lacking"))
            ids, first, column = np.unique(at, return_index=True, return_inverse=True)
            none = lacking[first]
            for a in range(0, len(ids), TILE):
                for b in range(0, len(ids), TILE):
                    yield from _tile(lang, ids, none, term, column, p, len(lengths), a, b, f)


def _tile(lang, ids, none, term, column, p, n, a, b, f):
    def dense(start):
        stop = min(start + TILE, len(ids))
        here = (column >= start) & (column < stop)
        m = np.tile(none[start:stop], (n, 1))
        m[term[here], column[here] - start] = p[here]
        return m

    left, right = dense(a), dense(b)
    none_b = none[b : b + TILE]
    out = np.zeros((left.shape[1], right.shape[1]), np.int64)
    for i in range(left.shape[1]):
        has = term[column == a + i]
        x, y, x0 = left[has, i : i + 1], right[has], none[a + i]
        out[i] = (f(x, y) - f(x, none_b) - f(x0, y) + f(x0, none_b)).sum(0)
    i, j = np.nonzero(out)
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(i), pa.string()), pa.array(ids[a + i]), pa.array(ids[b + j]), pa.array(out[i, j])], names=["lang", "a", "b", "value"]
    )


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other one, and the terms that set it apart from its language."""
    kept = kept_terms(docs, min_docs)
    groups = stored(group_totals(docs, kept), f"{scratch(docs.sparkSession)}/groups")

    own = (
        kept.select("lang", "id", "term", F.col("total").alias("lang_n"), F.explode("groups").alias("g"))
        .select("lang", "id", "term", "lang_n", F.col("g.source").alias("source"), F.col("g.n").alias("n"))
        .join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    )
    terms = (
        own.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    )

    both = (
        own.groupBy("lang", "id").agg(F.collect_list(F.struct("at", "p", "lacking")).alias("groups"))
        .mapInArrow(_tiles, "lang string, a long, b long, value long")
    )
    by_share = own.groupBy("lang", "at", "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("at").alias("to"), F.col("lacking").alias("to_lacking"))
    faced = by_share.join(other, "lang").where("at <> to")
    ahead = faced.groupBy("lang", F.col("at").alias("a"), F.col("to").alias("b")).agg(F.sum(F.col("m") * apart("p", "to_lacking")).alias("value"))
    behind = faced.groupBy("lang", F.col("to").alias("a"), F.col("at").alias("b")).agg(F.sum(F.col("m") * apart("to_lacking", "p")).alias("value"))
    sums = both.where("a <> b").unionByName(ahead).unionByName(behind).groupBy("lang", "a", "b").agg(F.sum("value").alias("sum"))

    a = groups.select("lang", "source", F.col("at").alias("a"), F.col("own").alias("own_a"), F.col("lacking").alias("p"), "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("own").alias("own_b"), F.col("lacking").alias("q"))
    rest = (F.col("kept") - F.col("own_a") - F.col("own_b")) * apart("p", "q")
    pairs = (
        a.join(b, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce(rest, F.lit(0)) + F.coalesce("sum", F.lit(0))).cast("long").alias("value"))
    )

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(terms.select("*", place).where(F.col("rank") <= top_terms))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY w.lang, w.source, w.term),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total
           FROM (SELECT DISTINCT lang, source FROM d) g
           LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) s ON g.lang = s.lang AND g.source = s.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                  CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS BIGINT) AS p,
                  CAST(1 + 1000000000::HUGEINT * (k.lang_n + 1) // (l.lang_total + l.v) AS BIGINT) AS q
           FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
               FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
           FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}
"""
