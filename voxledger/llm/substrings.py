"""Exact removal of repeated word windows, found by difference-cover anchors.

Of every window of WINDOW consecutive words that occurs more than once, all but
the first occurrence (smallest doc_id, then smallest start) lose their words.

Equal texts are one class before anything is compared; later copies of a class
repeat all windows of its first document, so they need no search.  In the
classes, windows of WINDOW - PERIOD + 1 words are hashed only where the position
modulo PERIOD lies in a difference cover: for any two positions some shift below
PERIOD brings both onto the cover, so two equal long windows share an anchor at
the same offset.  Windows that contain no repeated anchor are unique.  The others
are extended to WINDOW words, hashed to 96 bits, and the least (doc_id, start) of
each hash stays.

Within a task equal anchors and windows meet before the shuffle, and one row per
hash and task leaves it, so a passage in a third of all documents sends each
reducer only about as many rows as there are tasks.  Reducers read sorted rows
and hold one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import small_batches

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # each difference modulo 13 occurs in it
#: Words that a task gathers before it looks for repeats among them.
CHUNK_WORDS = 2_000_000
_LAST = np.iinfo(np.int64).max
#: Odd random factors, one row of WINDOW per hash.
_FACTORS = np.random.default_rng(2024).integers(1, 1 << 63, size=(3, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes.split() cuts at space and 9 to 13 only


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _window_hashes(x: np.ndarray, width: int, which: int, at: np.ndarray) -> np.ndarray:
    """Hash of the width words from each position in at."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        out += x[at + j] * _FACTORS[which, j]
    return out ^ (out >> np.uint64(29))


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Lists of rows (columns..., words) of about CHUNK_WORDS words in all."""
    held, n = [], 0
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for *row, z in zip(*[b.column(c).to_pylist() for c in columns], b.column("z").to_pylist(), strict=True):
            words = unpack.decompress(z).split() if z else []
            held.append((*row, words))
            n += len(words)
            if n >= CHUNK_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _classes(docs: DataFrame) -> DataFrame:
    """(k1, k2, ord, z): one row per distinct text, with the smallest doc_id and the text, compressed."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([tool.compress(t.encode()) if t else b"" for t in b.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[:3], z], ["k1", "k2", "ord", "z"])

    d = keyed(docs).select("k1", "k2", F.coalesce("id", F.lit(int(_LAST))).alias("ord"), "text")
    pressed = d.mapInArrow(press, "k1 long, k2 long, ord long, z binary")
    # Inner joins on the keys would add this filter, but only to some uses.  All uses take all columns of the
    # same rows, so that they share one exchange.
    pressed = pressed.where(F.col("k1").isNotNull() & F.col("k2").isNotNull())
    return pressed.groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.first("z").alias("z"))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text, k1, k2) with 96 bits that name a text; k2 has 32 of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(7), text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("k2"),
    )


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    """Anchor rows (h, k1, at); at packs k2, position and whether the task has seen it repeated.

    kind 1: repeated in this chunk, this row stands for it.  kind 2: repeated,
    only passed on, so its h is its own.
    """
    width = window - period + 1
    on = np.zeros(period, dtype=bool)
    on[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, ["k1", "k2"]):
            rows = [r for r in rows if len(r[2]) >= window]
            if not rows:
                continue
            x = _word_hashes([w for r in rows for w in r[2]])
            size = np.array([len(r[2]) for r in rows])
            start = np.cumsum(size) - size
            pos = np.concatenate([p[on[p % period]] for p in (np.arange(n - width + 1) for n in size)])
            doc = np.repeat(np.arange(len(rows)), [int(on[np.arange(n - width + 1) % period].sum()) for n in size])
            h = _window_hashes(x, width, 0, start[doc] + pos)
            order = np.argsort(h, kind="stable")
            h, pos, doc = h[order], pos[order], doc[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            shared = ~first | np.concatenate([~first[1:], [False]])
            kind = np.where(first, shared.astype(np.uint64), np.uint64(2))
            k1 = np.array([r[0] for r in rows], dtype=np.int64)[doc]
            k2 = np.array([r[1] for r in rows], dtype=np.uint64)[doc]
            at = (k2 << np.uint64(32)) | (pos.astype(np.uint64) << np.uint64(2)) | kind
            own = (k1.view(np.uint64) ^ at) * _FACTORS[2, 0]
            h = np.where(first, h, own)
            back = np.lexsort((pos, doc))  # rows of a text side by side pack better
            yield pa.record_batch([pa.array(_int64(c[back])) for c in (h, k1, at)], ["h", "k1", "at"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: (k1, k2, pos) of those whose h is not alone."""
    held = None  # the last row of the batch before, and whether it equals its forerunner
    for b in batches:
        h, k1, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "k1", "at"))
        if held is not None:
            h, k1, at = (np.concatenate([[v], c]) for v, c in zip(held[:3], (h, k1, at), strict=True))
        same = h[1:] == h[:-1]
        hit = np.concatenate([[held[3] if held else False], same])
        hit[:-1] |= same
        hit |= (at & 3) > 0
        yield _positions(k1[:-1][hit[:-1]], at[:-1][hit[:-1]])
        held = (h[-1], k1[-1], at[-1], bool(same[-1]) if len(same) else bool(held and held[3]))
    if held is not None and (held[3] or held[2] & 3):
        yield _positions(np.array([held[1]]), np.array([held[2]]))


def _positions(k1: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    u = at.view(np.uint64)
    k2, pos = (u >> np.uint64(32)).astype(np.int64), ((u & np.uint64(0xFFFFFFFF)) >> np.uint64(2)).astype(np.int32)
    return pa.record_batch([pa.array(k1), pa.array(k2), pa.array(pos)], ["k1", "k2", "pos"])


def _windows(window: int, period: int):
    """Window rows (h1, h2, ord, k1, at) for windows with a repeated anchor; at packs k2 and start.

    Windows that repeat an earlier one of the chunk are known; they come as one
    row per text, with their starts in known, under an h1 of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, ["k1", "k2", "ord", "pos"]):
            rows.sort(key=lambda r: (r[2], r[0], r[1]))
            x = _word_hashes([w for r in rows for w in r[4]])
            start, parts, docs = 0, [], []
            for i, (_, _, _, anchors, words) in enumerate(rows):
                n = len(words)
                near = np.zeros(n + 1, dtype=np.int64)  # anchors at i .. i + period - 1 make window i a candidate
                p = np.unique(np.asarray(anchors, dtype=np.int64))
                np.add.at(near, np.maximum(p - period + 1, 0), 1)
                np.add.at(near, p + 1, -1)
                mine = np.flatnonzero(np.cumsum(near)[: max(0, n - window + 1)])
                parts.append(mine + start)
                docs.append(np.full(len(mine), i))
                start += n
            at, doc = np.concatenate(parts), np.concatenate(docs)
            if not len(at):
                continue
            begin = np.cumsum([0, *[len(r[4]) for r in rows]])
            h1, h2 = _window_hashes(x, window, 0, at), _window_hashes(x, window, 1, at) >> np.uint64(33)
            order = np.lexsort((at, h2, h1))  # rows are in order of (ord, key), so at is the order of windows
            a, b = h1[order], h2[order]
            first = np.empty(len(at), dtype=bool)
            first[order] = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            k1 = np.array([r[0] for r in rows], dtype=np.int64)
            k2 = np.array([r[1] for r in rows], dtype=np.uint64) << np.uint64(32)
            rank = np.array([r[2] for r in rows], dtype=np.int64)
            own = at - begin[doc]
            f = np.flatnonzero(first)
            yield pa.record_batch(
                [
                    pa.array(_int64(h1[f])), pa.array(h2[f].astype(np.int32)), pa.array(rank[doc[f]]), pa.array(k1[doc[f]]),
                    pa.array(_int64(k2[doc[f]] | own[f].astype(np.uint64))), pa.nulls(len(f), pa.binary()),
                ],
                _WINDOW_ROW,
            )
            rest = np.flatnonzero(~first)
            which, cut = np.unique(doc[rest], return_index=True)
            starts = [s.astype(np.int32).tobytes() for s in np.split(own[rest], cut[1:])] if len(rest) else []
            yield pa.record_batch(
                [
                    pa.array(k1[which] ^ np.int64(0x5BD1E995)), pa.array(np.zeros(len(which), np.int32)), pa.array(rank[which]),
                    pa.array(k1[which]), pa.array(_int64(k2[which])), pa.array(starts, pa.binary()),
                ],
                _WINDOW_ROW,
            )

    return run


_WINDOW_ROW = _schema(h1=pa.int64(), h2=pa.int32(), ord=pa.int64(), k1=pa.int64(), at=pa.int64(), known=pa.binary())


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of window rows sorted by hash and order: (k1, k2, starts) of all but the first of each hash."""
    last = None
    for b in batches:
        known = b.column("known")
        ready = np.asarray(known.is_valid())
        h1, h2, k1, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "k1", "at"))
        if ready.any():
            yield _starts(k1[ready], at[ready], known.filter(pa.array(ready)))
        h1, h2, k1, at = (c[~ready] for c in (h1, h2, k1, at))
        if not len(h1):
            continue
        same = np.concatenate([[last == (h1[0], h2[0])], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
        last = (h1[-1], h2[-1])
        start = (at[same].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        yield _starts(k1[same], at[same], pa.array([s.tobytes() for s in start], pa.binary()))


def _starts(k1: np.ndarray, at: np.ndarray, starts: pa.Array) -> pa.RecordBatch:
    k2 = (np.ascontiguousarray(at).view(np.uint64) >> np.uint64(32)).astype(np.int64)
    return pa.record_batch([pa.array(k1), pa.array(k2), starts], ["k1", "k2", "starts"])


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for z, starts in zip(b.column("z").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = unpack.decompress(z).split() if z else []
                n = len(words)
                if starts:
                    at = np.concatenate([np.frombuffer(s, dtype=np.int32) for s in starts])
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stays = np.cumsum(edge)[:n] == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch(
                [b.column("k1"), b.column("k2"), b.column("ord"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["k1", "k2", "ord", "n_words", "n_removed", "kept_text"],
            )

    return run


def _class_results(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(k1, k2, ord, n_words, n_removed, kept_text) of the first document of each class."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or not 1 <= period <= window:
        raise ValueError("cover must be a difference cover modulo period, and period no longer than window")
    spark = docs.sparkSession
    small_batches(spark)
    classes = _classes(docs)

    met = classes.mapInArrow(_anchors(window, period, cover), "h long, k1 long, at long")
    met = met.repartition("h").sortWithinPartitions("h", "k1", "at")
    places = met.mapInArrow(_repeated, "k1 long, k2 long, pos int").groupBy("k1", "k2").agg(F.collect_list("pos").alias("pos"))

    rows = classes.join(places, ["k1", "k2"]).mapInArrow(
        _windows(window, period), "h1 long, h2 int, ord long, k1 long, at long, known binary"
    )
    rows = rows.repartition("h1").sortWithinPartitions("h1", "h2", "ord", "k1", "at")
    removed = rows.mapInArrow(_later, "k1 long, k2 long, starts binary").groupBy("k1", "k2").agg(
        F.collect_list("starts").alias("starts")
    )

    kinds = "k1 long, k2 long, ord long, n_words long, n_removed long, kept_text string"
    return classes.join(removed, ["k1", "k2"], "left").mapInArrow(_kept(window), kinds)


def _per_document(docs: DataFrame, results: DataFrame, window: int, kept: str, nothing: Column) -> DataFrame:
    """Results of classes for all rows of docs; later copies long enough to hold a window keep nothing."""
    copy = (F.coalesce("id", F.lit(int(_LAST))) != F.col("ord")) & (F.col("n_words") >= window)
    return keyed(docs).select("id", "k1", "k2").join(results, ["k1", "k2"]).select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.col(kept)).alias(kept),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text (kept words, joined by one space).

    A null text has no words.  Rows with equal doc_id and equal text are one
    document, each gets its result; of rows with equal doc_id and other texts,
    and of rows without doc_id, which come last, the order is that of a hash of
    the text.  An empty table gives an empty result.
    """
    return _per_document(docs, _class_results(docs, window, period, cover), window, "kept_text", F.lit(""))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def document_repeats(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_words, n_removed, kept_sha256."""
    results = _class_results(docs, WINDOW, PERIOD, COVER).withColumn("kept_sha256", _sha256(F.col("kept_text"))).drop("kept_text")
    return _per_document(docs, results, WINDOW, "kept_sha256", _sha256(F.lit("")))
