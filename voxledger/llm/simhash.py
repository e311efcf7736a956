"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; fingerprints that differ in 3 bits or fewer are
linked, so their halves differ in one bit or none on one side.  On each half the
anchors are the words of a covering code: a Hamming code of length 31 with a
free 32nd bit, which has a word within distance R = 1 of every point.  A
fingerprint goes to every anchor within R + 1 = 2 (17 a half at most); the
nearest anchor of one end of a link is within 2 of the other end, so linked
fingerprints meet at an anchor, where they are compared.

Equal fingerprints are one row before anything is compared.  At an anchor, links
are reduced to a spanning forest: a group of k fingerprints gives k - 1 rows at
most.  A group of more than MOST_AT_ANCHOR is not compared there: its members go
on to anchors of the quarters of the other half (of which one again differs in
one bit or none), and those that are still too many to eighths, where any number
is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.components import components
from voxledger.llm.work import drop_folder, packed, scratch, small_batches, stored, unpacked

SHINGLE = 3
SEED = 42
THRESHOLD = 3
MOST_AT_ANCHOR = 2048
BLOCK = 1024
_TOP = np.uint64(63)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(id, text_hash, fp) per row of docs (doc_id, text), fp as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column("id"), b.column("text_hash"), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"), "text")
    return d.mapInArrow(run, "id long, text_hash long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _code(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments of 2**r bits: syndrome masks, and by syndrome the words to add to reach the code at distance 2."""
    n, r = bits - 1, bits.bit_length() - 1
    at = np.arange(1, n + 1)
    masks = np.array([(1 << (at[(at >> k) & 1 == 1] - 1)).sum() for k in range(r)], dtype=np.uint64)
    steps = np.zeros((n + 1, n // 2), dtype=np.uint64)
    for s in range(1, n + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, n + 1) if i < i ^ s <= n and i != s]
        steps[s, : len(pairs)] = pairs
    return masks, steps


def anchors(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: all words of the covering code within distance 2 of each x, a segment of `bits` bits."""
    masks, steps = _code(bits)
    free = np.uint64(1 << (bits - 1))
    core = x & (free - np.uint64(1))
    s = np.zeros(len(x), dtype=np.int64)
    for k, m in enumerate(masks):
        s |= (np.bitwise_count(core & m).astype(np.int64) & 1) << k
    flip = np.where(s > 0, np.left_shift(np.uint64(1), np.maximum(s - 1, 0).astype(np.uint64)), np.uint64(0))
    near = x ^ flip
    far = x[:, None] ^ steps[s]
    use = steps[s] > 0
    rows = np.arange(len(x))
    return (
        np.concatenate([rows, rows, np.repeat(rows, use.sum(axis=1))]),
        np.concatenate([near, near ^ free, far[use]]),
    )


def _segment(fp: np.ndarray, start: int, bits: int) -> np.ndarray:
    return (fp >> np.uint64(start)) & np.uint64((1 << bits) - 1)


#: By segment already used, those that follow where too many meet: (start, bits).
_HALVES = [(0, 32), (32, 32)]


def _next_segments(used: int, level: int) -> list[tuple[int, int]]:
    if level == 0:
        return _HALVES
    other = _HALVES[1 - used]
    bits = 32 >> level
    return [(other[0] + i * bits, bits) for i in range(1 << level)]


def _replicate(level: int):
    """Rows (key, used, fp) for every anchor; key also holds the anchors of earlier levels (33, 17 and 10 bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            groups = [(0, slice(None))] if level == 0 else [(u, (b["used"] == u).to_numpy()) for u in (0, 1)]
            for used, which in groups:
                mine = fp[which]
                if not len(mine):
                    continue
                for k, (start, bits) in enumerate(_next_segments(used, level)):
                    rows, anchor = anchors(_segment(mine, start, bits), bits)
                    key = anchor.astype(np.int64) | (k << bits)
                    if level:
                        key |= b["key"].to_numpy()[which][rows] << (bits + level)
                    yield pd.DataFrame(
                        {"key": key, "used": np.int32(k if level == 0 else used), "fp": mine[rows].view(np.int64)}
                    )

    return run


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what the fingerprints of one group join at distance THRESHOLD or less."""
    n = len(fp)
    label = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            a, b = fp[i : i + BLOCK], fp[j : j + BLOCK]
            close = np.bitwise_count(a[:, None] ^ b[None, :]) <= THRESHOLD
            x, y = np.nonzero(close)
            x, y = x + i, y + j
            while True:  # hang the larger label of each link on the smaller, then follow labels to their roots
                p, q = label[x], label[y]
                apart = p != q
                if not apart.any():
                    break
                x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                hi, at = np.unique(np.maximum(p, q), return_index=True)
                lo = np.minimum(p, q)[at]
                out.append((fp[x[at]], fp[y[at]]))
                label[hi] = lo
                while (label[label] != label).any():
                    label = label[label]
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _pairs_of_small(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of neighbours with the same key, over rows sorted by key; for groups of up to 8."""
    a, b = [], []
    for step in range(1, 8):
        if len(fp) <= step:
            break
        hit = np.nonzero((key[step:] == key[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= THRESHOLD))[0]
        a.append(fp[hit])
        b.append(fp[hit + step])
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _compare(most: int | None):
    """Compare rows sorted by key; groups of more than `most` rows come out as they are (again)."""

    def links(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "key": np.int64(0), "used": np.int32(0), "again": False})

    def whole(key: np.ndarray, used: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        code = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(start, len(key)))
        small = np.repeat((size > 1) & (size <= 8), size)
        yield links(*_pairs_of_small(code[small], fp[small]))
        found = [_forest(fp[s : s + n]) for s, n in zip(start, size, strict=True) if n > 8]
        if found:
            yield links(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, crowded = None, None
        for b in batches:
            if held is not None:
                b = pd.concat([held, b], ignore_index=True)
                held = None
            key = b["key"].to_numpy()
            if crowded is not None:  # the rest of a group that has been found too large
                n = int((key == crowded).argmin()) if (key != crowded).any() else len(b)
                yield again(b.iloc[:n])
                b = b.iloc[n:]
                if not len(b):
                    continue
                crowded, key = None, b["key"].to_numpy()
            tail = int((key == key[-1]).argmax())  # the last group may go on in the next batch
            done, held = b.iloc[:tail], b.iloc[tail:]
            if most is not None and len(held) > most:
                crowded = key[-1]
                yield again(held)
                held = None
            if len(done):
                yield from split(done)
        if held is not None and len(held):
            yield from split(held)

    def again(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": b["fp"], "b": b["fp"], "key": b["key"], "used": b["used"], "again": True})

    def split(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if most is not None:
            n = b.groupby("key", sort=False)["fp"].transform("size").to_numpy()
            if (n > most).any():
                yield again(b[n > most])
                b = b[n <= most]
        if len(b):
            yield from whole(b["key"].to_numpy(), b["used"].to_numpy(), b["fp"].to_numpy(dtype=np.int64).view(np.uint64))

    return run


def fingerprint_links(fps: DataFrame, folder: str, most: int = MOST_AT_ANCHOR) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fps (fp): what is within THRESHOLD bits is connected by them.

    Steps are written below folder.
    """
    out, rest = None, fps.select("fp")
    for level in range(3):
        met = rest.mapInPandas(_replicate(level), "key long, used int, fp long")
        met = met.repartition("key").sortWithinPartitions("key", "fp")
        last = level == 2
        found = met.mapInPandas(_compare(None if last else most), "a long, b long, key long, used int, again boolean")
        found = stored(found, f"{folder}/level{level}")
        links = found.where(~F.col("again")).select("a", "b")
        out = links if out is None else out.union(links)
        rest = found.where("again").select("key", "used", F.col("a").alias("fp"))
        if last or rest.isEmpty():
            break
    return out.distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """(id, text_hash, fp, root, component_id) per row of docs: root is a fingerprint that names the group."""
    spark, top = docs.sparkSession, scratch(docs.sparkSession)
    rows = stored(with_fingerprints(docs), f"{top}/fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), f"{top}/classes")
    roots = components(fingerprint_links(classes, top)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stored(named.join(least, "root").select("fp", "root", "component_id"), f"{top}/members")
    drop_folder(spark, f"{top}/classes")
    return rows.join(member, "fp").select("id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs (doc_id, text).

    fingerprint: 16 hex digits; null and empty texts have zero.  component_id:
    the smallest doc_id of all rows reached over links, itself included; rows
    without doc_id are linked like others, and a group of such rows has none.
    """
    return grouped(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest doc_id, null last, then by text.

    Of equal rows one stays.  All columns of docs come back as they are.
    """
    row, keep = packed(docs, [])
    by = ["_null", "_id", "_hash"]
    name = F.struct(F.col("id").isNull().alias("_null"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    first = grouped(docs).groupBy("root").agg(F.min(name).alias("_first")).select("_first.*")
    own = F.col("doc_id").cast("long")
    d = docs.select(row, own.isNull().alias("_null"), F.coalesce(own, F.lit(0)).alias("_id"), _text_hash().alias("_hash"))
    copy = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("_row")))
    stays = d.join(first.distinct(), by, "left_semi").withColumn("_copy", copy).where(F.col("_copy") == 1)
    return stays.select(*unpacked(keep))
