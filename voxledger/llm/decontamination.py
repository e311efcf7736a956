"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit verification.

An item of n words leaks into a document where a run of its words is within
floor(0.2 n) word edits of the item.

Items are cut into segments of at most SEGMENT words.  Of s segments one has at
most a share of k div s of the k edits allowed, so an item is found where one of
its segments is found within its own share.  Windows as long as a segment are
embedded by random walks: at step j the walk writes the word it stands on and
moves on by a random bit of (j, word), so runs at a small edit distance come out
at a small Hamming distance.  A repetition is one walk of which SAMPLED steps are
sampled; a window that agrees with a segment on all of them makes its place a
candidate, and the edit distance of the whole item decides there.  The number of
repetitions follows from the length and edits of a segment (``repetitions``), so
that a segment with all of its edits is found with a probability of TARGET.

Walks are taken only from places that can hold a segment.  With e edits, one of
e + 1 pieces of the segment stands unchanged in the window and starts within e
words of its place, so windows are taken from such places; this loses nothing.

``exact=True`` verifies every place around an unchanged piece of an item instead:
it misses nothing, takes longer on large benchmarks, and is what tests measure
the recall against.

Only items that can be in a text are followed there: of any run within the allowed
edits one piece stands unchanged, and all but so many of the item's different words
are in the text.  What this drops could not pass the edit distance either, so walks
are taken in few texts and only over segments that may be found, and what a task
holds is the words of the items and one row for each piece.

Items are a query set: they go to the tasks in blocks of at most BLOCK_ITEMS items
and about BLOCK_BYTES bytes, so what is sent at a time has a bound however large the
benchmark is.  A block is broadcast, and a Python worker prepares it once for all of
its tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import packed, small_batches, unpacked

#: Edits allowed per word of an item.
SHARE = 0.2
BLOCK_ITEMS = 200_000
BLOCK_BYTES = 16 << 20
#: Words of a segment at most, sampled steps of a walk, probability of finding a segment with all its edits.
SEGMENT = 30
SAMPLED = 2
TARGET = 0.999
#: Measured; see repetitions.
AGREE = 0.85
WINDOWS_AT_ONCE = 4096
#: Words of texts that are searched at a time, one text at least; rows that go back at a time.
WORDS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 50_000
SEED = 11
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Letters and digits in lower case; punctuation and case make no difference."""
    return _TOKEN.findall((text or "").lower())


def edits(a: list[int], b: list[int], most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the run of b nearest to a, in word edits; distance most + 1 if there is none within most."""
    best = list(range(len(a) + 1)), [0] * (len(a) + 1)
    found = (most + 1, 0, 0)
    for j, y in enumerate(b, 1):
        cost, origin = best
        now, begin = [0], [j]
        for i, x in enumerate(a, 1):
            step = min((cost[i - 1] + (x != y), origin[i - 1]), (cost[i] + 1, origin[i]), (now[i - 1] + 1, begin[i - 1]))
            now.append(step[0])
            begin.append(step[1])
        best = now, begin
        found = min(found, (now[-1], begin[-1], j))
    return found


def repetitions(n: int, k: int) -> int:
    """Walks to take for segments of n words with k edits.

    Out of 2 n steps, a walk over an edited run agrees with that over the segment on a
    share that falls with the edits; measured on random words, two sampled steps agree
    with a probability of at least AGREE to the power of 100 k / n.
    """
    return 1 if not k else int(np.ceil(np.log(1 - TARGET) / np.log(1 - AGREE ** (100 * k / n))))


class Walks:
    """Random walks, the same for segments and windows of n words."""

    def __init__(self, n: int, walks: int, seed: int = SEED):
        rng = np.random.default_rng((seed, n))
        self.n = n
        self.factors = rng.integers(1, 1 << 62, size=(walks, 2 * n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # steps 0 to 2 n - 1 can be sampled: an undisturbed walk has passed all n words by then, on average
        self.steps = rng.integers(0, 2 * n, size=(walks, SAMPLED))
        self.mix = rng.integers(1, 1 << 62, size=SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(windows, walks) keys of windows of x from start on; x ends in as many zeros as a window has words."""
        place = np.repeat(start[:, None], len(self.factors), axis=1)
        last = place + self.n
        key = np.zeros(place.shape, dtype=np.uint64)
        for j in range(int(self.steps.max()) + 1):
            word = np.where(place < last, x[np.minimum(place, len(x) - 1)], 0).astype(np.uint64) + np.uint64(1)
            for s, mix in enumerate(self.mix):
                hit = np.flatnonzero(self.steps[:, s] == j)
                if len(hit):
                    key[:, hit] += word[:, hit] * mix
            place += (word * self.factors[:, j] >> np.uint64(63)).astype(np.int64)
        return key


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one behind the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal numbers, none below 0."""
    edge = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x)).tolist()
    return list(zip(edge, edge[1:], strict=False))


class Lists:
    """Lists of numbers in one array; list k begins at start[k] and has length[k] of them."""

    def __init__(self, flat: np.ndarray, length: np.ndarray):
        self.flat, self.length, self.start = flat, length, np.cumsum(length) - length

    def __len__(self) -> int:
        return len(self.length)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.start[k] : self.start[k] + self.length[k]]


class Pieces:
    """Word lists, stretches of one array, found where one of most + 1 pieces of them stands unchanged."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, most: np.ndarray):
        self.flat, self.start = flat, start
        count = most + 1
        k = np.repeat(np.arange(len(start)), count)
        p = _spread(np.zeros(len(start), dtype=np.int64), count)
        offset = p * length[k] // count[k]
        widths = (p + 1) * length[k] // count[k] - offset
        # by width of the pieces: their hashes in order, the list and the place in it of each, what the first bits of a hash can be
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == width)
            h = self._hashes(flat, width)[start[k[mine]] + offset[mine]]
            order = np.argsort(h, kind="stable")
            marks = np.zeros(1 << min(24, max(12, (len(h) * 8).bit_length())), dtype=bool)
            marks[self._slot(h, marks)] = True
            self.pieces[width] = h[order], k[mine][order].astype(np.int32), offset[mine][order].astype(np.int32), marks

    def _hashes(self, x: np.ndarray, width: int) -> np.ndarray:
        x = x.astype(np.uint64)
        h = np.zeros(max(0, len(x) - width + 1), dtype=np.uint64)
        for j in range(width):
            h = (h ^ x[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    def _slot(self, h: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(marks).bit_length())).astype(np.int64)

    def hits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, list, place in the text where the list would start if nothing before the piece were edited, and start and end of the piece in the text."""
        gap = np.zeros(max(self.pieces, default=1), dtype=np.uint64)
        x = np.concatenate([part for t in texts for part in (t, gap)] or [gap])
        first = np.cumsum([0, *[len(t) + len(gap) for t in texts]])
        out = [(np.zeros(0, dtype=np.int64),) * 5]
        for width, (known, lists, offsets, marks) in self.pieces.items():
            h = self._hashes(x, width)
            at = np.flatnonzero(marks[self._slot(h, marks)])
            low = np.searchsorted(known, h[at])
            n = np.searchsorted(known, h[at], "right") - low
            at, piece = np.repeat(at, n), _spread(low, n)
            for j in range(width):  # a hash may mislead
                same = self.flat[self.start[lists[piece]] + offsets[piece] + j] == x[at + j]
                at, piece = at[same], piece[same]
            i = np.searchsorted(first, at, "right") - 1
            at = at - first[i]
            out.append((i, lists[piece].astype(np.int64), at - offsets[piece], at, at + width))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Items:
    """One block of items, ready to be searched for; items of equal words are searched for once."""

    def __init__(self, items: list[tuple[int, str]]):
        seen: dict[str, int] = {}
        same: dict[bytes, int] = {}
        words: list[np.ndarray] = []
        self.ids: list[list[int]] = []
        for i, text in items:
            t = np.array([seen.setdefault(w, len(seen)) for w in tokens(text)], dtype=np.uint32)
            if not len(t):
                continue
            k = same.setdefault(t.tobytes(), len(words))
            if k == len(words):
                words.append(t)
                self.ids.append([])
            self.ids[k].append(i)
        self.vocabulary = {w: k for k, w in enumerate(sorted(seen), 1)}
        number = np.array([self.vocabulary[w] for w in seen], dtype=np.uint32)
        self.words = Lists(number[np.concatenate([*words, np.zeros(0, dtype=np.uint32)])], np.array([len(t) for t in words], dtype=np.int64))
        self.most = (SHARE * self.words.length).astype(np.int64)

    @cached_property
    def search(self) -> Pieces:
        return Pieces(self.words.flat, self.words.start, self.words.length, self.most)

    @cached_property
    def segments(self) -> Segments:
        return Segments(self)

    @cached_property
    def distinct(self) -> Lists:
        """By item, its different words."""
        size = len(self.vocabulary) + 1
        each = np.unique(np.repeat(np.arange(len(self.words)), self.words.length) * size + self.words.flat)
        return Lists((each % size).astype(np.uint32), np.bincount(each // size, minlength=len(self.words)))

    def possible(self, text: np.ndarray, item: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Whether so many of the item's words are in the text that it may be there; for pairs in order of text."""
        here = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        out = np.zeros(len(text), dtype=bool)
        for a, b in _runs(text):
            words, k = texts[text[a]].astype(np.int64), item[a:b]
            n = self.distinct.length[k]
            here[words] = True
            there = here[self.distinct.flat[_spread(self.distinct.start[k], n)]]
            here[words] = False
            out[a:b] = n - np.add.reduceat(there, np.cumsum(n) - n, dtype=np.int64) <= self.most[k]
        return out

    def places(self, found: dict[tuple[int, int], set[int]], texts: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By text and item, the parts of the text that hold every run of the item that starts near one of the places found; they do not overlap."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (i, k), starts in found.items():
            n, most, parts = int(self.words.length[k]), int(self.most[k]), []
            for s in sorted(starts):
                a, b = max(0, s - most), min(len(texts[i]), s + n + most)
                if parts and a <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], b)
                else:
                    parts.append((a, b))
            out[i, k] = parts
        return out

    def nearest(self, k: int, text: list[int]) -> tuple[int, int, int] | None:
        """edits() of item k and text, or None where there is no run within the allowed edits."""
        words, most = self.words[k].tolist(), int(self.most[k])
        n = len(words)
        if len(set(words).difference(text)) > most:
            return None
        # Myers' algorithm: by word, one bit for each of its places; bits of up and down say where the column of distances rises and falls
        bits: dict[int, int] = {}
        for j, w in enumerate(words):
            bits[w] = bits.get(w, 0) | 1 << j
        full, last = (1 << n) - 1, 1 << n - 1
        up, down, distance = full, 0, n
        least, end = most + 1, 0
        for j, word in enumerate(text, 1):
            same = bits.get(word, 0)
            across = (((same & up) + up) ^ up) | same
            rise, fall = down | ~(across | up) & full, up & across
            if rise & last:
                distance += 1
            elif fall & last:
                distance -= 1
            rise, fall, same = rise << 1 & full, fall << 1 & full, same | down
            up, down = fall | ~(same | rise) & full, rise & same
            if distance < least:
                least, end = distance, j
        if least > most:
            return None
        if not least:
            return 0, end - n, end
        # the first of the nearest runs starts where one that ends at end can, and no run is longer than n + least words
        low = max(0, end - n - least)
        d, a, b = edits(words, text[low : end + 2 * least], most)
        return d, low + a, low + b

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end): the nearest place of every item that leaks into one of texts (word numbers); misses none."""
        found: dict[tuple[int, int], set[int]] = {}
        i, k, place, _, _ = self.search.hits(texts)
        for i, k, at in zip(i.tolist(), k.tolist(), place.tolist(), strict=True):
            found.setdefault((i, k), set()).add(at)
        return self.verified(self.places(found, texts), texts)

    def verified(self, places: dict[tuple[int, int], list[tuple[int, int]]], texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """Of the parts of texts to look into by text and item, the nearest place of each within the allowed edits."""
        for (i, k), parts in sorted(places.items()):
            near = [(d, a + s, a + e) for a, b in parts if (got := self.nearest(k, texts[i][a:b].tolist())) for d, s, e in [got]]
            if near:
                yield (i, k, *min(near))


class Segments:
    """The segments of a block of items, found in texts by walks; places are handed to the items for verification."""

    def __init__(self, items: Items):
        self.items = items
        words = items.words
        self.count = -(-words.length // SEGMENT)
        self.first = np.cumsum(self.count) - self.count
        # of each segment: its item, its place in the item, its words and edits
        self.item = np.repeat(np.arange(len(words)), self.count)
        n, count = words.length[self.item], self.count[self.item]
        p = _spread(np.zeros(len(words), dtype=np.int64), self.count)
        self.offset = p * n // count
        self.length = (p + 1) * n // count - self.offset
        self.start = words.start[self.item] + self.offset
        self.most = items.most[self.item] // count
        self.search = Pieces(words.flat, self.start, self.length, self.most)
        lengths = [tuple(x) for x in np.unique(np.stack([self.length, self.most], axis=1), axis=0).tolist()]
        by_length: dict[int, int] = {}
        for n, most in lengths:
            by_length[n] = max(by_length.get(n, 1), repetitions(n, most))
        self.walks = {n: Walks(n, count) for n, count in by_length.items()}

    def _windows(self, n: int, hits: tuple[np.ndarray, ...], texts: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of the windows of n words around the pieces that the texts of which hold, in order."""
        text, segment, place = hits[:3]
        near = (self.length[segment] == n) & np.isin(text, which)
        i, at, most = text[near], place[near], self.most[segment[near]]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        low = np.maximum(0, at - most)
        many = np.maximum(0, np.minimum(size[i], at + most + 1) - low)
        longest = int(size.max(initial=0)) + 1
        return np.divmod(np.unique(np.repeat(i, many) * longest + _spread(low, many)), longest)

    def _near(self, n: int, own: np.ndarray, mine: np.ndarray, hits: tuple[np.ndarray, ...], texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """Where segments of n words, mine in the texts own, agree with a window on a walk: text, item and the least and largest place where the item would start, of places whose parts of the text meet."""
        walks, items = self.walks[n], self.items
        many = len(walks.factors)
        salt = np.random.default_rng((SEED, n)).integers(0, 1 << 63, size=many, dtype=np.uint64)
        mixed = lambda keys, text: (keys ^ salt ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]).ravel()
        step = max(1, WINDOWS_AT_ONCE * 64 // many)
        known = [walks.keys(items.words.flat, self.start[mine[a : a + step]]) for a in range(0, len(mine), step)]
        known = mixed(np.concatenate(known), own)
        order = np.argsort(known)
        known = known[order]
        which = np.unique(own)
        text, place = self._windows(n, hits, texts, which)
        first = np.cumsum([0, *[len(texts[j]) + n for j in which.tolist()]])
        x = np.concatenate([part for j in which.tolist() for part in (texts[j], np.zeros(n, dtype=np.uint64))])
        start = first[np.searchsorted(which, text)] + place
        reach = items.words.length + 2 * items.most
        for a in range(0, len(place), step):
            t, at = text[a : a + step], place[a : a + step]
            keys = mixed(walks.keys(x, start[a : a + step]), t)
            low = np.searchsorted(known, keys)
            count = np.searchsorted(known, keys, "right") - low
            window, walk = np.divmod(np.repeat(np.arange(len(keys)), count), many)
            s, r = np.divmod(order[_spread(low, count)], many)
            right = (walk == r) & (t[window] == own[s])
            s, window = np.divmod(np.unique(s[right] * len(t) + window[right]), len(t))
            item, begin = self.item[mine[s]], at[window] - self.offset[mine[s]]
            cut = np.flatnonzero((np.diff(s, prepend=-1) != 0) | (np.diff(begin, prepend=0) > reach[item]))
            yield t[window[cut]], item[cut], begin[cut], begin[np.append(cut[1:], len(begin))[: len(cut)] - 1]

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By text and item, the parts of the text that hold every run of the item that starts near a place where walks agree; they do not overlap."""
        items, hits = self.items, self.search.hits(texts)
        pair, which = np.unique(hits[0] * len(items.words) + self.item[hits[1]], return_inverse=True)
        t, k = np.divmod(pair, max(1, len(items.words)))
        stays = items.possible(t, k, texts)
        n = self.count[k[stays]]
        own, mine = np.repeat(t[stays], n), _spread(self.first[k[stays]], n)
        lengths = self.length[mine]
        found = [part for n in np.unique(lengths).tolist() for part in self._near(n, own[lengths == n], mine[lengths == n], hits, texts)]
        if not found:
            return {}
        text, item, least, last = (np.concatenate(c) for c in zip(*found, strict=True))
        pairs = np.searchsorted(pair, text * len(items.words) + item)
        order = np.lexsort((least, pairs))
        pairs, least, last = pairs[order], least[order], last[order]
        # pieces by pair and place
        order = np.lexsort((hits[3], which))
        begin, end, cut = hits[3][order], hits[4][order], np.searchsorted(which[order], np.arange(len(pair) + 1))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b in _runs(pairs):
            p = pairs[a]
            i, item = int(t[p]), int(k[p])
            n, most = int(items.words.length[item]), int(items.most[item])
            top = np.maximum.accumulate(last[a:b])
            new = np.flatnonzero(np.append(True, least[a + 1 : b] > top[:-1] + n + 2 * most))
            low = np.maximum(0, least[a:b][new] - most)
            high = np.minimum(len(texts[i]), top[np.append(new[1:], b - a) - 1] + n + most)
            # a part without a whole piece of the item cannot hold it
            pieces, ends = begin[cut[p] : cut[p + 1]], end[cut[p] : cut[p + 1]]
            x, y = np.searchsorted(pieces, low), np.searchsorted(pieces, high)
            parts = [(u, v) for u, v, g, h in zip(low.tolist(), high.tolist(), x.tolist(), y.tolist(), strict=True) if (ends[g:h] <= v).any()]
            if parts:
                out[i, item] = parts
        return out

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end): the nearest place of every item that a segment led to."""
        return self.items.verified(self.candidates(texts), texts)


def _search(shared: Broadcast, exact: bool):
    def rows(columns: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)], _LEAK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = shared.value  # the same one for all tasks of a Python worker
        matches = block.matches if exact else block.segments.matches
        get, length = block.vocabulary.get, block.words.length.tolist()
        for b in batches:
            ids, hashes, column = b.column("id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text")
            first, texts, held = 0, [], 0
            out: list[tuple] = []
            for at in range(len(ids)):
                t = np.array(list(map(get, tokens(column[at].as_py()), repeat(0))), dtype=np.uint64)
                texts.append(t)
                held += len(t)
                if held < WORDS_AT_ONCE and at + 1 < len(ids):
                    continue
                for i, k, d, a, e in matches(texts):
                    for item in block.ids[k]:
                        out.append((ids[first + i], hashes[first + i], item, a, e - a, length[k], d))
                        if len(out) == ROWS_AT_ONCE:
                            yield rows(out)
                            out = []
                first, texts, held = at + 1, [], 0
            if out:
                yield rows(out)

    return run


_LEAK = ["doc_id", "text_hash", "item_id", "start_word", "n_words", "item_words", "distance"]
_LEAK_DDL = "doc_id long, text_hash long, item_id long, start_word int, n_words int, item_words int, distance int"


def leaks(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, exact: bool = False) -> DataFrame:
    """One row per document and benchmark item found in it, with the nearest place and its distance in word edits.

    docs has doc_id and text, items has item_id and text.  Null and empty texts
    of either hold nothing and are found nowhere; rows without doc_id come out
    without it; of repeated items each gives its row.  Words are counted as
    tokens() has them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"
    ).where(F.col("text") != "")
    query = items.select(F.col("item_id").cast("long"), F.col("text")).where(F.col("text").isNotNull())
    count, size = query.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-size // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for k in range(blocks):
        block = sorted(query.where(number == k).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in block]))
        found.append(d.mapInArrow(_search(shared, exact), _LEAK_DDL))
    return reduce(DataFrame.union, found)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The result of leaks without the inner key, for the documents that hold an item."""
    return leaks(docs, items).drop("text_hash")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, all columns as they are."""
    row, keep = packed(docs, [])
    own = F.col("doc_id").cast("long")
    d = docs.select(
        row, own.isNull().alias("_null"), F.coalesce(own, F.lit(0)).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )
    hit = leaks(docs, items).select(
        F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash")
    ).distinct()
    return d.join(hit, ["_null", "_id", "_hash"], "left_anti").select(*unpacked(keep))
