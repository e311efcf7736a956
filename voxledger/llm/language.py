"""Language model scores: a log-bilinear neural model trained by noise-contrastive estimation.

A text is its words in order and one end.  The model predicts the class of the
next token from the classes of the CONTEXT tokens before it: each class has an
input vector, each place before the token a matrix, and their products add up to
a vector that is compared with the output vector of every class.  A token's
probability is that of its class, normalised over all classes, times its share
of the class.  Frequent words and the end are classes of their own (share 1);
other words go by their ending, the longest of the frequent endings, and share
``(c + 0.1) / (N + 0.1 * (V + 1))`` of the class's N tokens and V words, so that
an unknown word of each class has a probability too and all sum to one.

Everything counted covers all training documents.  Training uses every training
document once: rounds of growing shares of them, in each of which every task
trains its own copy of the parameters in numpy on its rows; the copies are
averaged by Spark, weighted by tokens.  Noise is drawn from the class
frequencies, the same draws for a whole batch of tokens, so that all arithmetic is
matrix products.

The parameters (CLASSES x SIZE) and the counts of FREQUENT words (a hash decides the
last of them, so a few hundred more at most) of at most LONGEST bytes, the most
frequent ones, are all that the driver holds and broadcasts; the counts of other words are joined to the texts that use them.

Defined cases: a null text is empty and scores its end alone; every row is scored,
repeated rows and doc_ids each for itself; a null doc_id is no training row and
counts as held out; without training documents c, N and V are 0; an empty table
gives no rows.  Long texts are read in blocks.  Floating point sums may differ in
their last digits from run to run.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm.work import scratch, small_batches, stored, word_blocks

#: Fixed by the contract.
HELD_OUT = 10
EXTRA = 0.1

OWN_WORDS = 60
ENDINGS = 97
CONTEXT = 4
SIZE = 24
FREQUENT = 200_000
LONGEST = 64
#: Tokens of one step, noise classes of one step, and the step length.
STEP, NOISE, RATE = 1024, 32, 0.12
#: Shares of the training documents, in 64ths, of each round; in a round no copy of the parameters strays far.
ROUNDS = (4, 12, 48)
#: Tokens scored at once, words that a task counts at once, and words and bytes that it looks up together.
BLOCK, HELD = 2048, 400_000
TOGETHER, TOGETHER_BYTES = 1 << 16, 1 << 25
START, END = 0, 1
#: What stands for START and END among words.
START_MARK, END_MARK = b" ", b""


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def _texts(docs: DataFrame) -> Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lower case of A to Z; bytes.split cuts at the contract's white space."""
    return word_blocks(text.lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task; the end is the empty word."""
    held: Counter = Counter()

    def passed_on():
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held[b""] += 1
            for words in _blocks(text.as_py()):
                held.update(words)
            if len(held) > HELD:
                yield passed_on()
                held = Counter()
    if held:
        yield passed_on()


@dataclass(frozen=True)
class Vocabulary:
    """Totals, the frequent words with their counts, and the classes with their tokens and words.

    Classes are START, END, the words of ``own`` and the endings, then the class of words with no listed ending.
    """

    tokens: int
    distinct: int
    counts: dict[bytes, int]
    own: tuple[bytes, ...]
    endings: tuple[str, ...]
    class_tokens: tuple[int, ...]
    class_words: tuple[int, ...]

    @property
    def size(self) -> int:
        return 3 + len(self.own) + len(self.endings)

    def classifier(self):
        """Function from an array of words and marks to their classes."""
        first = 2 + len(self.own)
        own = pa.array([START_MARK, END_MARK, *self.own], pa.large_binary())
        endings = pa.array(self.endings, pa.large_string())

        def classes(words: pa.Array | list[bytes]) -> np.ndarray:
            words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words
            found = [pc.index_in(words, value_set=own)]
            text = words.cast(pa.large_string())
            for n in (3, 2, 1):  # of a shorter word this is the whole, which the next turn looks for
                found.append(pc.add(pc.index_in(pc.utf8_slice_codeunits(text, -n), value_set=endings), first))
            return pc.coalesce(*found, pa.scalar(self.size - 1, pa.int32())).to_numpy()

        return classes


def _distinct(words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and for each word which of them it is."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, n) of all training tokens, the end as the empty word."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    short = counts.where((F.col("word") != "") & (F.octet_length("word") <= LONGEST))
    first_words = short.orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()
    own = tuple(r["word"].encode() for r in first_words)
    # a limit of FREQUENT would send as many rows of every partition to the driver; counts fall into at most 512 steps
    steps = short.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    # whole steps while they fit, then by hash as large a part of the next one as there is room for
    step, in_part = F.floor(F.log2("n") * 8), F.pmod(F.xxhash64("word"), F.lit(1 << 16))
    take, held = F.lit(False), 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        if held + row["words"] > FREQUENT:
            take = take | ((step == row["step"]) & (in_part < (FREQUENT - held) * (1 << 16) // row["words"]))
            break
        held += row["words"]
        take = F.col("n") >= row["least"]
    top = short.where(take).collect() if steps else []
    ranked = spark.createDataFrame([(w.decode(), True) for w in own], "word string, own boolean")
    rest = counts.where("word <> ''").join(F.broadcast(ranked), "word", "left").where("own IS NULL").drop("own")
    size = F.length("word")
    ends = F.array(*[F.when(size >= k, F.right("word", F.lit(k))) for k in (1, 2, 3)])
    endings = tuple(
        r["ending"] for r in rest.select(F.explode(F.array_compact(ends)).alias("ending"), "n").groupBy("ending").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()
    )
    first = 2 + len(own)
    places = spark.createDataFrame([(e, first + k) for k, e in enumerate(endings)], "ending string, k int")
    kinds = rest
    for n in (3, 2, 1):
        here = F.broadcast(places.select(F.col("ending").alias(f"e{n}"), F.col("k").alias(f"k{n}")))
        kinds = kinds.withColumn(f"e{n}", F.when(size >= n, F.right("word", F.lit(n)))).join(here, f"e{n}", "left")
    sums = {r["k"]: (r["n"], r["m"]) for r in kinds.groupBy(F.coalesce("k3", "k2", "k1", F.lit(first + len(endings))).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    fixed = [(0, 0), (total[2], 1)] + [(r["n"], 1) for r in first_words]
    by_class = fixed + [sums.get(k, (0, 0)) for k in range(first, first + len(endings) + 1)]
    return Vocabulary(
        total[0], total[1], {r["word"].encode(): r["n"] for r in top + first_words}, own, endings, tuple(n for n, _ in by_class), tuple(m for _, m in by_class)
    )


class Parameters:
    """Input and output vectors of the classes, a matrix per place of the context, and a bias per class."""

    NAMES = ("inputs", "outputs", "places", "bias")

    def __init__(self, inputs: np.ndarray, outputs: np.ndarray, places: np.ndarray, bias: np.ndarray) -> None:
        self.inputs, self.outputs, self.places, self.bias = inputs, outputs, places, bias

    @classmethod
    def fresh(cls, vocab: Vocabulary) -> Parameters:
        draw = np.random.default_rng(7)
        freq = (np.array(vocab.class_tokens, np.float64) + EXTRA) / (vocab.tokens + EXTRA * vocab.size)
        places = np.stack([np.eye(SIZE) * 0.5 + draw.normal(0, 0.02, (SIZE, SIZE)) for _ in range(CONTEXT)])
        arrays = draw.normal(0, 0.2, (vocab.size, SIZE)), draw.normal(0, 0.2, (vocab.size, SIZE)), places, np.log(freq)[:, None]
        return cls(*[a.astype(np.float32) for a in arrays])

    def rows(self) -> np.ndarray:
        """All parameters as rows of SIZE; the bias fills up its last row with zeros."""
        bias = np.zeros(-(-len(self.bias) // SIZE) * SIZE, np.float32)
        bias[: len(self.bias)] = self.bias[:, 0]
        return np.concatenate([self.inputs, self.outputs, self.places.reshape(-1, SIZE), bias.reshape(-1, SIZE)])

    @classmethod
    def of_rows(cls, rows: np.ndarray, classes: int) -> Parameters:
        inputs, outputs, places, bias = np.split(rows.astype(np.float32), [classes, 2 * classes, 2 * classes + CONTEXT * SIZE])
        return cls(inputs.copy(), outputs.copy(), places.reshape(CONTEXT, SIZE, SIZE).copy(), bias.reshape(-1)[:classes, None].copy())

    def predicted(self, tokens: np.ndarray) -> np.ndarray:
        """For each token from the CONTEXT-th on, the vector that those before it add up to."""
        seen = self.inputs.take(tokens, 0)
        return sum(seen[CONTEXT - 1 - i : len(tokens) - 1 - i] @ self.places[i] for i in range(CONTEXT))

    def log10_classes(self, tokens: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each token's class from the CONTEXT-th on; 0 for START, which is never predicted."""
        out = np.empty(len(tokens) - CONTEXT)
        for start in range(0, len(out), BLOCK):
            part = tokens[start : start + BLOCK + CONTEXT]
            scores = self.predicted(part) @ self.outputs.T
            scores += self.bias[:, 0]
            scores -= scores.max(1, keepdims=True)
            here = scores[np.arange(len(scores)), part[CONTEXT:]].astype(np.float64)
            np.exp(scores, out=scores)
            scores[:, START] = 0
            out[start : start + len(scores)] = here - np.log(scores.sum(1))
        out[tokens[CONTEXT:] == START] = 0
        return out / math.log(10)


class Normaliser:
    """The same probabilities from tables of the powers of both halves of the context, whose products are those of the whole."""

    #: Products below this have lost digits; such tokens are computed without tables.
    LEAST = 1e-25

    def __init__(self, p: Parameters) -> None:
        self.p, self.size = p, len(p.bias)
        half, self.powers = CONTEXT // 2, []
        for first in range(0, CONTEXT, half):
            scores = np.zeros((1, self.size), np.float32)
            for i in range(first, first + half):  # rows are numbered by the tokens before, the last one first
                scores = (scores[:, None] + (p.inputs @ p.places[i] @ p.outputs.T)[None]).reshape(-1, self.size)
            if first == 0:
                scores += p.bias[:, 0]
            scores -= scores.max(1, keepdims=True)
            np.exp(scores, out=scores)
            scores[:, START] = 0
            self.powers.append(scores)

    def log10_classes(self, tokens: np.ndarray) -> np.ndarray:
        """As ``Parameters.log10_classes``."""
        n, half, target = len(tokens) - CONTEXT, CONTEXT // 2, tokens[CONTEXT:]
        rows = []
        for first in range(0, CONTEXT, half):
            number = np.zeros(n, np.int64)
            for i in range(first, first + half):
                number = number * self.size + tokens[CONTEXT - 1 - i : len(tokens) - 1 - i]
            rows.append(number)
        here = self.powers[0][rows[0], target] * self.powers[1][rows[1], target]
        total = np.empty(n, np.float32)
        for start in range(0, n, BLOCK):
            at = slice(start, start + BLOCK)
            np.einsum("ij,ij->i", self.powers[0].take(rows[0][at], 0), self.powers[1].take(rows[1][at], 0), out=total[at])
        sure = (here > self.LEAST) & (target != START)
        out = np.zeros(n)
        out[sure] = np.log10(here[sure].astype(np.float64) / total[sure])
        rest = np.flatnonzero(~sure & (target != START))
        if len(rest):
            alone = tokens[rest[:, None] + np.arange(CONTEXT + 1)]  # each with its context
            out[rest] = self.p.log10_classes(alone.reshape(-1))[:: CONTEXT + 1]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Steps of noise-contrastive estimation with a step length per row that shrinks with its gradients."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int) -> None:
        self.p = Parameters(*[getattr(start, n).copy() for n in Parameters.NAMES])
        self.past = {n: np.full(getattr(start, n).shape, 1e-3, np.float32) for n in Parameters.NAMES}
        self.noise, self.log_noise, self.draw = np.cumsum(noise), np.log(np.maximum(noise, 1e-12) * NOISE).astype(np.float32), np.random.default_rng(seed)

    def _move(self, name: str, rows, gradient: np.ndarray) -> None:
        past, value = self.past[name], getattr(self.p, name)
        past[rows] += gradient * gradient
        value[rows] -= RATE * gradient / np.sqrt(past[rows])

    def step(self, tokens: np.ndarray) -> None:
        """Tokens of whole texts, each after CONTEXT starts; starts are context only."""
        p, target = self.p, tokens[CONTEXT:]
        real = (target != START).astype(np.float32)
        r = p.predicted(tokens)
        false = np.minimum(np.searchsorted(self.noise, self.draw.random(NOISE) * self.noise[-1]), len(self.noise) - 1)
        # probability that a class comes from the text and not from the noise
        wanted = p.outputs.take(target, 0)
        up = np.einsum("ij,ij->i", r, wanted) + p.bias[target, 0] - self.log_noise[target]
        down = r @ p.outputs[false].T + p.bias[false, 0] - self.log_noise[false]
        share = real / np.float32(len(target))
        d_up = (_sigmoid(up) - 1) * share
        d_down = _sigmoid(down) * share[:, None]
        d_r = d_up[:, None] * wanted + d_down @ p.outputs[false]
        seen = p.inputs.take(tokens, 0)
        d_places, d_seen = [], np.zeros_like(seen)
        for i in range(CONTEXT):
            at = slice(CONTEXT - 1 - i, len(tokens) - 1 - i)
            d_places.append(seen[at].T @ d_r)
            d_seen[at] += d_r @ p.places[i].T
        order = np.argsort(tokens.astype(np.int16), kind="stable")
        ordered = tokens[order]
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        classes = ordered[cut]
        d_out = np.zeros((len(tokens), SIZE + 1), np.float32)
        d_out[CONTEXT:, :SIZE] = d_up[:, None] * r
        d_out[CONTEXT:, SIZE] = d_up
        by_class = np.zeros((len(p.bias), SIZE + 1), np.float32)
        by_class[classes] = np.add.reduceat(d_out.take(order, 0), cut)
        np.add.at(by_class, false, np.concatenate([d_down.T @ r, d_down.sum(0)[:, None]], 1))
        self._move("inputs", classes, np.add.reduceat(d_seen.take(order, 0), cut))
        moved = np.flatnonzero(by_class.any(1))
        self._move("outputs", moved, by_class[moved, :SIZE])
        self._move("bias", moved, by_class[moved, SIZE:])
        self._move("places", slice(None), np.stack(d_places))


def _train_round(docs: DataFrame, vocab: Vocabulary, start: Parameters, seed: int) -> Parameters:
    """Parameters after every task has trained on its rows, averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab.own, vocab.endings, vocab.class_tokens, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, endings, class_tokens, first = shared.value
        classes = Vocabulary(0, 0, {}, own, endings, class_tokens, ()).classifier()
        noise = np.array(class_tokens, np.float64)
        noise[START] = 0
        trainer = Trainer(first, noise / max(noise.sum(), 1), seed)
        held, size, pending, tokens = [], 0, np.full(CONTEXT, START), 0

        def trained() -> None:
            """Steps over all held words that fill one."""
            nonlocal held, size, pending, tokens
            distinct, at = _distinct(held)
            pending = np.concatenate([pending, classes(distinct)[at]])
            held, size, start = [], 0, 0
            while len(pending) - start >= STEP + CONTEXT:
                trainer.step(pending[start : start + STEP + CONTEXT])
                start += STEP
            tokens, pending = tokens + start, pending[start:]

        for batch in batches:
            for text in batch.column(0):
                whole = text.as_py()
                size += len(whole)
                for words in _blocks(whole):
                    held += words
                    if len(held) > TOGETHER:  # within a long text
                        trained()
                held += [END_MARK] + [START_MARK] * CONTEXT
                if size > TOGETHER_BYTES:
                    trained()
        if held:
            trained()
        if len(pending) > CONTEXT:
            trainer.step(pending)
            tokens += len(pending) - CONTEXT
        if tokens:
            rows = trainer.p.rows().astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([tokens] * len(rows), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "n", "v"])

    parts = docs.select(_texts(docs)).mapInArrow(run, "i int, n long, v array<double>")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("v")[j]) for j in range(SIZE)]).alias("v")).collect()
    shared.unpersist()
    if not found:
        return start
    rows = np.zeros((len(found), SIZE))
    for row in found:
        rows[row["i"]] = np.array(row["v"]) / row["n"]
    return Parameters.of_rows(rows, vocab.size)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    parameters: Parameters
    #: Table (word, n) of all training tokens.
    counts: DataFrame


def learn(docs: DataFrame) -> Model:
    """Counts and parameters from all rows of a table."""
    small_batches(docs.sparkSession)
    counts = stored(docs.select(_texts(docs)).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), f"{scratch(docs.sparkSession)}/words")
    vocab = vocabulary(counts)
    parameters = Parameters.fresh(vocab)
    share = F.pmod(F.xxhash64("text"), F.lit(sum(ROUNDS)))
    done = 0
    for k, width in enumerate(ROUNDS):
        part = docs.where((F.coalesce(share, F.lit(0)) >= done) & (F.coalesce(share, F.lit(0)) < done + width))
        parameters = _train_round(part, vocab, parameters, seed=k)
        done += width
    return Model(vocab, parameters, counts)


_SCORED = "row long, tokens long, known long, base double, score double, rest array<struct<word: string, n: long>>"


class _Scores:
    """Of the rows of one batch: tokens, known ones, base, score, and the words whose counts are still to come."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.sums = np.zeros((4, n))
        self.rest: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def add(self, row: np.ndarray, values: tuple[np.ndarray, ...], rare: np.ndarray, distinct: pa.Array, at: np.ndarray) -> None:
        """For tokens in these rows their values; of the rare ones, the words are kept with their counts."""
        for total, value in zip(self.sums, values):
            total += np.bincount(row, value, self.n)
        pair, count = np.unique(row[rare] * len(distinct) + at[rare], return_counts=True)
        self.rest.append((pair // len(distinct), distinct.take(pa.array(pair % len(distinct))), count))

    def batch(self, rows: pa.Array, base_all: float) -> pa.RecordBatch:
        row, count = (np.concatenate([r[k] for r in self.rest]) for k in (0, 2))
        order = np.argsort(row, kind="stable")
        words = pa.concat_arrays([r[1] for r in self.rest]).take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.n))])
        rest = pa.StructArray.from_arrays([words, pa.array(count[order].astype(np.int64))], names=["word", "n"])
        n, known, base, score = self.sums
        return pa.RecordBatch.from_arrays(
            [rows, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base - n * base_all), pa.array(score),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)],
            names=["row", "tokens", "known", "base", "score", "rest"],
        )


def _score_rows(shared):
    """Per row: tokens, and what can be said without the counts of rarer words, which are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        classes, model = vocab.classifier(), Normaliser(p)
        end_count = vocab.class_tokens[END]
        log_count = {word: math.log10(n + EXTRA) for word, n in vocab.counts.items()} | {START_MARK: 0.0, END_MARK: math.log10(end_count + EXTRA)}
        base_all = math.log10(vocab.tokens + EXTRA * (vocab.distinct + 1))
        words_of = np.array(vocab.class_words, np.float64)
        log_class = np.log10(np.array(vocab.class_tokens) + EXTRA * (words_of + 1))
        alone = 2 + len(vocab.own)  # classes below this hold one token: its share is 1
        for batch in batches:
            if not batch.num_rows:
                continue
            out = _Scores(batch.num_rows)
            held, lengths, size, before = [], [], 0, np.full(CONTEXT, START)

            def scored() -> None:
                """Adds up the held words; lengths tells how many are of which row."""
                nonlocal held, lengths, size, before
                distinct, at = _distinct(held)
                kinds = classes(distinct)
                target = kinds[at]
                logs = np.array([log_count.get(word, math.nan) for word in distinct.to_pylist()])[at]
                rare, token = np.isnan(logs), target != START
                logs[rare] = 0
                tokens = np.concatenate([before, target])
                values = model.log10_classes(tokens) + np.where(target >= alone, logs - log_class[target], 0.0)
                known = token & ~rare if end_count else token & ~rare & (target != END)
                row = np.repeat([i for i, _ in lengths], [n for _, n in lengths])
                out.add(row, (token, known, logs, np.where(token, values, 0.0)), rare, distinct, at)
                held, lengths, size, before = [], [], 0, tokens[-CONTEXT:]

            for i, text in enumerate(batch.column("text")):
                whole = text.as_py()
                size += len(whole)
                mine = len(held)
                for words in _blocks(whole):
                    held += words
                    if len(held) > TOGETHER:  # within a long text
                        lengths.append((i, len(held) - mine))
                        scored()
                        mine = 0
                held += [END_MARK] + [START_MARK] * CONTEXT
                lengths.append((i, len(held) - mine))
                if size > TOGETHER_BYTES:
                    scored()
            if held:
                scored()
            yield out.batch(batch.column("row"), base_all)

    return run


def scored(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 500)
    top = scratch(spark)
    # rows are numbered where they are read and written with their numbers, which later steps rely on
    shared = spark.sparkContext.broadcast((model.vocabulary, model.parameters))
    name = f"{key}_"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias(name), _texts(docs))
    kind = docs.schema[key].dataType.simpleString()
    inner = _score_rows(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in inner(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column(name), *out.columns], names=["key", *out.schema.names])

    parts = stored(numbered.mapInArrow(run, f"`key` {kind}, {_SCORED}"), f"{top}/parts", compression="zstd")
    rare = parts.select("row", F.inline("rest")).join(model.counts.withColumnRenamed("n", "c"), "word", "left")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + F.lit(EXTRA))
    more = rare.select("row", (F.col("n") * log_count).alias("logs"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("more"))
    added = more.groupBy("row").agg(F.sum("logs").alias("logs"), F.sum("more").alias("more"))
    logs = F.coalesce("logs", F.lit(0.0))
    return parts.drop("rest").join(added, "row", "left").select(
        F.col("key").alias(key), held_out("key").alias("held_out"), F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def document_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return scored(docs, learn(docs.where(~held_out())))
