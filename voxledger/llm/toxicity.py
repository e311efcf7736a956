"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguise: compatibility forms, look-alike letters of other
scripts, digits and signs between letters that stand for letters, and letters
drawn apart by single dots, dashes or stars.  Entries are whole words or
beginnings of words; which ones, and their weights, is learned from labelled
documents: an entry's weight is the log odds of the documents that hold it, and
an entry is dropped where a shorter beginning says the same.  A text scores by
the weights it holds, with exception phrases taken out first, against its
length, on a curve fitted to the same labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import let, scratch, small_batches, stored

#: Labelled documents that the lexicon is learned from, at most; taken in hash order.
MAX_LABELLED = 10_000
#: An entry stands beside so many different words in the toxic documents of the sample (one passage that
#: is copied often has the same neighbours everywhere), and in this share of these documents.
LEAST_CONTEXTS = 5
LEAST_SHARE = 0.004
#: Log odds from which a beginning or word is an entry.
LEAST_WEIGHT = 3.5
#: A longer beginning replaces a shorter one that is in at most so much more documents.
SAME = 0.95
#: Load from which a text scores no higher.
FULL_LOAD = 4.0
SHORTEST, LONGEST = 4, 8
PREDICT_AT = 0.3
#: Phrases that hold an entry in a harmless sense.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "idiot proof", "clown fish", "stupid simple", "pond scum")

#: Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
     "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "ε": "e",
     "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ι": "i", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l"}
)
#: Digits and signs written for letters.
_DIGITS = str.maketrans("013457@$!", "oieastasi")
_OTHER_SCRIPT = re.compile("[ıɑɡͰ-ӿԁԛԝһⅼ]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_PART = re.compile(r"[\w@$!]+")
_APART = re.compile(r"[^\W\d_](?:[.\-*_·][^\W\d_]){2,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = "@$!"


@lru_cache(maxsize=100_000)
def _untangled(token: str) -> tuple[str, ...]:
    """Words in a token that is not letters only.

    Letters drawn apart are joined; digits and signs beside letters become
    letters, but signs at the end of a run stay signs.
    """
    if m := _APART.fullmatch(token.strip(".,;:!?%&#$")):
        return ("".join(_LETTERS.findall(m[0])),)
    out: list[str] = []
    for part in _PART.findall(token):
        core = part.rstrip(_SIGNS)
        out += [core] if core.isalpha() else _LETTERS.findall(core.translate(_DIGITS) if _LETTERS.search(core) else core)
    return tuple(out)


def folded(text: str | None) -> str:
    """Lower-case words of the text, each between single spaces, disguise undone; accents stay."""
    t = (text or "").lower()
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t).lower()
        if _OTHER_SCRIPT.search(t):
            t = t.translate(_LOOK_ALIKE)
    words: list[str] = []
    for w in t.split():
        if w.isalpha():
            words.append(w)
        else:
            words.extend(_untangled(w))
    return f" {' '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries (" word " or " beginning") with weights, and the curve: score = 1 / (1 + exp(-(bias + slope * load)))."""

    weights: dict[str, float]
    bias: float = -3.0
    slope: float = 3.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry, weight in sorted(self.weights.items()):
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def score(self, load: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * min(load, FULL_LOAD)))))


def load(automaton: ahocorasick.Automaton, text: str) -> float:
    """Summed weights of the words of a folded text that hold an entry, the heaviest of each, against its length.

    The divisor is 1 plus the decimal logarithm of the hundreds of words, so one
    entry still counts in a long text.
    """
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, weight))
    total = sum(w for s, w in hits.items() if not any(a <= s < b for a, b in spared))
    return total / (1.0 + math.log10(1.0 + text.count(" ") / 100.0))


def _fold_column(docs: DataFrame, extra: list[str]) -> DataFrame:
    """extra columns and folded, the folded text."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([folded(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.record_batch([*[b.column(c) for c in extra], text], [*extra, "folded"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", folded string"
    return docs.select(*extra, "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Lexicon from labelled documents that are not held out, at most max_labelled of them.

    Of several labels of a document the highest holds; null ids and labels are
    left out.  Without toxic examples the lexicon is empty and all texts score
    alike.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    texts = stored(_fold_column(sample, ["toxic"]), scratch(docs.sparkSession))
    counts = {r["toxic"] == 1: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic:
        return Lexicon({})

    def beginnings(word: Column) -> Column:
        whole = F.array(F.concat(F.lit(" "), word, F.lit(" ")))
        starts = F.transform(
            F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length(word)))),
            lambda n: F.concat(F.lit(" "), F.substr(word, F.lit(1), n)),
        )
        return F.when(F.length(word) >= SHORTEST, F.concat(starts, whole)).otherwise(whole)

    tokens = F.split(F.trim("folded"), " ")

    def documents_with(own: DataFrame) -> DataFrame:
        """(entry) once for every document that holds it."""
        return own.select(F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(tokens), beginnings)))).alias("entry"))

    def in_context(w: Column, i: Column) -> Column:
        beside = F.xxhash64(F.get(w, i - 1), F.get(w, i + 1))
        return F.transform(beginnings(w[i]), lambda e: F.struct(e.alias("entry"), beside.alias("beside")))

    bad, good = texts.where(F.col("toxic") == 1), texts.where(F.col("toxic") != 1)
    least = max(2, math.ceil(LEAST_SHARE * n_toxic))
    often = documents_with(bad).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    places = bad.select(F.explode(let(tokens, lambda w: F.flatten(F.transform(w, lambda x, i: in_context(w, i))))).alias("p"))
    varied = (
        places.select("p.*").groupBy("entry", "beside").agg(F.lit(1).alias("one"))
        .groupBy("entry").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    )
    toxic = {r["entry"]: r["n"] for r in often.join(varied, "entry").collect()}
    if not toxic:
        return Lexicon({})
    spark = docs.sparkSession
    some = spark.createDataFrame([(e,) for e in sorted(toxic)], "entry string")
    among = documents_with(good).join(F.broadcast(some), "entry")
    clean = {r["entry"]: r["n"] for r in among.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).collect()}

    def log_odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (2 * n_toxic - a + 0.5)) - math.log((b + 0.5) / (2 * n_clean - b + 0.5))

    def odds(entry: str) -> float:
        return log_odds(toxic[entry], clean.get(entry, 0))

    def alone(entry: str) -> bool:
        """The entry tells something even without the documents of its best extension."""
        best = max((e for e in toxic if e != entry and e.startswith(entry)), key=odds, default=None)
        if best is None or odds(best) < odds(entry) + 0.5:
            return True
        a, b = toxic[entry] - toxic[best], clean.get(entry, 0) - clean.get(best, 0)
        return a >= least and log_odds(a, b) >= LEAST_WEIGHT

    def longer(entry: str) -> bool:
        """A longer beginning stands in nearly the same documents."""
        return any(len(e) == len(entry) + 1 and e[-1] != " " and e.startswith(entry) and n >= SAME * toxic[entry] for e, n in toxic.items())

    weights: dict[str, float] = {}
    for entry in sorted((e for e in toxic if odds(e) >= LEAST_WEIGHT), key=lambda e: (len(e.strip()), e)):
        shorter = [weights[entry[:n]] for n in range(SHORTEST + 1, len(entry)) if entry[:n] in weights]
        if not longer(entry) and alone(entry) and not (shorter and max(shorter) >= 0.8 * odds(entry)):
            weights[entry] = odds(entry)
    return _fitted(Lexicon(weights), texts)


def _loads(texts: DataFrame, lexicon: Lexicon, extra: list[str]) -> DataFrame:
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            out = pa.array([load(automaton, t) for t in b.column("folded").to_pylist()], pa.float64())
            yield pa.record_batch([*[b.column(c) for c in extra], out], [*extra, "load"])

    return texts.select(*extra, "folded").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in extra) + ", load double")


def _fitted(lexicon: Lexicon, texts: DataFrame) -> Lexicon:
    """The lexicon with the curve that fits the labels of texts best: Newton steps on counts of rounded loads."""
    load_ = F.least(F.round("load", 1), F.lit(FULL_LOAD))
    rows = _loads(texts, lexicon, ["toxic"]).groupBy(load_.alias("x"), (F.col("toxic") == 1).alias("y")).count().collect()
    data = sorted((r["x"], 1.0 if r["y"] else 0.0, r["count"]) for r in rows)
    a, b = -2.0, 1.0
    for _ in range(50):
        g0, g1, h00, h01, h11 = a, b, 1.0, 0.0, 1.0  # a weak pull towards 0
        for x, y, n in data:
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = n * p * (1.0 - p)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det < 1e-9:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return Lexicon(lexicon.weights, a, max(b, 0.0), lexicon.exceptions)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs (doc_id, text).

    Null and empty texts hold nothing and get the lowest score of the curve.  A
    row without doc_id is not held out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            s = pa.array([lexicon.score(load(automaton, folded(t))) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.record_batch([b.column("doc_id"), s], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return d.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )
