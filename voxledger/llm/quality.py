"""Quality rules as a learned decision list.

Statistics of a text are plain expressions.  From labelled statistics, rules
"this text is bad" are learned by sequential covering: a rule grows, condition
by condition, by information gain on two thirds of the examples, loses its last
conditions where that helps on the other third, and takes the examples it
covers out of the game.  The list becomes one ordered Spark expression,
when(rule 1).when(rule 2)...otherwise(keep), so it runs over any number of rows
without Python.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import SPACE_CHARS, let, packed, unpacked, words

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = ["n_upper", "n_digits", "n_marks", "n_short", "n_stops"]
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Labelled rows that the rules are learned from, at most; taken in hash order.
MAX_LABELLED = 5_000

#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on as with be by this are from at or an not have which but his they "
    "der die das und ist von den mit zu nicht ein eine im dem des sich auf für auch "
    "le la les de des un une et est que qui dans pour par sur pas au avec "
    "el los las del y en se su con para una no lo como más"
).split()


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in w (an array).

    Windows are sorted by their hash, so equal ones are neighbours; the starts
    of repeated ones, sorted again, cover min(3, distance to the next) words
    each.  Most texts repeat no window and stop at the count of distinct hashes.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def repeated(s: Column) -> Column:
        same = lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h)
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.i))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, g: a + g)

    def count(v: Column) -> Column:
        numbered = F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        slow = let(F.sort_array(numbered), lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(v)) < F.size(v), slow).otherwise(F.lit(0).cast("long"))

    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))
    return F.when(F.size(w) >= 4, hashed).otherwise(F.lit(0).cast("long"))


def _statistic(name: str, t: Column, w: Column) -> Column:
    """One statistic of a text t with the words w."""
    plain = lambda x: F.lower(F.regexp_replace(x, f"[.,;:!?{SYMBOLS}]+", ""))
    has_word = lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "n_words": lambda: F.size(w),
        "word_chars": lambda: F.length(t) - count(r"[ \t-\r]"),
        "n_symbols": lambda: count(f"[{SYMBOLS}]"),
        "n_dup_lines": lambda: let(F.filter(F.split(t, "\n"), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": lambda: _repeat_words(w),
        "n_upper": lambda: count(r"\p{Lu}"),
        "n_digits": lambda: count("[0-9]"),
        "n_marks": lambda: count("[!?]"),
        "n_short": lambda: F.size(F.filter(w, lambda x: F.length(x) <= 2)),
        "n_stops": lambda: F.size(F.filter(w, lambda x: plain(x).isin(STOP_WORDS))),
    }[name]().cast("long").alias(name)


def with_statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the named statistics of text.

    A null text counts as an empty one; all its statistics are 0.
    """
    row, keep = packed(docs, names)
    d = docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    stats = let(words(F.col("_text")), lambda w: F.struct(*[_statistic(n, F.col("_text"), w) for n in names]))
    return d.select("_row", stats.alias("_s")).select(*unpacked(keep), *[F.col(f"_s.{n}").alias(n) for n in names])


def base_failed(get=F.col) -> Column:
    """get gives the column of a statistic by its name, here and below."""
    return (get("n_words") < MIN_WORDS) | (get("n_repeat_words") * 100 > get("n_words") * MAX_REPEAT_PCT)


#: What rules may test: one count per hundred of another.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "short_words": ("n_short", "n_words"),
    "stop_words": ("n_stops", "n_words"),
}


def ratio(name: str, get=F.col) -> Column:
    top, below = RATIOS[name]
    return get(top) * 100.0 / F.greatest(get(below), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, get=F.col) -> Column:
        x = ratio(self.feature, get)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _fires(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _cuts(values: list[float], most: int) -> list[float]:
    """Thresholds between neighbouring quantiles."""
    v = sorted(values)
    at = sorted({v[i * (len(v) - 1) // most] for i in range(most + 1)})
    return [(a + b) / 2 for a, b in zip(at, at[1:], strict=False)]


def _grow(bad: list[dict], good: list[dict], cuts: dict[str, list[float]], longest: int) -> Rule:
    """Add the condition of the highest gain until no good example is covered."""
    rule: list[Condition] = []
    while bad and good and len(rule) < longest:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, gain = None, 1e-9
        for name, at in cuts.items():
            p, n = [0] * (len(at) + 1), [0] * (len(at) + 1)
            for rows, hist in ((bad, p), (good, n)):
                for r in rows:
                    hist[bisect_left(at, r[name])] += 1
            low_p = low_n = 0
            for i, t in enumerate(at):
                low_p, low_n = low_p + p[i], low_n + n[i]
                for above, a, b in ((False, low_p, low_n), (True, len(bad) - low_p, len(good) - low_n)):
                    if a and (g := a * (math.log2(a / (a + b)) - before)) > gain:
                        best, gain = Condition(name, above, t), g
        if best is None:
            break
        rule.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return tuple(rule)


def _pruned(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """The beginning of the rule that scores best on examples it was not grown on."""

    def score(k: int) -> float:
        p, n = sum(_fires(rule[:k], r) for r in bad), sum(_fires(rule[:k], r) for r in good)
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (score(k), -k))] if rule else rule


def learn_rules(
    examples: list[dict], *, most_rules: int = 8, longest: int = 3, precision: float = 0.9, least: int = 4, cuts: int = 64
) -> list[Rule]:
    """Decision list from examples: dicts of RATIOS with "bad" (bool) and "fold" (0 to 2; 2 prunes).

    A rule is kept if, on the pruning examples, at least `precision` of what it
    rejects is bad and it rejects `least` bad examples in all.
    """
    if not examples:
        return []
    left = examples
    at = {name: _cuts([r[name] for r in examples], cuts) for name in RATIOS}
    rules: list[Rule] = []
    while len(rules) < most_rules:
        part = {(b, p): [r for r in left if r["bad"] == b and (r["fold"] == 2) == p] for b in (True, False) for p in (True, False)}
        rule = _pruned(_grow(part[True, False], part[False, False], at, longest), part[True, True], part[False, True])
        if not rule:
            break
        hit = [r for r in left if _fires(rule, r)]
        p, n = (sum(_fires(rule, r) for r in part[b, True]) for b in (True, False))
        if sum(r["bad"] for r in hit) < least or p < precision * (p + n) or not p:
            break
        rules.append(rule)
        left = [r for r in left if not _fires(rule, r)]
    return rules


def verdict(rules: list[Rule], get=F.col) -> Column:
    """True (keep) unless a rule of the list fires; the first that does decides."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        cond = rule[0].column(get)
        for c in rule[1:]:
            cond = cond & c.column(get)
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from labelled documents that pass the base rules.

    Learned from at most max_labelled labelled documents, the first by hash of
    their id, so the small table sent to the tasks and the statistics fetched
    are bounded.  Documents without label, labels without document, and null
    ids or labels play no part; of several labels of a document the lowest holds.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    d = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = with_statistics(d, BASE + COUNTS).select(
        (F.col("_quality") == 0).alias("bad"),
        base_failed().alias("failed"),
        F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)).alias("fold"),
        *[ratio(n).alias(n) for n in RATIOS],
    ).collect()
    examples = [r.asDict() for r in rows if not r["failed"]]
    return learn_rules(sorted(examples, key=lambda r: sorted(r.items())))


def _needed(rules: list[Rule]) -> list[str]:
    used = {n for rule in rules for c in rule for n in RATIOS[c.feature]}
    return [*BASE, *[n for n in COUNTS if n in used]]


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the base statistics, base_failed and kept."""
    row, keep = packed(docs, [*BASE, *COUNTS, "base_failed", "kept"])
    d = with_statistics(docs.select(row, F.col("text")), _needed(rules))
    d = d.withColumn("base_failed", base_failed())
    return d.select(*unpacked(keep), *BASE, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def passing(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that judged() keeps, as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = _needed(rules)

    def keeps(s: Column) -> Column:
        return ~base_failed(s.getField) & verdict(rules, s.getField)

    # one expression, so that the statistics are computed once where the filter runs
    return docs.where(let(words(text), lambda w: let(F.struct(*[_statistic(n, text, w) for n in names]), keeps)))
