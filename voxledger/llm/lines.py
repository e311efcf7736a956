"""Line dedup by log templates: lines that recur across documents as a template are dropped.

A fixed-depth tree parses lines: first by the number of words, then by the first
DEPTH words (with digits, addresses and links taken for a field <*>).  After the
first word, words that fewer than min_docs documents have at their node go to a
wildcard child together.  In a leaf, a word is constant at its place if at least
min_docs documents have it there; any other is a field.  What remains of a line
is its template; if at least half of its words are constant and the template
stands in min_docs documents or more, it is boilerplate, and every line of it is
dropped.

In a large corpus each value of a field stands in min_docs documents, so lines
have a second template, of the words that at least USUAL of the documents of the
leaf have at their place.  For it, and in leaves below a wildcard, at least half
of the words after the first DEPTH must be constant too, so that prose with a
common beginning is no boilerplate.

Lines travel as hashes, in a table in the shared folder, until it is known which
leaves recur; their texts follow only once for each distinct line and task.  Counts are combined before they are
shuffled, so a line in a third of all documents is one row per task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.work import (
    SPACE_CHARS, SPACES, bitmap_by, bitmap_of, drop_folder, drop_shuffles, maybe_flag, maybe_has, maybe_in, scratch, stored, with_bits,
)

FIELD = "<*>"
#: A word with a digit or an @, or a link; tried at the beginnings of words only, without backtracking.
VARIABLE = r"(?<![^ \t-\r])(?:[^ \t-\r0-9@]*+[0-9@]|[A-Za-z]++://)[^ \t-\r]*+"
DEPTH = 3
MIN_DOCS = 10
CONSTANT_SHARE = 0.5
#: Share of the documents of a leaf from which a word is usual at its place.
USUAL = 0.2
#: Words from which a line is paired off; pairs hold for a CONSTANT_SHARE of half or more.
LEAST_PAIRED = 4
#: Bits that a dropped line has in the bitmap of places.
PLACE_BITS = 4


def _text_lines(docs: DataFrame) -> DataFrame:
    """(text_hash, at, plain, line): the lines with words of every text, variable words masked, trimmed.

    Whole texts are tested at once for what few of them hold: words that may vary, and white space other than
    single spaces and line ends; lines of the others (plain) need no regular expression.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    # bytes are sought faster than by a regular expression
    has = lambda x, marks: reduce(or_, [x.contains(m) for m in marks])
    may_vary = lambda x: has(x, [*"0123456789@", "://"])
    plain = ~(has(t, [*"\t\x0b\f\r", "  ", " \n", "\n "]) | t.startswith(" ") | t.endswith(" "))
    # in one select with the generator, what concerns the whole text would be computed once for each line
    texts = docs.select(_text_hash().alias("text_hash"), plain.alias("plain"), may_vary(t).alias("varies"), F.split(t, "\n").alias("lines"))
    # posexplode_outer: a plain posexplode is planned with a test for empty arrays, which parses all texts twice
    rows = texts.select("text_hash", "plain", "varies", F.posexplode_outer("lines").alias("at", "x"))
    x = F.col("x")
    masked = F.when(F.col("varies") & may_vary(x), F.regexp_replace(x, VARIABLE, FIELD)).otherwise(x)
    line = F.when(F.col("plain"), masked).otherwise(F.btrim(masked, F.lit(SPACE_CHARS)))
    return rows.select("text_hash", "at", "plain", line.alias("line")).where(F.col("line") != "")


def _key(line: Column) -> Column:
    return F.xxhash64(line, F.xxhash64(F.lit(5), line))


def _spaces(line: Column) -> Column:
    """Number of spaces of a line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """(text_hash, at, line, leaf, next1, ...): the lines with words of every text, as hashes.

    leaf and the columns after it are the path in the tree: the number of words with the first of them, then the others up to DEPTH.
    """
    line = F.col("line")
    head = F.when(F.col("plain"), F.split(F.substring_index(line, " ", DEPTH), " ")).otherwise(F.split(line, SPACES, DEPTH + 1))
    count = F.when(F.col("plain"), _spaces(line)).otherwise(F.regexp_count(line, F.lit(SPACES)))
    own = _text_lines(docs).select("text_hash", "at", _key(line).alias("line"), count.alias("count"), head.alias("head"))
    later = [F.xxhash64(F.get("head", F.lit(k))).alias(f"next{k}") for k in range(1, DEPTH)]
    return own.select("text_hash", "at", "line", F.xxhash64("count", F.get("head", F.lit(0))).alias("leaf"), *later)


def _pairs(lines: DataFrame) -> DataFrame:
    """(key, n, pair): of every line, about half as many pairs of its words as it has words, hashed with their leaf and places.

    If at least half of the places are constant, both words of one of these pairs are: neighbours are paired off, and the
    pairs beyond them are for one constant word in each.  Below a wildcard the words after the first DEPTH count, else all.
    Lines with fewer than four such words have no pair.
    """
    start = F.when(F.col("wild"), F.lit(DEPTH)).otherwise(F.lit(0))
    many = F.col("many")
    d = lines.select("key", "n", "leaf", F.split("line", " ").alias("w"), start.alias("start"), (F.col("size") - start).alias("many"))
    d = d.where(many >= LEAST_PAIRED).withColumn("half", F.floor(many / 2).cast("int"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("half") + F.when(many % 2 == 0, 3).otherwise(1))).alias("i"))
    i, half, extra = F.col("i"), F.col("half"), F.col("i") - F.col("half")
    odd = many % 2 == 1
    a = F.when(i < half, 2 * i).when(odd, many - 1).otherwise(F.call_function("shiftright", extra, F.lit(1)))
    b = F.when(i < half, 2 * i + 1).when(odd, many - 2 - extra).otherwise(2 + extra % 2)
    d = d.select("key", "n", "leaf", "i", F.get("w", F.col("start") + a).alias("a"), F.get("w", F.col("start") + b).alias("b"))
    return d.where((F.col("a") != FIELD) & (F.col("b") != FIELD)).select("key", "n", F.hash("leaf", "i", "a", "b").alias("pair"))


def recurring_lines(docs: DataFrame, table: DataFrame, folder: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line): hashes of lines of docs whose template recurs, written to folder; table is line_table(docs)."""
    spark = docs.sparkSession
    folders = []

    def kept_as(d: DataFrame, **options: str) -> DataFrame:
        folders.append(scratch(spark))
        return stored(d, folders[-1], **options)

    later = [f"next{k}" for k in range(1, DEPTH)]
    lines = table.select(F.col("line").alias("key"), "leaf", *later, "text_hash")
    counted = lines.distinct().groupBy("key", "leaf", *later).agg(F.count(F.lit(1)).alias("n")).withColumn("wild", F.lit(False))

    def often_in(d: DataFrame, *by: str) -> DataFrame:
        return d.groupBy(*by).agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)

    for name in later:
        # written, as all that follows reads it several times
        counted = kept_as(counted.join(often_in(counted, "leaf").select("leaf"), "leaf", "left_semi"))
        known = often_in(counted, "leaf", name).select("leaf", name, F.lit(True).alias("known"))
        counted = counted.join(known, ["leaf", name], "left").select(
            "key", F.xxhash64("leaf", F.when(F.col("known"), F.col(name)), F.lit(name)).alias("leaf"), *later[later.index(name) + 1 :], "n",
            (F.col("wild") | F.col("known").isNull()).alias("wild"),
        )
    kept = kept_as(counted.join(often_in(counted, "leaf"), "leaf"))
    while len(folders) > 1:
        drop_folder(spark, folders.pop(0))
    # of the texts, only those of lines that are left are shuffled, and the few that a bitmap cannot tell from them
    own = maybe_in(_text_lines(docs).select("plain", "line", _key(F.col("line")).alias("key")), F.col("key"), bitmap_of(kept, "key"))
    one_space = F.when(F.col("plain"), F.col("line")).otherwise(F.regexp_replace("line", SPACES, " "))
    texts = own.select("key", one_space.alias("line")).groupBy("key").agg(F.first("line").alias("line"))
    # few lines are left; what follows reads them several times
    lines = kept_as(kept.join(texts, "key").withColumn("size", _spaces(F.col("line")) + 1), compression="zstd")
    drop_folder(spark, folders.pop(0))

    # lines of one template have at least one pair of words in common, which min_docs documents have; few other lines do
    pairs = _pairs(lines)
    common = pairs.groupBy("pair").agg(F.sum("n").alias("here")).where(F.col("here") >= min_docs)
    paired = maybe_in(pairs.select("key", "pair"), F.col("pair"), bitmap_of(common, "pair")).select("key")
    short = lines.where(F.col("size") - F.when(F.col("wild"), DEPTH).otherwise(0) < LEAST_PAIRED).select("key")
    likely = kept_as(maybe_in(lines, F.col("key"), bitmap_of(paired.unionByName(short), "key")), compression="zstd")

    # a word at its place in a leaf is a number; it is even for the first DEPTH words, so two numbers a word are all that is shuffled
    def number(place: Column, word: Column) -> Column:
        return F.xxhash64("leaf", place, word).bitwiseAND(F.lit(-2)) + F.when(place < DEPTH, 0).otherwise(1)

    def numbers(d: DataFrame) -> DataFrame:
        at = d.select("leaf", "key", F.posexplode(F.split("line", " ")).alias("place", "word")).where(F.col("word") != FIELD)
        return at.select("leaf", "key", number(F.col("place"), F.col("word")).alias("word"))

    # all lines of their leaves count for the words of likely lines; the other words of these lines are never rows
    sought = bitmap_by(numbers(likely), "leaf", F.col("word"))
    near = with_bits(maybe_in(lines, F.col("leaf"), bitmap_of(likely, "leaf")), "leaf", sought)
    own = F.transform(F.split("line", " "), lambda word, place: number(place, word))
    # explode_outer: a plain explode is planned with a test for empty arrays, which looks up all words twice
    at = near.select("n", F.explode_outer(F.filter(own, lambda x: maybe_has(F.col("_bits"), x))).alias("word")).where("word IS NOT NULL")
    # what is constant has its bit in a bitmap, so that of the words of all lines few others are shuffled a second time
    constant = kept_as(at.groupBy("word").agg(F.sum("n").alias("here")).where(F.col("here") >= min_docs))
    drop_folder(spark, folders.pop(0))
    at = maybe_in(numbers(likely).select("key", "word"), F.col("word"), bitmap_of(constant, "word"))
    # per line its constant words, and of these the usual ones: the two kinds of template
    fixed = at.join(constant, "word").groupBy("key").agg(F.collect_list(F.struct("word", "here")).alias("fixed"))
    template = fixed.join(likely.select("leaf", "docs", "wild", "key", "n", "size"), "key")
    usual = F.filter("fixed", lambda f: f["here"] >= USUAL * F.col("docs"))
    kind = "struct<relative: boolean, fixed: array<struct<word: bigint, here: bigint>>>"
    kinds = F.array(F.struct(F.lit(False), F.col("fixed")).cast(kind), F.struct(F.lit(True), usual).cast(kind))
    template = template.select("leaf", "wild", "key", "n", "size", F.inline(kinds)).where(F.size("fixed") > 0).select(
        "leaf", "wild", "key", "n", "size", "relative", F.xxhash64(F.sort_array(F.col("fixed.word"))).alias("template"), F.size("fixed").alias("fixed"),
        F.size(F.filter("fixed", lambda f: f["word"].bitwiseAND(F.lit(1)) == 1)).alias("fixed_after"),
    )
    after = F.col("size") - DEPTH
    holds = (after > 0) & (F.col("fixed_after") >= CONSTANT_SHARE * after)
    template = template.where((F.col("fixed") >= CONSTANT_SHARE * F.col("size")) & (holds | ~(F.col("wild") | F.col("relative"))))
    often = often_in(template, "leaf", "relative", "template").drop("docs")
    recurring = stored(template.join(often, ["leaf", "relative", "template"], "left_semi").select(F.col("key").alias("line")).distinct(), folder)
    for written in folders:
        drop_folder(spark, written)
    return recurring


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_dropped, kept_text.

    Lines end at \\n.  Lines without a word are never dropped.  A null text has
    no line, an empty one has one.  A document counts once for a line that it
    repeats, and documents with equal texts count once, so that copies do not make
    boilerplate of what they say; each row still gets its result.
    """
    text = F.col("text")
    # joins would add these filters, but only to some uses; with them in all, equal parts of the plan share exchanges
    spark, folders = docs.sparkSession, [scratch(docs.sparkSession) for _ in range(2)]
    drop_shuffles(spark)
    table = stored(line_table(docs), folders[0]).where("line IS NOT NULL")
    recurring = recurring_lines(docs, table, folders[1], min_docs)
    concerned = maybe_in(table.select("text_hash", "at", "line"), F.col("line"), bitmap_of(recurring, "line"))
    gone = stored(concerned.join(recurring, "line", "left_semi").groupBy("text_hash").agg(F.collect_set("at").alias("gone")), scratch(spark))

    # a bitmap tells each text where it stands which of its lines go; only texts for which it names others too are shuffled
    places = gone.select("text_hash", F.explode("gone").alias("at"))
    place = lambda at: F.xxhash64("text_hash", at)
    dropped = bitmap_by(places, "text_hash", place(F.col("at")), PLACE_BITS)
    named = with_bits(table.select("text_hash", "at"), "text_hash", dropped)
    named = named.where(maybe_has(F.col("_bits"), place(F.col("at")), PLACE_BITS)).select("text_hash", "at")
    misled = stored(named.join(places, ["text_hash", "at"], "left_anti").select("text_hash").distinct(), scratch(spark))
    for folder in folders:
        drop_folder(spark, folder)
    d = maybe_flag(docs.select("doc_id", "text", _text_hash().alias("text_hash")), F.col("text_hash"), bitmap_of(misled, "text_hash"), "maybe")
    exact = maybe_in(gone, F.col("text_hash"), bitmap_of(misled, "text_hash"))
    lines = F.when(text.isNotNull(), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    has_word = lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""
    goes = lambda x, at: maybe_has(F.col("_bits"), place(at), PLACE_BITS) & has_word(x)
    here = F.when(F.col("_bits").isNotNull(), F.filter(F.transform(lines, lambda x, at: F.when(goes(x, at), at)), lambda at: at.isNotNull()))
    d = d.where("maybe").join(exact, "text_hash", "left").select("doc_id", "text", "gone").unionByName(
        with_bits(d.where("NOT maybe"), "text_hash", dropped).select("doc_id", "text", here.alias("gone"))
    )
    gone_here = F.coalesce("gone", F.array().cast("array<int>"))
    keeps = lambda x: F.filter(x, lambda v, i: ~F.array_contains(gone_here, i))
    return d.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(gone_here).cast("long").alias("n_dropped"),
        F.array_join(keeps(lines), "\n").alias("kept_text"),
    )


def document_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Digest: doc_id, n_lines, n_dropped, kept_sha256."""
    return without_recurring_lines(docs, min_docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
