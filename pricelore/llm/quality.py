"""Quality rules: Jensen-Shannon distances of documents' histograms to their language's. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.llm.common import SPACE, let, written

SYMBOLS = "[#*$%&|<>]"
#: Character classes besides white space and the rest; blanks and the letters a-z are in none of them.
CLASSES = ("[A-Z]", "[0-9]", "[.,]", SYMBOLS, r"[!-\"'-)+\-/:;=?@\[-`{}~]", r"[^\x00-\x7F]")
SYMBOLS_AT = CLASSES.index(SYMBOLS)
#: Words in a window whose repetition counts.
WINDOW = 5
#: Common words kept for each language, the longest one looked at, and the least share of the language's words.
COMMON, LONGEST, LEAST_SHARE = 16, 6, 0.001
#: Least share of all short words that a language with references of its own has: there are at most 1 / OWN_SHARE of them.
#: Documents in others are held against all languages'.
OWN_SHARE = 0.001
#: Guards: from so many words on, the largest distances by characters and by common words that are kept. Shorter documents
#: aren't judged by distances.
BOUNDS = ((100, 0.17, 0.255), (40, 0.3, 0.33))
#: Stands for all languages together.
ALL = ""


def windows(ws: Column) -> Column:
    """Hashes of all WINDOW words that follow each other."""
    starts = lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(starts(h), lambda x, i: F.xxhash64(x, *(h[i + k] for k in range(1, WINDOW)))))


def repeated(grams: Column) -> Column:
    """Words covered by the windows, given as hashes in their order, that occur twice or more."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda x, hs, j: F.coalesce(F.get(hs, j) == x["h"], F.lit(False))
        return let(s["h"], lambda hs: F.sort_array(F.filter(s, lambda x, j: same(x, hs, j - 1) | same(x, hs, j + 1))["i"]))

    def covered(p: Column) -> Column:
        step = lambda j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - F.get(p, j)), F.lit(WINDOW))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, j: a + step(j))

    found = let(let(ordered, positions), covered)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(found)


def class_counts(text: Column, classes: tuple[str, ...]) -> Column:
    """Characters of text in each of the classes, which don't overlap: a class is sought in what the ones before have left."""
    if not classes:
        return F.array().cast("array<bigint>")
    left = lambda t: F.regexp_replace(t, f"{classes[0]}+", "")
    return let(text, lambda t: let(left(t), lambda r: F.concat(F.array((F.length(t) - F.length(r)).cast("long")), class_counts(r, classes[1:]))))


def split_words(text: Column) -> Column:
    """The runs of characters other than SPACE."""
    return F.array_remove(F.split(text, SPACE), "")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, words: the most common words of each language with OWN_SHARE of all short words and, under ALL, of all
    languages; commonest first, ties to the smaller word; counted over all documents (text, lang).

    A word counts lower-cased, if it has at most LONGEST letters and nothing else. As each listed word has LEAST_SHARE of
    its language's, no list gathers more than 1 / LEAST_SHARE words, and there are at most 1 / OWN_SHARE + 1 lists.
    """
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"), F.explode(split_words(low)).alias("word"))
    counts = words.where((F.length("word") <= LONGEST) & F.col("word").rlike(r"^\p{L}+$")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = written(counts, "word-counts")
    whole = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.where(F.col("lang") != ALL).groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= OWN_SHARE * whole)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, COMMON)["word"].alias("words")
    frequent = counts.join(F.broadcast(own), "lang").where(F.col("n") >= LEAST_SHARE * F.col("total")).groupBy("lang").agg(top)
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SHARE * whole).agg(top)
    lists = own.select("lang").join(frequent, "lang", "left").select("lang", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return written(lists.unionByName(pooled.select(F.lit(ALL).alias("lang"), "words")), "common-words")


def measures(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with own (the language whose references hold, or ALL) and a struct m: the base counts and both histograms.

    docs: text, lang, and further columns other than own, own_words and m. m.classes counts characters by CLASSES, white
    space and the rest; m.common the words of own's list, and the rest.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_all = common.where(F.col("lang") == ALL).first()["words"]
    own = common.where(F.col("lang") != ALL).select(F.col("lang").alias("own"), F.col("words").alias("own_words"))
    rows = docs.join(F.broadcast(own), F.col("lang").cast("string") == F.col("own"), "left")  # at most 1 / OWN_SHARE lists
    listed = F.coalesce("own_words", F.array(*map(F.lit, of_all)).cast("array<string>"))

    def by_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), let(windows(ws), repeated).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    low = split_words(F.lower(text))
    counts = let(low, lambda ws: F.transform(listed, lambda w: (F.size(ws) - F.size(F.array_remove(ws, w))).cast("long")))
    rest = F.regexp_replace(text, r"[a-z\x20]+", "")  # short, and has all that CLASSES count
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    parts = F.struct(let(split_words(text), by_words).alias("w"), dup_lines, F.length(text).cast("long").alias("chars"), class_counts(rest, CLASSES).alias("classes"), counts.alias("common"))

    def histograms(x: Column) -> Column:
        white, sum_of = x["chars"] - x["w"]["word_chars"], lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, n: s + n)
        return F.struct(
            x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["classes"][SYMBOLS_AT].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"), F.concat(x["classes"], F.array(white, x["w"]["word_chars"] - sum_of(x["classes"]))).alias("classes"),
            F.concat(x["common"], F.array(x["w"]["n_words"] - sum_of(x["common"]))).alias("common"),
        )

    return rows.select(*docs.columns, F.coalesce("own", F.lit(ALL)).alias("own"), let(parts, histograms).alias("m"))


def references(measured: DataFrame) -> DataFrame:
    """own, classes, common: each language's shares of its character classes and common words, over all rows (own, m).

    ALL has all rows' character classes, and the common words of the rows that have no references of their own.
    """
    n_classes = len(CLASSES) + 2

    def sums(column: str, size: int) -> Column:
        return F.array(*(F.coalesce(F.sum(F.get(F.col(column), F.lit(i))), F.lit(0)) for i in range(size)))

    def shares(values: Column) -> Column:
        """Null if there is nothing; places that no row has are 0 and stay, as distances don't see them."""
        whole = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(whole > 0, F.transform(values, lambda x: x / whole))

    by = written(measured.groupBy("own").agg(sums("m.classes", n_classes).alias("classes"), sums("m.common", COMMON + 1).alias("common")), "histograms")
    own = by.where(F.col("own") != ALL)
    rest = by.withColumn("common", F.when(F.col("own") == ALL, F.col("common")))
    pooled = rest.agg(sums("classes", n_classes).alias("classes"), sums("common", COMMON + 1).alias("common")).select(F.lit(ALL).alias("own"), "classes", "common")
    return written(own.unionByName(pooled).select("own", shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common")), "references")


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram to shares; 0 for an empty histogram, or null shares."""

    def part(n: Column, q: Column, whole: Column) -> Column:
        p = n / whole
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)

    def summed(whole: Column) -> Column:
        parts = F.zip_with(counts, shares, lambda n, q: part(F.coalesce(n, F.lit(0)), F.coalesce(q, F.lit(0.0)), whole))
        return F.when(whole > 0, F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))

    return F.coalesce(let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), summed), F.lit(0.0))


def judged(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept to rows with columns own and m."""
    refs = refs.select("own", F.struct("classes", "common").alias("ref"))
    n = F.col("m.n_words")
    out = measured.join(F.broadcast(refs), "own", "left")  # at most 1 / OWN_SHARE + 1 rows
    out = out.withColumn("base_failed", (n < 10) | (100 * F.col("m.n_repeat_words") > 20 * n))
    out = out.withColumn("char_distance", divergence(F.col("m.classes"), F.col("ref.classes"))).withColumn("word_distance", divergence(F.col("m.common"), F.col("ref.common")))
    bad = F.lit(False)
    for least, most_chars, most_words in reversed(BOUNDS):
        bad = F.when(n >= least, (F.col("char_distance") > most_chars) | (F.col("word_distance") > most_words)).otherwise(bad)
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("ref")


def trimmed(measured: DataFrame) -> DataFrame:
    """References that junk doesn't blur: summed over all rows, then anew over all rows that the first ones keep."""
    first = references(measured)
    again = references(judged(measured, first).where("kept")).select("own", F.col("classes").alias("c"), F.col("common").alias("w"))
    return written(first.join(F.broadcast(again), "own", "left").select("own", F.coalesce("c", "classes").alias("classes"), F.coalesce("w", "common").alias("common")), "references")


def rules(docs: DataFrame) -> DataFrame:
    """Base counts, distances and verdict of every row of docs (doc_id, text, lang; further columns are ignored).

    Texts are read twice: for each language's common words, and for all counts, which are written as a small table. The
    languages' histograms sum all documents', and then once more those that these references keep. A document is rejected
    by the base rules, or if one of its two distances is over its bound and the document has the words that the guard asks
    for. A null or empty text has no words, and fails. Documents of null or rare languages are held against all documents'
    character classes, and against each other's use of the words that are common in all languages. Rows that repeat are
    all returned and judged alike; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    measured = measures(rows, common_words(rows)).drop("text", "lang")
    measured = written(measured, "quality-measures")
    out = judged(measured, trimmed(measured))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang, and any further columns) that the rules keep, with all their columns.

    The rows are written with their measures, so that no text is measured twice. Nulls, empty texts, rare languages,
    repeated rows and empty tables are treated as in rules().
    """
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select(row, "text", F.col("lang").cast("string").alias("lang"))
    measured = written(measures(rows, common_words(rows)).drop("text", "lang"), "quality-measures")
    return judged(measured, trimmed(measured)).where("kept").select("row.*")
