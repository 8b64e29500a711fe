"""Near-duplicate lines by an exact set-similarity join.

Lines are sets of words. Equal lines form a class that stands at its first
occurrence, by doc_id and line number. The words of a class are ordered by rarity;
two sets of Jaccard similarity t or more share a word among the first
n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the
smaller, so classes meet on those prefix words only. Before a pair is made its sizes
must agree (length filter), the places of the shared word must leave enough words
for the overlap needed (positional filter), and their bitmaps, in which each word
sets a bit, must not differ in more bits than the sets can (bitmap
filter). A second bitmap of 512 bits does the same for the pairs that are left. None
of these loses a pair. What remains is verified on the words.

Rarity is counted for hash ranges of words, RANKS of them, so the list of ranks that
goes with the job has a fixed size; any order that is the same everywhere keeps the
join exact. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, perhaps_among, table

PERCENT, RANKS, LONG = 80, 1 << 18, 40
_ORDER = "decimal(38,0)"
#: Bitmaps: 64 bits in the first for lines of at most LONG words, 192 bits in all three for longer ones.
BITS = ("bits0", "bits1", "bits2")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: the lines that hold a word; lines are split at \\n."""
    lines = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def words(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), ""))


def when_first(doc_id: Column, line_no: Column) -> Column:
    """One number that orders occurrences."""
    return doc_id.cast(_ORDER) * F.lit(10**10).cast("decimal(11,0)") + line_no.cast("decimal(10,0)")


def ranks_of(lines: DataFrame) -> Column:
    """An array constant: for each of RANKS hash ranges of words, how many words of the lines fall in it."""
    place = F.pmod(F.xxhash64("w"), F.lit(RANKS)).cast("int")
    found = lines.select(F.explode(F.split(F.lower("line"), r"[\x20\x09-\x0D]+")).alias("w")).groupBy(place.alias("i")).agg(F.count("*").alias("n"))
    counts = [0] * RANKS
    for i, n in found.collect():  # RANKS rows at most
        counts[i] = min(n, 2**31 - 1)
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<int>")


def classes(lines: DataFrame, percent: int) -> DataFrame:
    """h1, h2, n (distinct words), first, prefix (the rarest words, in order, as numbers) and bitmaps of every class.

    A word's number has its range's count above 32 bits of its hash, so that plain
    numbers sort by rarity; the prefix keeps those 32 bits. Two words that agree in
    them only make more candidates.
    """
    ranks = ranks_of(lines)
    number = lambda x: F.shiftleft(F.get(ranks, F.pmod(x, F.lit(RANKS)).cast("int")).cast("bigint"), 32).bitwiseOR(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int")))

    def parts(k: Column) -> Column:
        n = F.size(k)
        keep = n - F.ceil(n * percent / 100).cast("int") + 1
        zero = F.lit(0).cast("bigint")
        own = lambda j: F.aggregate(k, zero, lambda a, x: F.when(F.pmod(F.shiftright(x, 6).bitwiseAND(F.lit(0x3FFFFFF)), F.lit(3)) == j, bit(a, x)).otherwise(a))
        short = F.aggregate(k, zero, bit)
        maps = [F.when(n > LONG, own(j)).otherwise(short if j == 0 else zero).alias(BITS[j]) for j in range(3)]
        return F.struct(n.alias("n"), F.transform(F.slice(k, 1, keep), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("prefix"), *maps)

    numbers = F.transform(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)), number)
    rows = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(5), "line").alias("h2"), when_first(F.col("doc_id"), F.col("line_no")).alias("at"), F.inline(F.array(let(F.sort_array(numbers), parts))))
    return rows.groupBy("h1", "h2", "n", "prefix", *BITS).agg(F.min("at").alias("first"))


def wide_bits(hashes: Column) -> Column:
    """A bitmap of 512 bits, as 8 numbers: lines of many words fill 64 bits."""
    own = lambda j: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(7)) == j)
    bit = lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate(own(j), F.lit(0).cast("bigint"), bit))


def matches(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(lines, links): every line with its class h1, h2, first; and all pairs (earlier, later) of classes, by first, that match."""
    lines = line_rows(docs)
    found = table(classes(lines, percent).withColumn("id", F.monotonically_increasing_id()), "classes")
    # most rare words stand in one class only and cannot join; then the word's 32 bits and its place share a number
    post = found.select("id", "n", *BITS, F.posexplode("prefix").alias("at", "word"))
    often = table(post.groupBy("word").agg(F.count("*").alias("c")).where("c > 1").select("word"), "often")
    post = perhaps_among(post, "word", often)
    post = post.select("id", F.shiftleft(F.col("word").cast("bigint"), 32).bitwiseOR(F.col("at").cast("bigint")).alias("spot"), "n", *BITS)
    a, b = (post.select(*(F.col(c).alias(f"{side}_{c}") for c in post.columns)) for side in "ab")
    at = {side: F.col(f"{side}_spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") for side in "ab"}
    # the shorter set needs fewer of its words
    short = F.col("a_n") - F.ceil(F.col("a_n") * 2 * percent / (100 + percent)).cast("int") + 1
    need = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent)).cast("int")
    room = F.least(F.col("a_n") - at["a"], F.col("b_n") - at["b"])
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BITS), F.lit(0))
    fits = ((F.col("a_n") <= LONG) != (F.col("b_n") <= LONG)) | (apart <= F.col("a_n") + F.col("b_n") - 2 * need)
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))
    good = smaller & (at["a"] < short) & (F.col("a_n") * 100 >= F.col("b_n") * percent) & (room >= need) & fits
    pairs = table(a.join(b, F.shiftright("a_spot", 32) == F.shiftright("b_spot", 32)).where(good).select("a_id", "b_id").distinct(), "candidates")
    # some more classes than those of the pairs do no harm
    ends = perhaps_among(found.select("id", "h1", "h2", "first"), "id", pairs.select(F.col("a_id").alias("id")).unionAll(pairs.select("b_id")))
    ends = table(ends.withColumn("doc_id", F.floor(F.col("first") / F.lit(10**10).cast("decimal(11,0)")).cast("long")), "ends")
    own = line_rows(perhaps_among(docs.where("doc_id is not null"), "doc_id", ends.select("doc_id"))).withColumn("first", when_first(F.col("doc_id"), F.col("line_no"))).select("first", "line")
    own = perhaps_among(own, "first", ends.select("first")).select("first", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(5), "line").alias("h2"), "line")
    # rows that repeat a doc_id hold a class's first line more than once
    own = own.join(ends.select("id", "first", "h1", "h2"), ["first", "h1", "h2"]).dropDuplicates(["first", "h1", "h2"]).select("id", "first", words(F.col("line")).alias("w"))
    # a text takes less room than an array of words
    own = table(own.select("id", "first", F.array_join("w", " ").alias("w"), F.size("w").alias("n"), let(F.transform("w", lambda x: F.xxhash64(x)), wide_bits).alias("wide")), "words")

    def sided(rows: DataFrame, sides: str, *columns: str) -> DataFrame:
        for side in sides:
            rows = rows.join(own.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *columns))), f"{side}_id")
        return rows

    total = F.col("a_n") + F.col("b_n")
    need = F.ceil(total * percent / (100 + percent)).cast("int")
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    common = F.size(F.array_intersect(F.split("a_w", " ", -1), F.split("b_w", " ", -1)))

    near = table(sided(pairs, "ab", "wide").where(differ <= total - 2 * need).select("a_id", "b_id"), "near")
    links = sided(near, "ab", "first", "w").where(let(common, lambda c: c * 100 >= (total - c) * percent))
    links = table(links.select(F.least("a_first", "b_first").alias("earlier"), F.greatest("a_first", "b_first").alias("later")), "links")
    slim = lines.select("doc_id", "line_no", F.length("line").alias("chars"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(5), "line").alias("h2"))
    return slim.join(found.select("h1", "h2", "first"), ["h1", "h2"]), links


def judged_lines(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, line_no, chars, class_id (first of the line's class), links (classes that match it) and gone of every line."""
    lines, links = matches(docs, percent)
    ends = links.select(F.col("later").alias("first"), F.lit(1).alias("early")).unionAll(links.select(F.col("earlier").alias("first"), F.lit(0).alias("early")))
    degrees = ends.groupBy("first").agg(F.count("*").alias("links"), F.sum("early").alias("early"))
    lines = lines.join(degrees, "first", "left").distinct()
    gone = (when_first(F.col("doc_id"), F.col("line_no")) != F.col("first")) | (F.coalesce("early", F.lit(0)) > 0)
    return lines.select("doc_id", "line_no", "chars", F.col("first").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), gone.alias("gone"))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no, chars (its length) of every line that matches an earlier one."""
    return judged_lines(docs, percent).where("gone").select("doc_id", "line_no", "chars").distinct()


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, in order), n_chars (code points kept), classes and n_links; see dedup_lines.

    classes names the class of each line that holds a word, in line order, as
    doc_id:line_no of its first occurrence; n_links is the number of other classes
    that match, summed over these lines. Texts are measured where they lie; only
    their figures are joined.
    """
    lost = F.sum(F.when(F.col("gone"), F.col("chars") + 1)).alias("lost")
    removed = F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line_no")))).alias("removed")
    home = F.floor(F.col("class_id") / F.lit(10**10).cast("decimal(11,0)")).cast("long")
    name = F.concat_ws(":", home, (F.col("class_id") - home.cast(_ORDER) * F.lit(10**10).cast("decimal(11,0)")).cast("long"))
    named = F.array_sort(F.collect_list(F.struct("line_no", name.alias("name")))).alias("named")
    found = judged_lines(docs, percent).groupBy("doc_id").agg(removed, lost, named, F.sum("links").alias("n_links"))
    text = F.col("text").cast("string")
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("n_lines"), F.length(text).alias("chars")).join(found, "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.when(F.col("chars").isNotNull(), F.greatest(F.lit(0), F.col("chars") - F.coalesce("lost", F.lit(0))))
    names = F.coalesce(F.col("named.name"), F.array().cast("array<string>"))
    return rows.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"), kept.cast("long").alias("n_chars"), names.alias("classes"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, in order) and text (what is kept) of every document.

    docs: doc_id, text; other columns are ignored. A line is removed if an earlier line,
    by doc_id and line number, has a Jaccard similarity of percent or more with it;
    equal lines match. Words are runs of characters other than space and
    0x09-0x0D, lower-cased; lines without words stay. A null text stays null with
    0 lines, an empty one has one line. Rows whose doc_id is null pass untouched;
    rows that repeat a doc_id lose the same lines.
    """
    gone = removed_lines(docs, percent).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(gone, "doc_id", "left")
    split = F.split("text", "\n", -1)
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.filter(split, lambda x, i: ~F.array_contains(removed, i))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"), F.array_join(kept, "\n").alias("text"))
