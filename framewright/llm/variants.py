"""Spelling variants: words one edit apart, joined by an even-partition pigeonhole index.

A word of length L is cut into two segments, of L // 2 and the other code
points. One edit leaves one of them as it is, so a word and its near word of
equal length agree in a segment at its place, and a near word that is one
longer has the first segment at its start or the second one shifted by one.
Both segments of every word are indexed with the length, and words of that
length and of one more probe them with the substrings at those places. What
agrees is a candidate; candidates are verified (exactly one code point
inserted, deleted or replaced) where they meet, and found pairs are taken once.

A segment that so many words share that its candidates pass `hot` is cut
again, together with all that agree in it: the open half of the word is halved, again
and again, down to one open code point. So the candidates of a group are
bounded by `hot` or by the letters that can stand at one place, never by
the square of a common segment's words.

A word's form is its near word with most occurrences, if it has twice as many
as the word or more. Forms at least double the count, so chains are short;
their ends are found by doubling steps.

All of it is DataFrame functions. Defined results: null texts have no words;
a null id is the empty text in hashes of ids; repeated rows count again; ties
go to the word first in code-point order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut, with_facts

#: Runs of letters of the Latin scripts.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Candidates of one key beyond which its open half is halved again.
HOT = 20_000


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    altered: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n) of the lower-cased (A-Z) runs of pattern; altered(id as text, run) may change a run, never lengthen it."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(pattern), F.lit(0))).alias("run"))
    long = runs.filter(F.char_length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = long.select((altered(F.col("id"), F.col("run")) if altered else F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def one_deleted(identity: Column, run: Column, every: int = 97) -> Column:
    """The run without one code point where `every` divides the crc32 of `<id>:<run>`."""
    h = F.crc32(F.concat(identity, F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with key: what stands before and after the open part [low, high) of a word of `length` code points; words one longer leave one more open."""
    after = F.col("high") + F.when(F.col("longer"), 2).otherwise(1)
    outside = (F.substring("word", F.lit(1), F.col("low")), F.substring(F.col("word"), after, F.char_length("word")))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", *outside))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the second half of its open part."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    two = rows.withColumn("part", F.explode(F.array(part(F.col("low"), middle), part(middle, F.col("high")))))
    return _keyed(two.select("word", "n", "longer", "length", F.col("part.low").alias("low"), F.col("part.high").alias("high")))


def indexed(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, word, n, longer): two segments of each word, and two probes of it for the words that are one shorter; hot keys cut further."""
    length = F.char_length("word")
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    rows = words.select("word", "n", sides).withColumn("length", length - F.when(F.col("longer"), 1).otherwise(0)).filter("length > 0")
    rows = _halved(rows.withColumn("low", F.lit(0)).withColumn("high", F.col("length")))
    done = None
    while True:
        own, more = F.count_if(~F.col("longer")), F.count_if(F.col("longer"))
        pairs = own * (own - 1) / 2 + own * more
        large = cut(rows.filter("high - low > 1").groupBy("key").agg(pairs.alias("pairs")).filter(F.col("pairs") > hot).select("key", F.lit(True).alias("large")))
        if not large.limit(1).count():
            return rows.select("key", "word", "n", "longer") if done is None else done.unionByName(rows.select("key", "word", "n", "longer"))
        marked = cut(with_facts(rows, large, "key", ["word"], "left"))
        rest = marked.filter("large is null").select("key", "word", "n", "longer")
        done = rest if done is None else done.unionByName(rest)
        rows = _halved(marked.filter("large").select("word", "n", "longer", "length", "low", "high"))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, near, near_n): the words of (word, n) exactly one edit apart, each pair both ways, once."""
    rows = indexed(words, hot)
    a = rows.filter("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    met = a.join(b, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    found = met.select("a", "a_n", "b", "b_n").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return found.select(F.inline(both))


def ends(steps: DataFrame) -> DataFrame:
    """(word, root): where the steps (word, form) from each word end; steps hold no circle."""
    roots = cut(steps.select("word", F.col("form").alias("root")))
    while True:
        further = with_facts(roots, roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", ["word"], "left")
        moved = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.filter("moved").limit(1).count():
            return roots
        roots = moved.drop("moved")


def spelling_variants(words: DataFrame, times: int = TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of words (word, n)."""
    words = cut(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, hot).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = (-F.col("best.less")) >= F.lit(times) * F.col("n")
    held = words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.less")).alias("form_n")
    )
    held = cut(held)
    roots = ends(held.filter("form is not null").select("word", "form"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
