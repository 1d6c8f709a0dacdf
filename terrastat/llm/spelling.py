"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets, and their groups.

A word is the binary vector of its letters ("the k-th e"); one inserted, deleted or replaced letter changes at most two
of its coordinates.  Coordinates are dealt over parts, so that some part of a close pair differs in few places, and each
part over blocks, of which all subsets that must hold one without a difference are enumerated.  A subset's contents are a
signature: pairs that can be near share one exactly, meet in an equi-join and are verified there.

Signatures of words of similar letters fill up, so each is refined by half of the word: one edit leaves the first or the
last half of a word as it was.  That loses no pair, and a bucket's words then share a half and half of their letters.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialise

DISTANCE = 2  # coordinates that one edit changes at most


def words_of(df: DataFrame, text_col: str = "text", letters: str = r"[A-Za-zÀ-ÿ]", at_least: int = 1) -> DataFrame:
    """The rows of ``df`` once per maximal run of ``letters`` of at least so many characters, as the column ``word`` with
    A-Z lower-cased.  Null and empty texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"({letters}{{{at_least},}})"), F.lit(1))
    return df.select("*", F.explode(found).alias("__run")).withColumn("word", lower_ascii(F.col("__run"))).drop("__run", text_col)


def signatures(word: Column, parts: int = 1, blocks: int = 4) -> Column:
    """PartEnum signatures of a word's letters for Hamming distance 2: an array of longs.

    Of ``parts`` parts one holds at most ``DISTANCE // parts`` differences; all ways to leave out so many of its
    ``blocks`` blocks are enumerated.
    """
    spare = DISTANCE // parts
    if blocks <= spare:
        raise ValueError("a part needs more blocks than it may have differences")
    letters = F.array_distinct(F.split(word, ""))
    times = lambda c: F.char_length(word) - F.char_length(F.replace(word, c, F.lit("")))
    coordinates = F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: F.xxhash64(c, k))))

    def content(b: int) -> Column:  # the block's letters, in any order
        mine = F.filter(coordinates, lambda h: F.pmod(h, F.lit(parts * blocks)) == b)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda have, h: have.bitwiseXOR(h))

    held = F.transform(F.array(*[F.lit(b) for b in range(parts * blocks)]), content)
    chosen = [(p, s) for p in range(parts) for s in combinations(range(blocks), blocks - spare)]
    # held is computed once a word: the subsets read it as a lambda's argument
    return F.get(F.transform(F.array(held), lambda have: F.array(*[F.xxhash64(F.lit(i), *[have[p * blocks + b] for b in s]) for i, (p, s) in enumerate(chosen)])), 0)


def near_words(words: DataFrame, parts: int = 1, blocks: int = 4) -> DataFrame:
    """All pairs of ``words`` (``word, n``) that differ by exactly one inserted, deleted or replaced code point, once
    each with ``a < b``: ``a, a_n, b, b_n``.  No bucket is capped; a full one is split by the join's skew handling."""
    size = F.char_length("word")
    signed = words.select("word", "n", size.alias("size"), signatures(F.col("word"), parts, blocks).alias("signatures"))
    # a pair is filed under its longer word's length, so a word under its own and the next
    filed = signed.withColumn("longer", F.explode(F.array("size", F.col("size") + 1))).withColumn("signature", F.explode("signatures")).drop("signatures")
    first = F.floor((F.col("longer") - 1) / 2).cast("int")
    halves = F.array(
        F.xxhash64(F.lit("first"), F.col("longer"), F.col("signature"), F.substring("word", F.lit(1), first)),
        F.xxhash64(F.lit("last"), F.col("longer"), F.col("signature"), F.right(F.col("word"), F.col("longer") - 1 - first)),
    )
    filed = filed.select("word", "n", (F.col("size") == F.col("longer")).alias("long"), F.explode(halves).alias("key"))
    a, b = filed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("long").alias("a_long")), filed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("long").alias("b_long"))
    met = a.join(b, "key").where("a < b and (a_long or b_long)").where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "a_n", "b", "b_n").distinct()


def spelling_variants(words: DataFrame, ratio: int = 10, parts: int = 1, blocks: int = 4) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words`` (``word`` distinct, ``n`` its count).

    ``n_near`` is the number of words one edit away; ``form`` the one of largest n, the least in code-point order among
    equals, if its n is at least ``ratio`` times the word's, else null; ``root`` where following forms ends, the word
    itself without a form.  Other columns of ``words`` are ignored; no words give no rows.  Null words are left out.
    """
    words = materialise(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = materialise(near_words(words, parts, blocks), "near-words")
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    sides = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    met = words.join(best, "word", "left")
    formed = -F.col("best.minus_n") >= ratio * F.col("n")
    met = materialise(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.minus_n")).alias("form_n")), "forms")
    way = met.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each round doubles the way that is followed; n grows by ratio a step, so ways are short
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = materialise(way.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not way.where("moved").limit(1).count():
            break
        way = way.drop("moved")
    return met.join(way.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
