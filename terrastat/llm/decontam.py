"""Benchmark decontamination by a prefix-filtered join [native].

An item is cut into windows of consecutive words.  The words of all windows are ordered by rarity
(their count over all documents, then by the word itself); since a window must occur whole, its
necessary prefix is one word, the rarest, and documents are joined on those words only.  Adjacent
windows that share their rarest word form one probe, which holds their words alone; probes that are
alike are one, whatever items they come from.  A match fixes where each window would have to start:
windows that would reach over either end are left out by position and length, the others are
compared word by word.

Documents are read twice (rarity, join) and never shuffled: both passes stream exploded words past
a small table.  Each of these tables is broadcast only if its own measured size is below
``broadcast_bytes``; beyond it narrow (word, neighbours, row, position) rows are shuffled instead, and
matches alone meet their document and their probe again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialise

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def window_probes(items: DataFrame, rarity: DataFrame, window: int) -> DataFrame:
    """``__item, item_id, word, part, at, hi, len``: the windows of ``len`` words that start at 0..hi of ``part`` have
    their rarest word at ``at``.  A probe holds less than two windows' words, so all of them are linear in the items'."""
    spots = items.select("__item", F.posexplode("words").alias("pos", "word"))
    ranked = spots.join(rarity, "word", "left").select("__item", F.struct("pos", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "pos").alias("r")).alias("s"))
    by_item = ranked.groupBy("__item").agg(F.sort_array(F.collect_list("s")).alias("__all")).join(items.select("__item", "item_id", "words"), "__item")
    length = F.least(F.size("words"), F.lit(window))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - length),
        lambda s: F.struct(
            s.alias("start"),
            F.slice("words", s + 1, 2 * length - 1).alias("words"),
            F.array_min(F.transform(F.slice("__all", s + 1, length), lambda x: x["r"])).alias("r"),
        ),
    )
    at = by_item.select("__item", "item_id", length.alias("len"), F.explode(windows).alias("w"))
    found = at.groupBy("__item", F.col("w.r.pos").alias("pos")).agg(
        F.first("item_id").alias("item_id"), F.first("len").alias("len"), F.first("w.r.word").alias("word"),
        F.min(F.struct("w.start", "w.words")).alias("lo"), F.max("w.start").alias("hi"),
    )
    hi = F.col("hi") - F.col("lo.start")
    return found.select("__item", "item_id", "word", F.slice("lo.words", 1, hi + F.col("len")).alias("part"), (F.col("pos") - F.col("lo.start")).alias("at"), hi.alias("hi"), "len")


def _touches(words: Column, pos: Column) -> Column:
    """A cheap necessary condition: a window that holds more than the word at ``pos`` holds a neighbour of it."""
    def same(step):
        return F.coalesce(F.get(words, pos + step) == F.get("part", F.col("at") + step), F.lit(False))

    return (F.col("len") == 1) | same(1) | same(-1)


def _around(words: Column, pos: Column) -> tuple[Column, Column]:
    """(lo, near): the first window of the joined probe that fits into the document, and the document's
    words from its start to the end of the last that fits.  ``pos`` is where the probe's word stands."""
    first = pos - F.col("at")
    lo = F.greatest(F.lit(0), -first)
    hi = F.least(F.col("hi"), F.size(words) - F.col("len") - first)
    return lo, F.when(lo <= hi, F.slice(words, first + lo + 1, hi - lo + F.col("len")))


def _hits() -> Column:
    """Starts (0-based, in the document) of the windows that occur in ``__near``, from ``__lo`` and ``__first``."""
    found = F.filter(
        F.sequence(F.col("__lo"), F.col("__lo") + F.size("__near") - F.col("len")),
        lambda s: F.slice("__near", s - F.col("__lo") + 1, F.col("len")) == F.slice("part", s + 1, F.col("len")),
    )
    return F.when(F.size("__near") >= F.col("len"), F.transform(found, lambda s: F.col("__first") + s))


def _bytes(df: DataFrame, *widths: Column) -> int:
    """The bytes of a table whose rows have these widths."""
    return df.agg(F.coalesce(F.sum(sum(widths, F.lit(64))), F.lit(0))).first()[0]


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, item_ids, hit_spans, text_hash``.

    ``hit_spans`` holds distinct (start, len) word ranges where a window of an item occurs,
    ``n_hit`` counts the words inside any of them, ``item_ids`` the items, as strings in string order.
    ``text_hash`` is xxhash64 of the text.

    Null and empty texts have no words and no hits; items without words are never hit; an item
    shorter than ``window`` is one window.  Null item ids are reported as the empty string.  Items
    that repeat count once by id.  Rows that repeat id and text give one row each.  Other columns are
    ignored, whatever their names; an empty side gives no hits.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    items = materialise(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("__item", F.xxhash64("item_id", F.to_json("words"))),
        "bench-items",
    )
    vocabulary = materialise(items.select(F.explode("words").alias("word")).distinct(), "bench-words")
    few = _bytes(vocabulary, F.octet_length("word")) <= broadcast_bytes
    rarity = docs.select(F.explode(words_of(F.col("__text"))).alias("word")).join(F.broadcast(vocabulary) if few else vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = window_probes(items, rarity, window).withColumn("__probe", F.xxhash64("word", F.to_json("part"), "at", "hi", "len"))
    found = materialise(found.drop("__item"), "bench-probes")
    owners = found.select("__probe", "item_id").distinct()
    probes = materialise(found.drop("item_id").dropDuplicates(["__probe"]), "bench-distinct-probes")
    small = _bytes(probes, F.octet_length("word"), F.octet_length(F.array_join("part", " ")), 16 * F.size("part")) <= broadcast_bytes
    rows = docs.select("doc_id", F.xxhash64("__text").alias("__h"), words_of(F.col("__text")).alias("__words"))
    span = F.struct(F.col("__start").cast("int").alias("start"), F.col("len").cast("int").alias("len"))
    if small:
        # a row's place -1 joins an entry without probe: each row comes out once, with its word count
        marker = probes.sparkSession.createDataFrame([("", None, None, None, None, None)], "word string, __probe long, part array<string>, at int, hi int, len int")
        table = F.broadcast(probes.select("word", "__probe", "part", "at", "hi", "len").union(marker))
        spots = rows.select("doc_id", "__h", "__words", F.posexplode(F.concat(F.array(F.lit("")), "__words")).alias("__pos", "word"))
        # only the words around a match leave the join: documents are not copied for each of them
        pos, mark = F.col("__pos") - 1, F.col("__probe").isNull()
        lo, near = _around(F.col("__words"), pos)
        met = spots.join(table, "word").where(mark | _touches(F.col("__words"), pos)).select(
            "doc_id", "__h", "__probe", "part", "len", lo.alias("__lo"), (pos - F.col("at")).alias("__first"),
            F.when(mark, F.size("__words")).alias("n_words"), near.alias("__near"),
        )
        met = met.select("doc_id", "__h", "__probe", "len", "n_words", F.explode(F.when(mark, F.array(F.lit(-1))).otherwise(_hits())).alias("__start"))
    else:
        side = lambda words, at: F.xxhash64(F.coalesce(F.get(words, at), F.lit("")))  # noqa: E731  no word is empty
        spot = lambda i: F.struct(i.alias("pos"), F.get("__words", i).alias("word"), side("__words", i - 1).alias("before"), side("__words", i + 1).alias("after"))
        spots = rows.where(F.size("__words") > 0).select("doc_id", "__h", F.explode(F.transform(F.sequence(F.lit(0), F.size("__words") - 1), spot)).alias("s")).select("doc_id", "__h", F.col("s.pos").alias("__pos"), F.col("s.word").alias("word"), "s.before", "s.after")
        keys = probes.select("word", "__probe", "at", "hi", "len", side("part", F.col("at") - 1).alias("__before"), side("part", F.col("at") + 1).alias("__after"))
        beside = (F.col("len") == 1) | (F.col("before") == F.col("__before")) | (F.col("after") == F.col("__after"))
        near = spots.join(keys, "word").where(beside).select("doc_id", "__h", "__pos", "__probe", "at", "hi", "len")
        once = rows.dropDuplicates(["doc_id", "__h"]).select(F.col("doc_id").alias("__d"), F.col("__h").alias("__g"), "__words")
        met = near.join(once, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")))
        lo, part = _around(F.col("__words"), F.col("__pos"))
        met = met.select("doc_id", "__h", "__probe", "len", lo.alias("__lo"), (F.col("__pos") - F.col("at")).alias("__first"), part.alias("__near")).where("__near is not null")
        met = met.join(probes.select("__probe", "part"), "__probe").select("doc_id", "__h", "__probe", "len", F.lit(None).cast("int").alias("n_words"), F.explode(_hits()).alias("__start"))
        met = met.unionByName(rows.select("doc_id", "__h", F.lit(None).cast("long").alias("__probe"), F.lit(None).cast("int").alias("len"), F.size("__words").alias("n_words"), F.lit(-1).alias("__start")))
    real = F.col("__probe").isNotNull()
    # spans and probes by row first, then the items of its probes: a document's hits, not its words
    by = met.groupBy("doc_id", "__h").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(~real, 1)).alias("__rows"),
        F.collect_set(F.when(real, span)).alias("hit_spans"),
        F.collect_set("__probe").alias("__probes"),
    )
    by = materialise(by, "bench-hits")
    named = by.select("doc_id", "__h", F.explode("__probes").alias("__probe")).join(owners, "__probe").groupBy(F.col("doc_id").alias("__d"), F.col("__h").alias("__g")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    by = by.join(named, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left")
    inside = F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    return by.select(
        "doc_id", "n_words", F.size(inside).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "hit_spans",
        F.col("__h").alias("text_hash"), F.explode(F.array_repeat(F.lit(1), F.col("__rows").cast("int"))).alias("__one"),
    ).drop("__one")
