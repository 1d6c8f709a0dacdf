"""Near-duplicate components by min-max hashing.

Documents with equal shingle sets form a class, so copies cost one row each and are never paired.
Each permutation of a class's shingles gives two values of its signature, the least and the
greatest, which halves the hash evaluations; bands of the signature are bucketed.  In a bucket every
class is first compared with few leaders, the classes of least hash, so a group of near copies
becomes one component without its pairs being made; only what is still unconnected in a bucket is
then compared with the rest of it.  Links are confirmed on the full shingle sets.

What is shuffled per class and bucket is a pair of numbers; signatures meet candidate pairs only, and
texts are read again for candidates only, past a broadcast of their ids where those are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise
from .wordhash import frugal, mix, words_by_chunk

BANDS, ROWS = 40, 5
ROWS_AT_ONCE = 1000
FEW_IDS = 4_000_000  # ids that are broadcast at most: 64 MB
LEADERS = (1, 4)  # members of a bucket that all others meet, round by round, before the last sweep
SKETCH_LONGS, ODD_LONGS = (BANDS * ROWS + 15) // 16, 16
_RNG = np.random.default_rng(77)
_PERMS = BANDS * ROWS // 2
_A = (_RNG.integers(0, 2**31, _PERMS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, _PERMS, dtype=np.uint64).astype(np.uint32)
_COEF = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SEAT = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, 16, dtype=np.uint64) | np.uint64(1)


_SIMILAR, _ODD = [f"s{k}" for k in range(SKETCH_LONGS)], [f"o{k}" for k in range(ODD_LONGS)]
_SKETCH = _SIMILAR + _ODD


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text is one shingle, no words none."""
    place = np.resize(_PLACE, size) if size > len(_PLACE) else _PLACE[:size]
    for _, _, w in words_by_chunk(texts):
        many = len(w) - size + 1
        joined = np.zeros(max(many, 0), np.uint64)
        if many > 0:
            for k in range(size):
                joined += w.hash[k : k + many] * (place[k] + np.uint64(2 * k))
            joined = mix(joined)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            elif b > a:
                short = (w.hash[a:b] * (place[: b - a] + np.uint64(2) * np.arange(b - a, dtype=np.uint64))).sum(dtype=np.uint64)
                yield mix(np.array([short ^ np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)


def set_key(found: np.ndarray) -> int:
    """A 64-bit key of a set."""
    total = mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(mix(np.array([total]))[0].astype(np.int64))


def signature(found: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation: 2 * _PERMS values."""
    low, high = np.full(_PERMS, 2**32 - 1, np.uint32), np.zeros(_PERMS, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        v = short[None, at : at + 2048] * _A[:, None]
        v += _B[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; a band mixes least and greatest values of different permutations."""
    cut = sigs.astype(np.uint64).reshape(len(sigs), ROWS, BANDS).transpose(0, 2, 1)
    return mix((mix(cut + np.uint64(1)) * _COEF).sum(axis=2, dtype=np.uint64) ^ _SEAT).astype(np.int64)


def sketches(sigs: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_LONGS) integers: four hashed bits of each signature value."""
    four = np.zeros((len(sigs), 16 * SKETCH_LONGS), np.uint8)
    four[:, : sigs.shape[1]] = mix(sigs.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(60)
    return (four[:, 0::2] << 4 | four[:, 1::2]).view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """ODD_LONGS integers, one bit a place: whether an odd number of the set's hashes fall there.  Two sets
    differ in at least as many elements as their sketches in bits."""
    odd = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=64 * ODD_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differences(percent: int) -> int:
    """Values in which the sketches of sets of that similarity differ at most, seven standard deviations above the mean."""
    n, p = 2 * _PERMS, (1 - percent / 100) * 15 / 16
    return int(np.ceil(n * p + 7 * np.sqrt(n * p * (1 - p))))


def _differences(a, b):
    """Hexadecimal digits in which two integers differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    for k in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _slices(batches):
    """Batches of at most ROWS_AT_ONCE rows, none of them empty: a worker holds few sets and signatures."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sign(size):
    def run(batches):
        for batch in _slices(batches):
            ids, texts = batch.column(0), batch.column(1)
            n, keys, sigs, odd = [], [], [], []
            for found in shingle_sets(texts, size):
                n.append(len(found))
                keys.append(set_key(found))
                odd.append(odd_sketch(found))
                sigs.append(signature(found) if len(found) else np.zeros(2 * _PERMS, np.uint32))
            sigs = np.stack(sigs)
            bands, bits = band_keys(sigs), np.hstack([sketches(sigs), np.stack(odd)])
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel())
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), lists, *[pa.array(bits[:, k]) for k in range(SKETCH_LONGS + ODD_LONGS)]], ["doc_id", "text_hash", "n_shingles", "node", "bands", *_SKETCH])

    return frugal(run)


def _sets(size):
    def run(batches):
        for batch in _slices(batches):
            found = list(shingle_sets(batch.column(0), size))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["node", "shingles"])

    return frugal(run)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for every node of the undirected ``u, v`` edges: equal labels for connected nodes.

    Each round maps a node to the least node of its neighbourhood and contracts the graph; node ids
    are hashes, so the number of rounds is logarithmic.  Everything stays in DataFrames.
    """
    edges = materialise(edges.select("u", "v").where("u != v").distinct(), name)
    both = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = both.select("node", F.col("node").alias("label"))
    while edges.limit(1).count():
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.min("v").alias("to")).select("u", F.least("u", "to").alias("to"))
        least = materialise(least, name)
        labels = labels.join(least, labels["label"] == least["u"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialise(labels, name)
        a, b = least.select(F.col("u"), F.col("to").alias("a")), least.select(F.col("u").alias("v"), F.col("to").alias("b"))
        edges = materialise(edges.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), name)
    return labels


def _few(ids: DataFrame) -> DataFrame:
    """Ids, broadcast if there are few of them."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _members(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "members")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``u, v`` pairs whose full sets are similar enough; sets are made again from the candidates' texts only."""
    wanted = materialise(_few(_members(pairs)).join(nodes.select("node", "rep"), "node"), "wanted")
    texts = docs.join(_few(wanted.select("rep").distinct()), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    # ids may repeat, also in other classes
    sets = texts.mapInArrow(_sets(size), "node long, shingles array<long>").join(_few(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])
    sets = materialise(sets, "near-sets", ROWS_AT_ONCE)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.where(100 * same >= percent * (F.size("a") + F.size("b") - same)).select("u", "v")


def _near(percent: int):
    """Whether two classes, the second's columns named with ``__``, may be similar.  The bounds of set sizes and odd
    sketches are exact, that of the signature sketches errs far less often than the bands miss a pair at the limit."""
    differ = reduce(lambda a, b: a + b, [_differences(x, f"__{x}") for x in _SIMILAR])
    sizes = F.col("n_shingles") + F.col("__n_shingles")
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"__{x}"))) for x in _ODD])
    sized = 100 * F.least("n_shingles", "__n_shingles") >= percent * F.greatest("n_shingles", "__n_shingles")
    return sized & ((100 + percent) * apart <= (100 - percent) * sizes) & (differ <= most_differences(percent))


def _led(live: DataFrame, leaders: int, first: DataFrame, percent: int) -> DataFrame:
    """``u, v``: pairs of a bucket's members and its leaders that are not connected yet and may be similar: the least
    member of each of ``leaders`` parts of a bucket meets all members."""
    part = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders))
    chosen = live.groupBy("bucket", part.alias("__part")).agg(F.min(F.struct("node", "label")).alias("m"))
    met = live.join(chosen.select("bucket", F.col("m.node").alias("__node"), F.col("m.label").alias("__label")), "bucket").where("label <> __label")
    pairs = materialise(met.select(F.least("node", "__node").alias("u"), F.greatest("node", "__node").alias("v")).distinct(), "led-pairs")
    # their signatures: pairs are narrow, and the classes that are in none stay where they are
    names = ["n_shingles", *_SKETCH]
    some = materialise(first.select("node", *names).join(_few(_members(pairs)), "node", "left_semi"), "led-signatures")
    at = pairs.join(some.withColumnRenamed("node", "u"), "u").join(some.select(F.col("node").alias("v"), *[F.col(c).alias(f"__{c}") for c in names]), "v")
    return at.where(_near(percent)).select("u", "v")


def _swept(live: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """``u, v``: the last pairs.  Whatever is not of the component of its bucket's least member meets all members of
    the bucket: of two members of different components one at least is such.  Bounds settle most pairs inside the
    join, and a pair comes from the first bucket that it shares alone."""
    names = ["n_shingles", "bands", *_SKETCH]
    wide = materialise(live.join(first.select("node", *names), "node"), "open-signatures")
    chosen = live.groupBy("bucket").agg(F.min(F.struct("node", "label")).alias("m")).select("bucket", F.col("m.label").alias("__top"))
    some = wide.join(chosen, "bucket").where(F.col("label") != F.col("__top")).drop("__top")
    right = some.select("bucket", *[F.col(c).alias(f"__{c}") for c in ["node", "label", *names]])
    shared = F.element_at(F.filter(F.zip_with("bands", "__bands", lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()), 1)
    met = wide.join(right, "bucket").where((F.col("label") != F.col("__label")) & _near(percent) & (shared == F.col("bucket")))
    return met.select(F.least("node", "__node").alias("u"), F.greatest("node", "__node").alias("v")).distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after new links: only the graph of labels that the links connect is contracted."""
    if labels is None:
        return components(links)
    at, bt = labels.select(F.col("node").alias("u"), F.col("label").alias("a")), labels.select(F.col("node").alias("v"), F.col("label").alias("b"))
    over = links.join(at, "u", "left").join(bt, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    new = components(over)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialise(moved.union(new.join(labels, "node", "left_anti")), "labels")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, text_hash``.

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` of their sets of word shingles
    (A-Z lower-cased, words split at ASCII white space); ``component_id`` is the least id reachable.

    Null and empty texts have no shingles and stand alone, each with its own id; a text of fewer than
    ``shingle_words`` words is one shingle.  Null ids are never the least: a component of null ids
    only has a null ``component_id`` and its rows are kept.  Rows that repeat id and text share the
    component and are all marked kept if one is.  Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = materialise(keyed.mapInArrow(_sign(shingle_words), f"doc_id {kind}, text_hash long, n_shingles long, node long, bands array<long>, " + ", ".join(f"{x} long" for x in _SKETCH)), "signatures", ROWS_AT_ONCE)
    full = signed.where("n_shingles > 0")
    nodes = materialise(full.groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    # one row of a class stands for its copies: equal sets have equal signatures
    first = materialise(full.select("node", "n_shingles", "bands", *_SKETCH).dropDuplicates(["node"]), "first-rows")
    seats = first.select("node", F.explode("bands").alias("bucket"))
    met = seats.groupBy("bucket").count().where("count > 1").select("bucket")
    live = materialise(seats.join(met, "bucket", "left_semi").withColumn("label", F.col("node")), "shared-buckets")
    labels = None
    for leaders in (*LEADERS, None):
        pairs = materialise(_led(live, leaders, first, percent) if leaders else _swept(live, first, percent), "pairs")
        if pairs.limit(1).count():
            found = materialise(_confirmed(pairs, nodes, docs, shingle_words, percent), "links")
            if found.limit(1).count():
                labels = _joined(labels, found)
                live = live.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if leaders:
            # a bucket that is one component by now is done
            open_ = live.groupBy("bucket").agg(F.min("label").alias("__a"), F.max("label").alias("__b")).where("__a <> __b").select("bucket")
            live = materialise(live.join(open_, "bucket", "left_semi"), "open-buckets")
    if labels is None:
        named = nodes.select("node", F.col("rep").alias("component_id"))
    else:
        at = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
        least = at.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = at.join(least, "label").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "text_hash", "node").join(named.withColumnRenamed("node", "__node"), (F.col("node") == F.col("__node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")
