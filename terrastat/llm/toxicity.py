"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, adjacent pairs and pairs one word apart, each hashed to one of 2**bits
coordinates and counted once a document.  Training runs over a bounded sample of labelled rows (at most
``MAX_TRAIN_ROWS`` rows and ``MAX_TRAIN_BYTES`` of text) as one ordered stream, with a learning rate per
coordinate; L1 leaves few weights, which are broadcast
(at most 2**bits of them, whatever the corpus).  Scoring is a map over documents without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .wordhash import WORDLESS, Words, frugal, mix, words_by_chunk

BITS = 20
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 16_000, 256 << 20  # bounds of the labelled sample, which is trained on in one task
BATCH_ROWS = 1000  # texts that go to a worker at once
EPOCHS, ALPHA, BETA, L1, L2 = 6, 2.0, 1.0, 4.0, 0.1
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(w: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, coordinate) arrays for words, pairs and skip-pairs of a run of texts."""
    of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    shift = np.uint64(64 - bits)
    out = [(of, (w.hash >> shift).astype(np.int32))]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(w) > gap:
            same = of[:-gap] == of[gap:]
            both = mix(w.hash[:-gap] * salt + w.hash[gap:])
            out.append((of[:-gap][same], (both[same] >> shift).astype(np.int32)))
    return out


@frugal
def _featurise(batches):
    for batch in batches:
        for a, b, w in words_by_chunk(batch.column("text"), WORDLESS):
            found = features(w)
            text, at = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            pairs = np.unique(text.astype(np.int64) << 32 | at)
            ends = np.searchsorted(pairs >> 32, np.arange(b - a + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, (pairs & 0xFFFFFFFF).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("at")[a:b], batch.column("label")[a:b], lists], ["at", "label", "features"])


def ftrl(stream, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """(coordinates, weights, bias) after one pass over (label, coordinates) pairs."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for label, at in stream:
        zz, nn = z[at], n[at]
        w = weights(zz, nn)
        bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
        g = p - label
        z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
        n[at] += g * g
        bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
        bias_n += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha))


def epochs(rows: list, turns: int = EPOCHS):
    """The rows of each epoch in turn, in another order every time that depends on the rows' number alone."""
    for e in range(turns):
        for i in np.random.default_rng([9, e]).permutation(len(rows)):
            yield rows[i]


@frugal
def _train(batches):
    rows = []
    for batch in batches:
        lists = batch.column("features")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += [(label, flat[a:b]) for label, a, b in zip(batch.column("label").to_pylist(), ends[:-1], ends[1:], strict=True)]
    if not rows:
        return
    at, w, bias = ftrl(epochs(rows))
    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([w]), pa.array([bias])], ["at", "w", "bias"])


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, id_col="doc_id", text_col="text", label_col="toxic"):
    """(coordinates, weights, bias) from the labelled rows: of at most ``max_rows`` labels, chosen by hash of the id,
    the documents up to ``max_bytes`` of text, those of ids that do not repeat first.

    Null labels and ids are left out; a document labelled more than once is toxic if any label says
    so.  Null texts have no features.  Rows that repeat an id are trained on each.  Without labelled
    rows the model is empty: every score is 0.5.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col)).cast("double").alias("label"))
        .withColumn("at", F.xxhash64("__id"))
        .orderBy("at", "__id")
        .limit(max_rows)
    )
    chosen = F.broadcast(chosen)  # at most max_rows labels
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id").select("at", "label", "text")
    # ids that repeat could bring any number of rows, long texts any number of bytes: rows of single ids come first
    sizes = texts.select("at", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).groupBy("at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    run = Window.orderBy("m", "at")
    kept = sizes.select("at", F.sum("n").over(run).alias("n"), F.sum("m").over(run).alias("m")).where((F.col("n") <= max_bytes) & (F.col("m") <= 2 * max_rows)).select("at")
    rows = texts.join(F.broadcast(kept), "at").mapInArrow(_featurise, "at long, label double, features array<int>")
    ordered = rows.repartition(1).sortWithinPartitions("at", F.xxhash64("features"))
    model = ordered.select("label", "features").mapInArrow(_train, "at array<int>, w array<float>, bias double").first()
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.array(model["at"], np.int32), np.array(model["w"], np.float32), model["bias"]


def score_texts(texts: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    """Probability that each text is toxic; null and empty texts get the bias alone."""
    out = np.full(len(texts), bias)
    for a, _, w in words_by_chunk(texts, WORDLESS):
        hits = [(x[k], y[k]) for x, y in features(w) if (k := dense[y] != 0).any()]
        if hits:
            pairs = np.unique(np.concatenate([x for x, _ in hits]).astype(np.int64) << 32 | np.concatenate([y for _, y in hits]))
            np.add.at(out, a + (pairs >> 32), dense[pairs & 0xFFFFFFFF])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def toxic_rows(df: DataFrame, model, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash`` of the rows that score ``at_least`` or more, as a written table: texts go to the workers in
    small batches and do not come back.  Nulls, empty texts, ties and repeats as with ``with_toxicity``."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return materialise(with_toxicity(rows, model, drop_text=True).where(F.col("score") >= at_least).drop("score"), "toxic-rows", BATCH_ROWS)


def with_toxicity(df: DataFrame, model, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``df`` with ``score`` added as its last column, and without the text on ``drop_text``.  Columns keep their names
    and types, one called ``score`` included.

    Null and empty texts have no features and get the model's bias alone, 0.5 under an empty model.
    Rows that repeat are scored each; no rows give no rows.
    """
    at, w, bias = model
    sent = df.sparkSession.sparkContext.broadcast((at, w, bias))
    text_at = df.columns.index(text_col)

    def run(batches):
        at, w, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            score = score_texts(batch.column(text_at), dense, bias)
            kept = [k for k in range(batch.num_columns) if not (drop_text and k == text_at)]
            fields = [*[batch.schema.field(k) for k in kept], pa.field("score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(score)], schema=pa.schema(fields))

    schema = type(df.schema)([f for k, f in enumerate(df.schema.fields) if not (drop_text and k == text_at)]).add("score", "double")
    return df.mapInArrow(frugal(run), schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 0 modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
