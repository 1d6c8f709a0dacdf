"""Language-model scores by subword lattices.

An existing subword vocabulary spans a lattice over every word: all ways to cut it into pieces.  A
log-space forward recursion sums their probabilities, so a text gets its marginal probability and
not that of one segmentation.  The vocabulary's own scores weight the segmentations first.  Scores of
a byte-pair vocabulary are no log-probabilities but negative ranks of its pieces (-1, -2, ...), so they
are read as such and a piece starts with the probability that Zipf's law gives its rank: a departure
from taking scores as they are.  EM rounds over the word counts of all training texts then re-estimate
them until a round gains less than ``TOLERANCE`` of the log-likelihood; no piece is added.  Single bytes
are pieces, so every text has a probability.

The add-half word model beside it needs the training count of every token.  Counts of the most
frequent words (``frequent`` at most) are broadcast; all other words meet their counts in a join on
64-bit word hashes, which are spread evenly and hold no hot key.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .wordhash import WIDE_BYTES, Words, hash_spans, mix, running, text_bytes, words_by_chunk

FREQUENT, UNSEEN = 1 << 19, 0.05
TOLERANCE, MOST_ROUNDS = 1e-2, 40  # of the log-likelihood, gained by a round; the rounds are a guard, not a setting
SHORT, SCALE = 64, 6.0  # longest words, in bytes, whose uses are counted by plain products
CACHE_WORDS = 1 << 20
GROUP_BYTES = 1 << 18  # words of one length are handled in groups of about this size
MARK = 0x20  # stands before each word, where the vocabulary writes U+2581


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, first log-probabilities); pieces with an inner word start can't occur and are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {bytes([b]): -1e9 for b in range(256)}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) or "▁" in piece[1:]:
            continue
        best[piece.replace("▁", " ").encode()] = sp.get_score(i)
    pieces = sorted(best, key=lambda p: (-best[p], p))
    weight = 1 / (np.arange(len(pieces)) + 2.7)
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Pieces and their log-probabilities; words come as rows of byte matrices, all of one length."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)
        self.lengths = sorted({len(p) for p in pieces})
        # probabilities times e^SCALE a byte: a word's cuts all have its bytes, so their proportions stay, away from underflow
        self.scaled = np.append(np.exp(logp + SCALE * np.array([len(p) for p in pieces])), 0.0)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        keys = hash_spans(data, ends - [len(p) for p in pieces], ends)
        # most spans are no pieces: a small table of bits of the hash before it is mixed tells so
        sums, down = running(data)
        start = ends - [len(p) for p in pieces]
        self.may = np.zeros(1 << 20, bool)
        self.may[(((sums[ends] - sums[start]) * down[start]) >> np.uint64(44)).view(np.int64)] = True
        self.none, self.tables = len(pieces), []
        left, shift = np.arange(len(pieces)), 44
        while len(left):  # pieces that share a place in one table go to the next, smaller one, placed by other bits
            mask = np.uint64((1 << max(10, int(len(left)).bit_length() + 5)) - 1)
            place = ((keys[left] >> np.uint64(shift)) & mask).view(np.int64)
            held, number = np.zeros(int(mask) + 1, np.uint64), np.full(int(mask) + 1, self.none, np.int32)
            number[place] = left
            held[place] = keys[number[place]]
            self.tables.append((np.uint64(shift), mask, held, number))
            left, shift = left[number[place] != left], shift - 7

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of span hashes; the number after the last piece where there is none."""
        out, left = np.full(len(h), self.none, np.int32), slice(None)
        for k, (shift, mask, held, number) in enumerate(self.tables):
            if k:  # few are in no earlier table
                left = np.flatnonzero(out == self.none)
            some = h[left]
            at = ((some >> shift) & mask).view(np.int64)
            out[left] = np.where(held.take(at, mode="clip") == some, number.take(at, mode="clip"), self.none)
        return out

    def arcs(self, words: np.ndarray):
        """(from, to, rows, piece numbers) of all spans that are pieces, by places in the words of the matrix."""
        n, size = words.shape
        sums, down = running(np.ascontiguousarray(words).ravel())
        at = [(sums[k::size][:n], down[k::size][:n]) for k in range(size)] + [(sums[size::size], None)]
        for to in range(1, size + 1):
            for length in self.lengths:
                if length > to:
                    break
                h = (at[to][0] - at[to - length][0]) * at[to - length][1]
                rows = np.flatnonzero(self.may.take((h >> np.uint64(44)).view(np.int64)))
                if not len(rows):
                    continue
                piece = self.find(mix(h[rows]))
                found = piece != self.none
                if found.any():
                    yield to - length, to, rows[found], piece[found]

    def forward(self, words: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(words, size + 1) log-probabilities of the prefixes."""
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for a, b, at, piece in self.arcs(words):
            with np.errstate(invalid="ignore"):
                alpha[b, at] = np.logaddexp(alpha[b, at], alpha[a, at] + self.logp[piece])
            if keep is not None:
                keep.append((a, b, at, piece))
        return alpha

    def total(self, words: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words; short ones by products, without logarithms on the way."""
        n, size = words.shape
        if size > SHORT:
            return self.forward(words)[-1]
        alpha = np.zeros((size + 1, n))
        alpha[0] = 1
        for a, b, at, piece in self.arcs(words):
            alpha[b][at] += alpha[a].take(at) * self.scaled.take(piece, mode="clip")
        low = alpha[-1] < 1e-200
        out = np.log(np.where(low, 1.0, alpha[-1])) - SCALE * size
        if low.any():
            out[low] = self.forward(words[low])[-1]
        return out

    def expected(self, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """(expected uses of each piece, log-likelihood) over the words, each counted ``weights`` times."""
        return self._expected_of_short(words, weights) if words.shape[1] <= SHORT else self._expected_in_logs(words, weights)

    def _expected_in_logs(self, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        arcs: list = []
        alpha = self.forward(words, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        uses = []
        for a, b, at, piece in reversed(arcs):
            step = self.logp[piece] + beta[b, at]
            with np.errstate(invalid="ignore"):
                uses.append(np.exp(alpha[a, at] + step - alpha[-1, at]) * weights[at])
                beta[a, at] = np.logaddexp(beta[a, at], step)
        pieces = np.concatenate([x[3] for x in reversed(arcs)])
        return np.bincount(pieces, np.concatenate(uses), self.none), float(alpha[-1] @ weights)

    def _expected_of_short(self, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """The same by products of probabilities: no logarithms but for words whose products come near underflow."""
        n, size = words.shape
        alpha, beta, arcs = np.zeros((size + 1, n)), np.zeros((size + 1, n)), []
        alpha[0] = 1
        for a, b, at, piece in self.arcs(words):
            p = self.scaled.take(piece, mode="clip")
            before = alpha[a].take(at) * p
            alpha[b][at] += before
            arcs.append((a, b, at, piece, p, before))
        low = alpha[-1] < 1e-200
        beta[-1], uses = np.where(low, 0.0, weights / np.where(low, 1.0, alpha[-1])), []
        for a, b, at, _, p, before in reversed(arcs):
            after = beta[b].take(at)
            beta[a][at] += p * after
            uses.append(before * after)
        out = np.bincount(np.concatenate([x[3] for x in reversed(arcs)]), np.concatenate(uses), self.none) if arcs else np.zeros(self.none)
        like = float((np.log(alpha[-1, ~low]) - SCALE * size) @ weights[~low])
        if low.any():
            rest, more = self._expected_in_logs(words[low], weights[low])
            out, like = out + rest, like + more
        return out, like


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(numbers, matrix) of words of equal length, a word mark before each."""
    size = end - start
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, edges) if len(order) else []:
        n = int(size[same[0]])
        step = max(1, GROUP_BYTES // (n + 1))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            words = np.full((len(at), n + 1), MARK, np.uint8)
            words[:, 1:] = data[start[at][:, None] + np.arange(n)]
            yield at, words


def _merged(found: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    h = np.concatenate([x[0] for x in found])
    uniq, first, which = np.unique(h, return_index=True, return_inverse=True)
    return uniq, np.bincount(which, np.concatenate([x[1] for x in found])).astype(np.int64), pa.concat_arrays([x[2] for x in found]).take(pa.array(first))


def _word_array(w: Words, at: np.ndarray) -> pa.Array:
    size = (w.end - w.start)[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = w.bytes[np.arange(ends[-1]) + np.repeat(w.start[at] - ends[:-1], size)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _count(batches):
    held, n = [], 0

    def out():
        h, k, words = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), words, pa.array(k)], ["hash", "word", "c"])

    for batch in batches:
        for _, _, w in words_by_chunk(batch.column(0), most=WIDE_BYTES):
            if len(w):
                h, first, k = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, k, _word_array(w, first)))
                n += len(h)
            if n > 500_000:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _expected(sent):
    def run(batches):
        pieces, logp = sent.value
        lattice, total, like = Lattice(pieces, logp), np.zeros(len(pieces)), 0.0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            start, end = offsets[:-1], offsets[1:]
            count = batch.column(1).to_numpy()
            for at, words in by_length(data, start, end):
                uses, part = lattice.expected(words, count[at].astype(float))
                total, like = total + uses, like + part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int64)), pa.array(np.append(total[used], like))], ["piece", "n"])

    return run


class Known:
    """Values by 64-bit key; when full, the half that was used last stays."""

    def __init__(self):
        self.keys, self.values, self.used, self.turn = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), 0

    def get(self, keys: np.ndarray, make) -> np.ndarray:
        """Values of sorted distinct keys; ``make(mask)`` gives those of the keys that are new."""
        self.turn += 1
        if len(self.keys) > CACHE_WORDS:
            kept = self.used > np.median(self.used)
            self.keys, self.values, self.used = self.keys[kept], self.values[kept], self.used[kept]
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            joined = np.concatenate([self.keys, keys[new]])
            order = np.argsort(joined)
            self.values = np.concatenate([self.values, make(new)])[order]
            self.used = np.concatenate([self.used, np.zeros(new.sum(), np.int64)])[order]
            self.keys = joined[order]
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.turn
        return self.values[at]


#: a row per document, and for its rare words rows of their own; ``key`` is a hash of id and text, so the two
#: parts of a document meet whatever order a repeated task reads its rows in
_OUT = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, hash long, k long"


def _score(sent):
    def run(batches):
        pieces, logp, log_end, keys, logs, log_base_end, known_end = sent.value
        lattice, known = Lattice(pieces, logp), Known()
        for batch in batches:
            for a, b, w in words_by_chunk(batch.column(2), most=WIDE_BYTES):
                n = b - a
                uniq, first, which = np.unique(w.hash, return_index=True, return_inverse=True)

                def marginal(new, w=w, first=first):
                    out = np.empty(int(new.sum()))
                    for at, words in by_length(w.bytes, w.start[first[new]], w.end[first[new]]):
                        out[at] = lattice.total(words)
                    return out

                value = known.get(uniq, marginal)
                at = np.minimum(np.searchsorted(keys, uniq), max(len(keys) - 1, 0))
                common = keys[at] == uniq if len(keys) else np.zeros(len(uniq), bool)
                base = np.where(common, logs[at], 0.0) if len(keys) else np.zeros(len(uniq))
                text = np.repeat(np.arange(n), np.diff(w.first))
                per = [np.bincount(text, x, n) for x in (value[which], base[which], common[which].astype(float))]
                rows, ids = batch.column(3)[a:b].to_numpy(), batch.column(0)[a:b]
                docs = [rows, batch.column(0)[a:b], batch.column(1)[a:b], np.diff(w.first) + 1, per[2].astype(np.int64) + known_end, per[1] + log_base_end, (per[0] + log_end) / math.log(10), rows, np.zeros(n, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in docs], _names)
                rare = ~common[which]
                if rare.any():
                    pair, k = np.unique(text[rare].astype(np.int64) * len(uniq) + which[rare], return_counts=True)
                    m = len(pair)
                    of = pair // len(uniq)
                    arrays = [pa.array(rows[of]), ids.take(pa.array(of)), pa.nulls(m, pa.bool_()), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array(uniq[pair % len(uniq)].astype(np.int64)), pa.array(k.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, _names)

    return run


_names = [x.split()[0] for x in _OUT.split(", ")]


def lattice_scores(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, frequent: int = FREQUENT, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Training rows are those whose crc32 of the id as text (null: empty text) leaves another remainder
    than ``held`` modulo ``folds``.  ``score`` is the lattice model's log10 probability of the text,
    its end included; ``base_score`` that of the add-half word model.  On text of few frequent words, all
    of them known, the word model is the better one: the lattice spends probability on every way to
    spell a word and on words that never occur.

    Null and empty texts consist of the end alone.  Rows that repeat are scored each and count each
    in training.  Without training rows all counts are 0 and the pieces keep their first
    probabilities.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    sc = df.sparkSession.sparkContext
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    train = rows.where(~F.col("held_out"))
    counts = materialise(train.select("text").mapInArrow(_count, "hash long, word string, c long").groupBy("hash", "word").agg(F.sum("c").alias("c")), "word-counts")
    n_docs = train.count()
    distinct, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = tokens + n_docs, distinct + (n_docs > 0)
    # the least count that at most FREQUENT words reach: a histogram of counts, not a sort of words
    least, reach = None, 0
    for c, words in counts.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("c").desc()).collect():
        if reach + words > frequent:
            break
        least, reach = c, reach + words
    common = counts.where(F.col("c") >= least).select("hash", "c").toArrow() if least is not None else pa.table({"hash": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    keys, c = common["hash"].to_numpy().astype(np.uint64), common["c"].to_numpy()
    order = np.argsort(keys)
    floor = n + 0.5 * (v + 1)
    logs = np.log10((c[order] + 0.5) / floor)

    pieces, logp = vocabulary(vocabulary_path)
    log_end = math.log(0.01)
    before, like = -math.inf, 0.0
    for _ in range(MOST_ROUNDS if tokens else 0):
        sent = sc.broadcast((pieces, logp))
        total = np.full(len(pieces), UNSEEN)
        # a row per piece comes to the driver, and the log-likelihood under piece -1
        for piece, x in counts.select("word", "c").mapInArrow(_expected(sent), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
            if piece < 0:
                like = x
            else:
                total[piece] += x
        sent.unpersist()
        logp = np.log(total / (total.sum() + n_docs))
        log_end = math.log(n_docs / (total.sum() + n_docs))
        if like - before < tolerance * abs(like):
            break
        before = like

    sent = sc.broadcast((pieces, logp, log_end, keys[order], logs, math.log10((n_docs + 0.5) / floor), int(n_docs > 0)))
    found = rows.mapInArrow(_score(sent), _OUT)
    rare = counts.where(F.col("c") < least) if least is not None else counts
    met = found.join(rare.select("hash", "c"), "hash", "left")
    word = F.col("n_tokens").isNull()
    more = F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))
    known = F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)
    by = met.groupBy("key", "doc_id").agg(
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_known").alias("n_known"),
        F.max("base").alias("base"),
        F.max("score").alias("score"),
        F.count("n_tokens").alias("rows"),
        F.sum(F.when(word, known).otherwise(0)).alias("known"),
        F.sum(F.when(word, more).otherwise(0.0)).alias("more"),
    )
    # rows that repeat id and text sent their rare words each
    return by.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + (F.col("known") / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") / F.col("rows")).alias("base_score"),
        "score",
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("__one"),
    ).drop("__one")
