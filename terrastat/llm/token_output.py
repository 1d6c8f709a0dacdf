"""Token-ID output: documents are tokenised and written as patched frame-of-reference files.

Documents are range-partitioned by id, so files in order of partition hold them in ascending id
order, and the place of a file in the whole sequence is a sum over files, not documents.  Byte-level
BPE never merges across a white-space boundary: texts are cut before each run of white space,
a piece is encoded once and its ids reused wherever it occurs again.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .shared import materialise, scratch_path
from .wordhash import SPACE, chunks, frugal, hash_spans, text_bytes

CACHE_PIECES = 1_000_000  # pieces whose ids a worker keeps
BATCH_ROWS = 1000  # texts that go to a worker at once
CHUNK = 1 << 20  # bytes of text encoded at once
PART_BYTES = 32768  # unknown pieces are encoded in strings of about this size
#: white space that a cut must not meet, and control bytes that tokenisers class differently
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=1)
def _encoder(path: str):
    return PieceEncoder(path)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer file, remembering the ids of pieces.

    What is remembered: ``keys`` (sorted hashes of pieces), where their ids start in ``flat``, how
    many there are, and the turn in which they were last used.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocab.values()) + 2, np.int64)
        self.id_bytes[list(vocab.values())] = [len(t) for t in vocab]  # a character stands for a byte
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.keys, self.start, self.count, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.turn = np.zeros(0, np.uint32), 0

    def _ids(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, ids) of pieces: those that start with white space and end otherwise as one text,
        whose tokens are dealt out by their byte lengths, the others one by one."""
        whole = SPACE[raw[start]] & ~SPACE[raw[end - 1]]
        text = raw.tobytes()
        joined = b"".join([text[a:b] for a, b in zip(start[whole].tolist(), end[whole].tolist(), strict=True)])
        ends = np.cumsum((end - start)[whole])
        cuts = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(PART_BYTES, len(joined), PART_BYTES))], ends[-1:]]))
        parts = [joined[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        ids = np.concatenate([np.zeros(0, np.uint32)] + [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        reach = np.cumsum(self.id_bytes[ids])
        cut = np.concatenate([[0], np.searchsorted(reach, ends, "left") + 1])
        if len(ends) and (cut[-1] != len(ids) or not np.array_equal(reach[cut[1:] - 1], ends)):
            raise ValueError("tokens cross pieces: this tokenizer is not byte-level BPE")
        rest = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([text[a:b].decode() for a, b in zip(start[~whole].tolist(), end[~whole].tolist(), strict=True)], add_special_tokens=False)]
        count = np.zeros(len(start), np.int64)
        count[whole], count[~whole] = np.diff(cut), [len(x) for x in rest]
        flat = np.empty(int(count.sum()), np.uint32)
        at = np.repeat(whole, count)
        flat[at], flat[~at] = ids, np.concatenate([np.zeros(0, np.uint32), *rest])
        return count, flat

    def _learn(self, keys, raw, start, end) -> None:
        count, flat = self._ids(raw, start, end)
        begin = len(self.flat) + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.flat = np.concatenate([self.flat, flat])
        joined = [np.concatenate(x) for x in ((self.keys, keys), (self.start, begin), (self.count, count), (self.used, np.full(len(keys), self.turn)))]
        order = np.argsort(joined[0])
        self.keys, self.start, self.count, self.used = (x[order] for x in joined)

    def _forget(self) -> None:
        """Keep the half of the pieces that was used last."""
        kept = self.used > np.median(self.used)
        take = np.concatenate([[0], np.cumsum(self.count[kept])])
        self.flat = self.flat[np.arange(take[-1]) + np.repeat(self.start[kept] - take[:-1], self.count[kept])]
        self.keys, self.count, self.used, self.start = self.keys[kept], self.count[kept], self.used[kept], take[:-1]

    def encode(self, texts: pa.Array):
        """(first row, last row + 1, ids per text, ids) for runs of texts; null counts as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).copy()
        for special in self.special:  # they may hold or take white space: such texts are encoded whole
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(texts)
        for a, b in chunks(offsets, CHUNK):
            part = offsets[a : b + 1] - offsets[a]
            raw = data[offsets[a] : offsets[b]]
            if odd[a:b].any() or not len(raw):
                # one by one: the tokenizer's records of a whole chunk take many times its text
                found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts[a:b].to_pylist()]
                yield a, b, np.array([len(x) for x in found], np.int64), np.concatenate(found)
                continue
            cut = np.zeros(len(raw), bool)
            space = SPACE[raw]
            cut[1:] = space[1:] & ~space[:-1]
            cut[part[:-1][part[:-1] < len(raw)]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(raw))
            keys, first, which = np.unique(hash_spans(raw, start, end), return_index=True, return_inverse=True)
            self.turn += 1
            if len(self.keys) > CACHE_PIECES:
                self._forget()
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = at < len(self.keys)
            new[inside] = self.keys[at[inside]] != keys[inside]
            if new.any():
                self._learn(keys[new], raw, start[first[new]], end[first[new]])
                at = np.searchsorted(self.keys, keys)
            self.used[at] = self.turn
            begin, length = self.start[at][which], self.count[at][which]
            ends = np.concatenate([[0], np.cumsum(length)])
            take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)
            per_text = ends[np.searchsorted(start, part)]
            yield a, b, np.diff(per_text), self.flat[take]


def _with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), end_id)


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, id_col="doc_id", text_col="text", end_id: int = 0) -> DataFrame:
    """Write the files and return their manifest: ``part, path, n_docs, start`` (ids in the files before)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        path, n_docs, writer, encoder = f"{folder}/part-{part:06d}.pfor", 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer, encoder = writer or pfor.Writer(path), encoder or _encoder(tokenizer_path)
            ids = batch.column(0).to_pylist()
            for a, b, counts, tokens in encoder.encode(batch.column(1)):
                writer.add(ids[a:b], counts + 1, _with_end(counts, tokens, end_id))
            n_docs += batch.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = materialise(dealt.mapInArrow(frugal(run), "part long, path string, n_docs long, n_ids long"), "token-manifest", BATCH_ROWS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", "path", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the manifest's files."""

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, counts, ids in pfor.read_documents(path):
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    out = {
                        "doc_id": pa.array(docs, pa.int64()),
                        "start": pa.array(at + ends[:-1], pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))
                    yield pa.RecordBatch.from_pydict(out)
                    at += int(ends[-1])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_output(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col="doc_id", text_col="text", end_id: int = 0) -> DataFrame:
    """Encode, write and read back: ``doc_id, start, n_tokens, ids_crc32`` per row, from the files.

    Every text's ids (special strings in a text as the tokenizer file treats them) are followed by
    ``end_id``; ``start`` counts the ids of all rows before in ascending id order.

    Null texts count as empty and give the end id alone.  Null ids come first.  Rows that repeat an
    id stand side by side, ordered by a hash of their texts, each with its own start; an id with many
    texts may spread over several files.  Other columns are ignored, whatever their names; an empty table writes no file and gives no rows.
    """
    folder = folder or scratch_path(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, folder, tokenizer_path, id_col, text_col, end_id))
