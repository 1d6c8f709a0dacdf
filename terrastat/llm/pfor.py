"""Token-id files of patched frame-of-reference blocks.

A file holds the token ids of consecutive documents as one sequence, cut into blocks.  A block
subtracts its minimum and packs the differences at the width that ``PERCENTILE`` per cent of them
fit; the rest go to the block's exception list (position, difference).  The footer indexes block
starts and documents, so a reader can seek to any document.

Layout, little-endian: ``PFOR0001`` | blocks | documents: has_id u8[d], id i64[d], n_tokens u32[d] |
block starts u64[b + 1] | footer: documents at u64, n_docs u64, n_blocks u64, n_ids u64, block size
u32, crc32 of the index u32 | ``PFOR0001``.  Block: minimum u32, width u8, unused u8, n u16,
n_exceptions u16 | packed bits, lowest first, padded to bytes | exception positions u16[] |
exception differences u32[].
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow.fs as pafs

MAGIC, BLOCK, PERCENTILE = b"PFOR0001", 1024, 95
_HEAD, _FOOT = struct.Struct("<IBBHH"), struct.Struct("<QQQQII")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a uri; file: is local, s3a: and s3n: are Hadoop's names of s3:."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    if "://" in uri and scheme != "file":
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of up to BLOCK ids each."""
    out = []
    whole = len(ids) // BLOCK * BLOCK
    parts = ([ids[:whole].reshape(-1, BLOCK)] if whole else []) + ([ids[whole:].reshape(1, -1)] if whole < len(ids) else [])
    for rows in parts:
        low = rows.min(axis=1)
        diff = (rows - low[:, None]).astype(np.uint32)
        at = min(rows.shape[1] - 1, int(np.ceil(rows.shape[1] * PERCENTILE / 100)) - 1)
        width = np.ceil(np.log2(np.partition(diff, at, axis=1)[:, at].astype(np.float64) + 1)).astype(int)
        made = [b""] * len(rows)
        for w in np.unique(width):
            sel = np.flatnonzero(width == w)
            d = diff[sel]
            bits = ((d[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(sel), -1), axis=1, bitorder="little")
            over = d >> np.uint32(w) != 0
            for k, i in enumerate(sel.tolist()):
                where = np.flatnonzero(over[k])
                made[i] = _HEAD.pack(int(low[i]), int(w), 0, d.shape[1], len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + d[k, where].astype("<u4").tobytes()
        out += made
    return out


def decode_block(raw: memoryview) -> np.ndarray:
    low, width, _, n, extra = _HEAD.unpack_from(raw)
    at, size = _HEAD.size, (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    diff = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    where = np.frombuffer(raw, "<u2", extra, at + size)
    diff[where] = np.frombuffer(raw, "<u4", extra, at + size + 2 * extra)
    return diff + np.uint32(low)


class Writer:
    """Writes one file; it appears under its name when closed, so a lost or repeated task leaves no part file."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.ids, self.held, self.n_ids = len(MAGIC), [], [], [], 0, 0

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, counts))
        self.ids.append(ids.astype(np.uint32, copy=False))
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= 256 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.ids, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        self.starts.append(self.at)
        ids = [x for d, _ in self.docs for x in d]
        counts = np.concatenate([c for _, c in self.docs]) if self.docs else np.zeros(0)
        index = np.array([x is not None for x in ids], "u1").tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + counts.astype("<u4").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index + _FOOT.pack(self.at, len(ids), len(self.starts) - 1, self.n_ids, BLOCK, zlib.crc32(index)) + MAGIC)
        self.out.close()
        self.fs.move(self.tmp, self.path)


def read_documents(uri: str, most_blocks: int = 1024):
    """(doc ids, token counts, ids of all of them) for consecutive runs of a file's documents."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        has, ids, counts, starts, _ = _index(f, uri)
        n_blocks = len(starts) - 1
        doc, rest = 0, np.zeros(0, np.uint32)
        for a in range(0, max(n_blocks, 1), most_blocks):
            b = min(a + most_blocks, n_blocks)
            raw = memoryview(f.read_at(int(starts[b] - starts[a]), int(starts[a])))
            got = [decode_block(raw[starts[i] - starts[a] : starts[i + 1] - starts[a]]) for i in range(a, b)]
            rest = np.concatenate([rest, *got])
            ends = np.cumsum(counts[doc:])
            n = int(np.searchsorted(ends, len(rest), "right"))
            if n:
                used = int(ends[n - 1])
                yield [int(x) if h else None for x, h in zip(ids[doc : doc + n], has[doc : doc + n], strict=True)], counts[doc : doc + n], rest[:used]
                doc, rest = doc + n, rest[used:]


def read_slice(uri: str, first: int, last: int):
    """(doc ids, token counts, ids) of documents ``first`` to ``last`` - 1 of a file: the block index tells where
    they begin, and only their blocks are read."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        has, ids, counts, starts, block = _index(f, uri)
        ends = np.concatenate([[0], np.cumsum(counts)])
        first, last = max(0, first), min(last, len(counts))
        if first >= last:
            return [], counts[:0], np.zeros(0, np.uint32)
        a, b = int(ends[first]) // block, -(-int(ends[last]) // block)
        raw = memoryview(f.read_at(int(starts[b] - starts[a]), int(starts[a])))
        got = np.concatenate([np.zeros(0, np.uint32), *[decode_block(raw[starts[i] - starts[a] : starts[i + 1] - starts[a]]) for i in range(a, b)]])
        skip = int(ends[first]) - a * block
        return [int(x) if h else None for x, h in zip(ids[first:last], has[first:last], strict=True)], counts[first:last], got[skip : skip + int(ends[last] - ends[first])]


def _index(f, uri: str):
    """(has id, ids, token counts, block starts, block size) from a file's footer."""
    size = f.size()
    foot = f.read_at(_FOOT.size + len(MAGIC), size - _FOOT.size - len(MAGIC))
    at, n_docs, n_blocks, _, block, crc = _FOOT.unpack_from(foot)
    index = f.read_at(size - _FOOT.size - len(MAGIC) - at, at)
    if foot[-len(MAGIC):] != MAGIC or zlib.crc32(index) != crc:
        raise ValueError(f"{uri}: damaged token file")
    counts = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    starts = np.frombuffer(index, "<u8", n_blocks + 1, 13 * n_docs).astype(np.int64)
    return np.frombuffer(index, "u1", n_docs), np.frombuffer(index, "<i8", n_docs, n_docs), counts, starts, block


def count_ids(uri: str) -> int:
    """Ids in a file, from its footer."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return _FOOT.unpack_from(f.read_at(_FOOT.size, f.size() - _FOOT.size - len(MAGIC)))[3]
