"""Simple-8b: ids packed in 64-bit words, and a file format of blocks of such words.

A word's low 4 bits select how its other 60 are cut: COUNTS[s] ids of BITS[s] bits each, the first
in the lowest bits. Selector 0 is the escape for an id that 60 bits can't hold: the 60 bits number
an entry of the file's list of escapes. An encoder takes for each word the selector that packs most
of the next ids.

Ids are cut in blocks of BLOCK; a block starts with a word of its own and its last word is filled
up with zeros. As the offset of each block's first word is kept, blocks are decoded apart, and all
words of many blocks at once by array operations, selector by selector.

File: MAGIC; words; then as little-endian 64-bit arrays: block offsets in words (one more than
blocks), escapes, document ids, tokens of each document; as bytes: whether a document has an id; and
the TAIL: numbers of ids, blocks, escapes and documents, and MAGIC again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

BLOCK = 1024
MAGIC = b"LSS8B\x00\x00\x01"
TAIL = struct.Struct("<4Q8s")
#: How selectors 1 to 14 cut 60 bits; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def encode(ids: np.ndarray, escapes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of ids, as uint64 and int64; appends to escapes."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    end = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    best = np.zeros(n, dtype=np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        small = ids < np.uint64(1 << int(BITS[s]))
        where = np.flatnonzero(small)
        if not len(where):
            break
        if len(where) == n:  # beyond the block's end, zeros fill the word
            best[:] = s
            continue
        # the end of the run of small ids that each is in
        lasts = np.append(np.flatnonzero(np.diff(where) != 1), len(where) - 1)
        stop = np.repeat(where[lasts] + 1, np.diff(lasts, prepend=-1))
        best[where[(stop - where >= COUNTS[s]) | (stop >= end[where])]] = s
    at = np.arange(0, n, BLOCK)
    ends = end[at]
    block = np.arange(len(at))
    starts, owners = [], []
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + COUNTS[best[at]]
        more = at < ends
        at, block, ends = at[more], block[more], ends[more]
    starts, owners = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(starts, kind="stable")
    starts, owners = starts[order], owners[order]
    selectors = best[starts]
    words = selectors.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint64)])
    for s in np.unique(selectors):
        where = np.flatnonzero(selectors == s)
        if s == 0:
            first = len(escapes)
            escapes.extend(int(x) for x in ids[starts[where]])
            words[where] |= (np.arange(len(where), dtype=np.uint64) + np.uint64(first)) << np.uint64(4)
            continue
        stop = end[starts[where]]
        for k in range(int(COUNTS[s])):
            place_k = starts[where] + k
            value = np.where(place_k < stop, padded[place_k], np.uint64(0))
            words[where] |= value << np.uint64(4 + k * int(BITS[s]))
    return words, np.bincount(owners, minlength=-(-n // BLOCK)).astype(np.int64)


def decode(words: np.ndarray, block_words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The n ids of whole blocks, given all their words and the words of each."""
    selectors = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selectors]
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    out = np.empty(total, np.uint64)
    payload = words >> np.uint64(4)
    for s in np.unique(selectors):
        where = np.flatnonzero(selectors == s)
        if s == 0:
            out[first[where]] = escapes[payload[where].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[first[where] + k] = (payload[where] >> np.uint64(k * int(BITS[s]))) & mask
    if total == n:
        return out
    # the zeros that fill up blocks go
    stops = np.append(first, total)[np.cumsum(block_words)]
    begins = np.append(0, stops[:-1])
    sizes = np.minimum(BLOCK, n - BLOCK * np.arange(len(block_words)))
    keep = np.zeros(total + 1, np.int64)
    np.add.at(keep, begins, 1)
    np.add.at(keep, begins + sizes, -1)
    return out[np.cumsum(keep[:-1]) > 0]


class Writer:
    """Writes documents to a file as they come; holds STEP ids and the index."""

    STEP = BLOCK * 256

    def __init__(self, file: BinaryIO):
        self.file, self.pending, self.held = file, [], 0
        self.escapes: list[int] = []
        self.block_words, self.docs, self.known, self.sizes, self.n_ids = [], [], [], [], 0
        file.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with their ids one after another and the number of each one's."""
        self.docs += [d or 0 for d in docs]
        self.known += [d is not None for d in docs]
        self.sizes += sizes.tolist()
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.STEP:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint64)
        for i in range(0, n, self.STEP):
            words, sizes = encode(ids[i : min(i + self.STEP, n)], self.escapes)
            self.file.write(words.astype("<u8").tobytes())
            self.block_words.append(sizes)
        self.n_ids += n
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        offsets = np.append(0, np.cumsum(np.concatenate([*self.block_words, np.empty(0, np.int64)])))
        for part in (offsets.astype("<u8"), np.array(self.escapes, "<u8"), np.array(self.docs, "<i8"), np.array(self.sizes, "<u8"), np.array(self.known, np.uint8)):
            self.file.write(part.tobytes())
        self.file.write(TAIL.pack(self.n_ids, len(offsets) - 1, len(self.escapes), len(self.docs), MAGIC))


def read(file: BinaryIO, blocks: int = 256) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, whether the document ends here, ids) in order, from `blocks` blocks at a time: a
    long document comes in pieces. The file must be seekable."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(size - TAIL.size)
    n_ids, n_blocks, n_escapes, n_docs, magic = TAIL.unpack(file.read(TAIL.size))
    file.seek(0)
    if magic != MAGIC or file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    file.seek(size - TAIL.size - 8 * (n_blocks + 1 + n_escapes + 2 * n_docs) - n_docs)
    take = lambda kind, n: np.frombuffer(file.read(np.dtype(kind).itemsize * n), kind)
    offsets, escapes, docs, sizes, known = take("<u8", n_blocks + 1).astype(np.int64), take("<u8", n_escapes), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64), take("u1", n_docs)
    ends = np.cumsum(sizes)
    doc = 0
    for b in range(0, max(n_blocks, 1), blocks):
        stop = min(b + blocks, n_blocks)
        file.seek(len(MAGIC) + 8 * int(offsets[b]))
        words = take("<u8", int(offsets[stop] - offsets[b]))
        at, n = b * BLOCK, min(stop * BLOCK, n_ids) - b * BLOCK
        ids = decode(words, np.diff(offsets[b : stop + 1]), n, escapes)
        while doc < n_docs and (ends[doc] <= at + n):
            begin = max(int(ends[doc] - sizes[doc]) - at, 0)
            yield (int(docs[doc]) if known[doc] else None), True, ids[begin : int(ends[doc]) - at]
            doc += 1
        if doc < n_docs and (begin := max(int(ends[doc] - sizes[doc]) - at, 0)) < n:
            yield (int(docs[doc]) if known[doc] else None), False, ids[begin:]
