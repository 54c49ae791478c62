"""Sum-of-squares online packing of token sequences, streamed through each partition.

A document's ids are cut into whole windows and a rest. Each rest goes to the fill level that makes the sum of squared
counts of partially filled windows least; the counts stand in one array, one entry a level. The windows that are still
open at the end are closed by the same rule: the emptiest is taken apart and its pieces are placed again, now cut where
they overflow, until one window is left, which is cut into lengths that are powers of two and so are not padded. The
same is done to one window at a time where more than a bound are open.

Ids come from the tokenizer, asked once for each run of white space and following word that a worker's table does not
hold: the byte level pre-tokenizer never matches across the start of a white-space run, so these pieces can be encoded
apart, or joined in any order. The table goes by a piece's 64-bit hash and length, in numpy; pieces of over 64 bytes
are not kept in it. Texts with white space other than ASCII, where pieces are not independent, are encoded whole.

Defined results: a null or empty text is the closing id alone; repeated rows, and rows with a null doc_id, are each
packed; a text of any length is cut into as many pieces as it needs; an empty table gives no rows; other columns are
left out. Sequence ids hold the partition's number, so a task that runs again after a lost executor makes the same ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import table

WINDOW = 1024
END_ID = 0
MAX_OPEN = 4096  # open windows a task; beyond it the emptiest is placed again
TABLE_BITS = 20  # slots of the table of known pieces, which starts anew when three in four are taken
LONGEST_KEPT = 64  # bytes of a piece in the table
JOINED = 2_048  # pieces are encoded in texts of about so many bytes
ODD_LEAD = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, .. of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Known:
    """Ids of pieces by hash: each has two slots, and takes the first that is free, or else the second."""

    def __init__(self):
        self.shifts = [np.uint64(64 - TABLE_BITS), np.uint64(64 - 2 * TABLE_BITS)]
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(1 << TABLE_BITS, np.uint64)
        self.begin, self.size, self.bytes = (np.zeros(1 << TABLE_BITS, t) for t in (np.uint32, np.uint8, np.uint8))
        self.ids = np.zeros(1 << TABLE_BITS, np.uint32)
        self.used = self.pieces = 0

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> s) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64) for s in self.shifts]

    def find(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The slot of each piece of hash h and n bytes, or -1."""
        first, second = self.slots(h)
        here = (self.hash[first] == h) & (self.bytes[first] == n)
        out = np.where(here, first, -1)
        rest = np.flatnonzero(~here)
        second = second[rest]
        there = (self.hash[second] == h[rest]) & (self.bytes[second] == n[rest])
        out[rest[there]] = second[there]
        return out

    def add(self, h: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct pieces, their ids one after the other."""
        if self.pieces + len(h) > 3 << TABLE_BITS - 2:
            self.clear()
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.pieces += len(h)
        first, second = self.slots(h)
        slot = np.where(self.bytes[first] == 0, first, second)
        # of several pieces that meet in a slot numpy keeps the last in every array
        self.hash[slot], self.bytes[slot], self.size[slot], self.begin[slot] = h, n, size, begin


class Encoder:
    """Token ids of text columns. One is kept in each Python worker."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token's name is a byte
        for name, i in vocabulary.items():
            self.bytes_of[i] = len(name)
        self.known = Known()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and each one's number of ids.

        Pieces that start with white space and end without are joined; the others, at most two a text, go alone."""
        n = end - start
        alone = ~W.SEPARATOR[data[start]] | W.SEPARATOR[data[end - 1]]
        size = np.zeros(len(start), np.int64)
        many, few = np.flatnonzero(~alone), np.flatnonzero(alone)
        joined = data[spread(start[many], n[many])].tobytes()
        ends = np.cumsum(n[many])
        bounds = np.unique(np.append(np.searchsorted(ends, np.arange(JOINED, len(joined), JOINED)), len(many)))
        texts, a = [], 0
        for i in bounds[bounds > 0].tolist():
            texts.append(joined[a : ends[i - 1]].decode())
            a = ends[i - 1]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.whole(texts)])
        size[many] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right"), prepend=0)
        single = self.whole([data[a:b].tobytes().decode() for a, b in zip(start[few].tolist(), end[few].tolist(), strict=True)])
        size[few] = [len(x) for x in single]
        out = np.zeros(size.sum(), np.uint32)
        begin = np.cumsum(size) - size
        out[spread(begin[many], size[many])] = ids
        out[spread(begin[few], size[few])] = np.concatenate([np.zeros(0, np.uint32), *single])
        return out, size

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's closed by end_id, and the n + 1 offsets of the texts in it."""
        data, offsets = W.bytes_of(column)
        texts = len(offsets) - 1
        raw = data.tobytes()
        maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(ODD_LEAD[data]), side="right") - 1).tolist()
        odd = [i for i in maybe if ODD_SPACE.search(raw, offsets[i], offsets[i + 1])]
        cut = np.zeros(len(data), bool)
        space = W.SEPARATOR[data]
        cut[1:] = space[1:] & ~space[:-1]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))[: len(start)]
        size, begin = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        regular = np.ones(len(start), bool)
        for i in odd:
            regular[np.searchsorted(start, offsets[i]) : np.searchsorted(start, offsets[i + 1])] = False
        at = np.flatnonzero(regular)
        n = end[at] - start[at]
        h = W.Spans(data).of(start[at], end[at])
        slot = self.known.find(h, n)
        have = slot >= 0
        size[at[have]], begin[at[have]] = self.known.size[slot[have]], self.known.begin[slot[have]]
        from_table = self.known.ids
        new = np.flatnonzero(~have)
        # long pieces are told apart by their place, not by their hash
        _, first, which = np.unique(np.where(n[new] > LONGEST_KEPT, new.astype(np.uint64), h[new]), return_index=True, return_inverse=True)
        one = new[first]
        ids, sizes = self.pieces(data, start[at[one]], end[at[one]])
        begins = np.cumsum(sizes) - sizes
        size[at[new]], begin[at[new]] = sizes[which], begins[which]
        made = np.zeros(len(start), bool)  # pieces whose ids lie in ``ids``
        made[at[new]] = True
        # all ids: those of each text, then the closing one
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        out = np.zeros(total[-1], np.uint32)
        for source, mine in ((from_table, ~made & regular), (ids, made)):
            out[spread(total[:-1][mine], size[mine])] = source[spread(begin[mine], size[mine])]
        keep = n[one] <= LONGEST_KEPT
        self.known.add(h[one][keep], n[one][keep], ids[spread(begins[keep], sizes[keep])], sizes[keep])
        bounds = total[np.searchsorted(start, offsets)]
        if odd:
            each = [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i, ids_of in zip(odd, self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in odd]), strict=True):
                each[i] = ids_of
            bounds = np.cumsum([0, *(len(x) for x in each)])
            out = np.concatenate(each)
        return np.insert(out, bounds[1:], end_id), bounds + np.arange(texts + 1)


Piece = tuple[Any, int, np.ndarray, int]  # doc_id, start in its document, ids, tokens of its document


class Packer:
    """Open windows by fill level. ``counts[h]`` of them hold h ids; closed ones go to ``done`` as (pieces)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1)
        self.counts[window] = -0.5  # a full window stops counting: 2 * -0.5 + 2 is its share of 1
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def add(self, doc_id: Any, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self.done.append([(doc_id, a, ids[a : a + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc_id, whole, ids[whole:], len(ids)))
            while self.open > self.max_open:
                self.take_apart()

    def place(self, piece: Piece) -> None:
        """Into the level, or a new window, that makes the sum of squares least."""
        size, counts = len(piece[2]), self.counts
        # change of the sum of squares if a window of h ids becomes one of h + size
        change = 2 * (counts[size + 1 :] - counts[1 : self.window - size + 1]) + 2
        change[counts[1 : self.window - size + 1] <= 0] = np.inf
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1  # of equals the fullest
        self.put(best + 1 if best >= 0 and change[best] <= 2 * counts[size] + 1 else 0, piece)

    def place_cut(self, piece: Piece) -> None:
        """Into the open level that makes the sum of squares least, where what overflows a window is cut and placed again."""
        counts = self.counts
        while len(piece[2]) and self.open:
            size = len(piece[2])
            after = np.minimum(np.arange(1, self.window) + size, self.window)
            change = 2 * (counts[after] - counts[1 : self.window]) + 2
            change[counts[1 : self.window] <= 0] = np.inf
            level = self.window - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            room = self.window - level
            self.put(level, (piece[0], piece[1], piece[2][:room], piece[3]))
            piece = (piece[0], piece[1] + room, piece[2][room:], piece[3])
        if len(piece[2]):
            self.put(0, piece)

    def put(self, level: int, piece: Piece) -> None:
        pieces = self.levels[level].pop() if level else []
        pieces.append(piece)
        if level:
            self.counts[level] -= 1
            self.open -= 1
        level += len(piece[2])
        if level == self.window:
            self.done.append(pieces)
        else:
            self.levels[level].append(pieces)
            self.counts[level] += 1
            self.open += 1

    def take_apart(self) -> None:
        """Places the pieces of the emptiest window again, in the other windows."""
        level = int(np.argmax(self.counts[: self.window] > 0))
        pieces = self.levels[level].pop()
        self.counts[level] -= 1
        self.open -= 1
        for piece in pieces:
            self.place_cut(piece)

    def close(self) -> None:
        """The end: open windows are placed in one another; what fills no window is cut into powers of two."""
        while self.open > 1:
            self.take_apart()
        loose = next((w for level in self.levels for w in level), [])
        left = sum(len(p[2]) for p in loose)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                doc_id, start, ids, tokens = loose.pop(0)
                taken.append((doc_id, start, ids[:want], tokens))
                if len(ids) > want:
                    loose.insert(0, (doc_id, start + want, ids[want:], tokens))
                want -= len(taken[-1][2])
            self.done.append(taken)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece of docs(doc_id, text): its ids (little-endian unsigned 32 bits) and its place in a sequence."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer), Packer(window)
        base = TaskContext.get().partitionId() << 33
        made = 0
        id_type = pa.int64()

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if packer.done:
                flat = [(*p, base + made + i, o) for i, s in enumerate(packer.done) for p, o in zip(s, np.cumsum([0, *(len(p[2]) for p in s)]).tolist()[:-1], strict=True)]
                made += len(packer.done)
                packer.done = []
                ids, start, parts, tokens, sequence, offset = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(start, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array(tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for part in W.chunks(batches):
            id_type = part.column("doc_id").type
            flat, bounds = encoder.encode(part.column("text"), end_id)
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                packer.add(doc_id, flat[a:b])
            yield from rows()
        packer.close()
        yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_checksum(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_of(docs: DataFrame) -> DataFrame:
    """The pieces with production parameters, their ids as a checksum."""
    import public_tokenizers

    return with_checksum(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_of(table(spark, sf_dir, "documents"))
