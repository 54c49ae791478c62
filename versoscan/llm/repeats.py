"""Repeated runs of words across documents, found from content-selected anchors.

A window is n consecutive words of one document. Its anchor is its least k-gram by hash (the leftmost of equals), so
equal windows have their anchors at the same place, and neighbouring windows mostly share one: an *occurrence* is an
anchor with the range of windows it serves, and its *context* is the words of those windows. Occurrences whose anchor
is found once cannot repeat and drop out. Equal contexts repeat whole, whatever their number, and are counted by a
partially aggregated sum; only distinct contexts of one anchor ("open" ones) need their words compared. They are
sorted by the words behind the anchor, and every one meets, at each length of common words to the right, the one that
shares most words to the left (``block_matches``). Blocks of more than BLOCK contexts are not held by one task: their
windows are compared by hash instead, which gives the same.

Documents are told apart by doc_id and a hash of the text, so repeated rows and null ids do no harm.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import cut, joined_apart

BLOCK = 4096  # distinct contexts of one anchor that a task holds
ENTRY = ["anchor", "right", "left", "doc_id", "key", "at"]
SIZE_BITS = 16  # of a packed range of windows: first window << SIZE_BITS | number of windows


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), text without nulls."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def occurrences(words: W.Words, hashes: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, context hash, anchor's word, first window, number of windows; all windows are served once."""
    starts = W.windows(words, n)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    grams = len(hashes) - k + 1
    at = np.arange(grams)
    gram = W.Runs(hashes).of(at, at + k)
    # the least of the window's k-grams: hash above, place below, so that the leftmost of equals wins
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, have = n - k + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(first, len(starts)))
    low, anchor = starts[first], anchor[first]
    context = W.Runs(hashes, 1).of(low, low + size + n - 1) ^ W.mix((anchor - low).astype(np.uint64))
    return gram[anchor], context, anchor, low, size


def count_anchors(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(anchor, n): anchors with more than one occurrence, counted within each chunk before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            words = W.find_words(part.column("text"))
            anchors, times = np.unique(occurrences(words, W.word_hashes(words), n, k)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(times)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def find_occurrences(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(anchor, context, doc_id, key, place): place packs the first window (a word's index in its document) and the number of windows."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            words = W.find_words(part.column("text"))
            anchor, context, _, low, size = occurrences(words, W.word_hashes(words), n, k)
            of = words.text[low] if len(low) else low
            place = (low - words.first[of]) << SIZE_BITS | size
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), part.column("doc_id").take(take), part.column("key").take(take), pa.array(place)],
                names=["anchor", "context", "doc_id", "key", "place"],
            )

    return docs.select("doc_id", "key", "text").mapInArrow(run, f"anchor long, context long, doc_id {kind}, key long, place long")


def repeated_contexts(docs: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """From keyed documents: the ranges whose whole context repeats (doc_id, key, place), and one occurrence
    (anchor, doc_id, key, place, n, block) of each context of anchors that have several, ``block`` their number."""
    candidates = cut(joined_apart(find_occurrences(docs, n, k), cut(count_anchors(docs, n, k)), ["anchor"]))
    one = F.struct("doc_id", "key", "place")
    contexts = cut(candidates.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(one).alias("one")))
    several = cut(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("block", F.col("n")))
    whole = joined_apart(candidates, contexts.where("n > 1").select("anchor", "context", "n"), ["anchor", "context"]).select("doc_id", "key", "place")
    opened = joined_apart(contexts, several, ["anchor"], keep=("block",)).select("anchor", "one.doc_id", "one.key", "one.place", "n", "block")
    return whole, opened


def common(a: str, b: str) -> int:
    """How many leading words two runs share; every word ends with a space."""
    if a == b:
        return a.count(" ")
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a.count(" ", 0, low)


def block_matches(right: list[str], left: list[str], n: int) -> list[tuple[int, int, int]]:
    """(entry, l, r): maximal matches of at least n words of entries sorted by ``right``, the words from the seed on;
    ``left`` are the words before it, backwards.

    Neighbours in the sorted order are merged into intervals, from the longest common words to the shortest. When two
    intervals meet at r common words, the entries of the smaller are put among those of the larger in the order of
    ``left``; an entry shares most words to the left with a neighbour there. Of an entry's matches only those are kept
    that reach further left than all with more words to the right, so no word of any match of n words is missed.
    """
    shared = [0, *(common(a, b) for a, b in zip(right, right[1:], strict=False))]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    rank = [0] * len(left)
    for place, x in enumerate(by_left):
        rank[x] = place
    interval = [[place] for place in rank]  # of each entry: its interval's entries, as ranks in order
    furthest = [-1] * len(left)
    out = []
    for i in sorted(range(1, len(right)), key=lambda i: -shared[i]):
        small, large = sorted((interval[i - 1], interval[i]), key=len)
        for place in small:
            at = bisect_left(large, place)
            x = by_left[place]
            for near in large[max(0, at - 1) : at + 1]:
                y = by_left[near]
                l = common(left[x], left[y])  # noqa: E741
                if l + shared[i] >= n:
                    for z in (x, y):
                        if l > furthest[z]:
                            furthest[z] = l
                            out.append((z, l, shared[i]))
            large.insert(at, place)
            interval[x] = large
    return out


def _entries(docs: DataFrame, opened: DataFrame, n: int, k: int) -> DataFrame:
    """The seeds of open contexts: the next n words, the n words before them backwards, and the seed's word."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            words = W.find_words(part.column("text"))
            anchors, _, at, low, _ = occurrences(words, W.word_hashes(words), n, k)
            places, row = expand(part)
            mine = np.searchsorted(low, words.first[row] + (places >> SIZE_BITS))  # the occurrence at each place
            at, anchors = at[mine], anchors[mine]
            raw = words.data.tobytes()
            start, end = words.start.tolist(), words.end.tolist()
            right, left = [], []
            for i, r in zip(at.tolist(), row.tolist(), strict=True):
                a, b = max(int(words.first[r]), i - n), min(int(words.first[r + 1]), i + n)
                right.append("".join(raw[start[j] : end[j]].decode() + " " for j in range(i, b)))
                left.append("".join(raw[start[j] : end[j]].decode() + " " for j in range(i - 1, a - 1, -1)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(right, pa.string()), pa.array(left, pa.string()), part.column("doc_id").take(take), part.column("key").take(take), pa.array(at - words.first[row])],
                names=ENTRY,
            )

    return with_places(docs, opened, "inner").mapInArrow(run, f"anchor long, right string, left string, doc_id {kind}, key long, at long")


def extended(docs: DataFrame, opened: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, key, place): the windows in the maximal matches of open contexts, in blocks of at most BLOCK."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.int64()]

        def places() -> list[tuple]:
            if len(block) < 2:
                return []
            found = block_matches([x[1] for x in block], [x[2] for x in block], n)
            return [(block[i][3], block[i][4], (block[i][5] - l) << SIZE_BITS | (l + r - n + 1)) for i, l, r in found]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "key", "place"])

        for batch in batches:
            kinds[0] = batch.column("doc_id").type
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ENTRY), strict=True):
                if block and block[-1][0] != row[0]:
                    out += places()
                    block = []
                block.append(row)
            if out:
                yield made(out)
        if out := places():
            yield made(out)

    sorted_ = _entries(docs, opened, n, k).repartition("anchor").sortWithinPartitions(*ENTRY)
    return sorted_.mapInArrow(run, f"doc_id {kind}, key long, place long")


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Keyed documents with ``places``, the list of the distinct rows of places(doc_id, key, place) of each.

    Repeated rows share their doc_id and key; without the distinct each would add its places to the list of all."""
    lists = places.select("doc_id", "key", "place").distinct().groupBy("doc_id", "key").agg(F.collect_list("place").alias("places")).hint("shuffle_hash")
    return docs.join(lists, same_document(docs, lists), how).select(docs["doc_id"], docs["key"], docs["text"], lists["places"])


def expand(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The packed places of a batch, and the row of each."""
    lists = part.column("places")
    size = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64) if lists.null_count else np.diff(np.asarray(lists.offsets, np.int64))
    return np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(size)), size)


def _windows(docs: DataFrame, opened: DataFrame, n: int) -> DataFrame:
    """(h1, h2, doc_id, key, place, single): each window of the open contexts; single if its context is found once."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            words = W.find_words(part.column("text"))
            hashes = W.word_hashes(words)
            places, row = expand(part)
            single, places = (places & 1).astype(bool), places >> 1
            size = places & ((1 << SIZE_BITS) - 1)
            of = np.repeat(np.arange(len(places)), size)
            local = np.repeat(places >> SIZE_BITS, size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            row = row[of]
            start = words.first[row] + local
            h1, h2 = (W.Runs(hashes, lane).of(start, start + n).view(np.int64) for lane in (0, 1))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), part.column("doc_id").take(take), part.column("key").take(take), pa.array(local << SIZE_BITS | 1), pa.array(single[of])],
                names=["h1", "h2", "doc_id", "key", "place", "single"],
            )

    marked = opened.select("doc_id", "key", F.shiftleft("place", 1).bitwiseOR((F.col("n") == 1).cast("long")).alias("place"))
    return with_places(docs, marked, "inner").mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, key long, place long, single boolean")


def repeated_open_windows(docs: DataFrame, opened: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, place): the windows of open contexts found once that start anywhere else too."""
    windows = _windows(docs, opened, n)  # made twice, from one shuffle of the texts that the last join uses too
    # a context that is found several times repeats whole already, and counts as one start here
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    return windows.where("single").join(twice.hint("shuffle_hash"), ["h1", "h2"]).select("doc_id", "key", "place")


def repeated_windows(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, key, place) of keyed documents: packed ranges of the windows that start anywhere else too."""
    whole, opened = repeated_contexts(docs, n, k)
    opened = cut(opened)
    found = whole.unionByName(extended(docs, opened.where(F.col("block") <= BLOCK), n, k))
    large = opened.where(F.col("block") > BLOCK)
    return found if large.isEmpty() else found.unionByName(repeated_open_windows(docs, large, n))
