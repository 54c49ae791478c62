"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Words are lower-cased (A-Z) and split at white space and ASCII punctuation. A walk over a word sequence emits a word a
step and moves on or stays by a random bit of (step, word), so that sequences a few edits apart mostly emit the same
words at the same steps: edit distance becomes Hamming distance. Each walk is sampled at a few pairs of steps; a
window and an item that agree on one of these pairs are candidates, and the edit distance of each candidate is then
computed exactly. With the default four walks of ten pairs the recall at the largest allowed distance is above 0.95
(tests measure it).

A window starts at every word. Before walking, windows are passed over that cannot match: an edit breaks at most two of
an item's pairs of neighbouring words, so a window that holds fewer of the benchmark's pairs than must be left is ruled
out exactly.

An item matches where the edit distance in words is at most ``share`` of the item's words; one of fewer than five words
thus allows no edit, and is found by the hash of its run of words. Result: one row a document and item, the match with
the fewest edits (of equals the first; further occurrences are not listed): doc_id, item_id, start, end (code points),
edits, item_words. Defined results: null or blank texts and items, and items of fewer than ``least_words`` words, match
nothing; repeated rows give repeated results; rows with a null id are searched like others; equal items match alike,
each under its own id; empty tables give none; other columns are left out; whole texts are searched whatever their length.

The benchmark is a stated query set: the driver reads it in blocks of ``block_bytes`` of text and holds them all, and
each block is one more pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import table

SHARE = 0.2
LEAST_WORDS = 1
SHORT = 5  # words of an item from which the walks look for it; shorter ones must be found as they are
WALKS, PAIRS = 4, 10
EARLY = 24  # steps from which every other pair is drawn: edits shift the two walks apart step by step
BLOCK_BYTES = 4 << 20  # of benchmark text that is sent to the executors at once; a larger benchmark goes in blocks
SEPARATOR = W.SEPARATOR.copy()
SEPARATOR[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Band(NamedTuple):
    """Items of similar length: the sampled steps of each walk, and the items' keys in order."""

    low: int
    high: int
    need: int  # pairs of neighbouring words that a match shares with its item at least
    reach: int  # words that a match spans at most
    steps: np.ndarray  # walks x pairs x 2
    keys: np.ndarray
    items: np.ndarray


class Members:
    """A set of 64-bit hashes: two tables at different bits of the hash, and what both had no place for."""

    def __init__(self, values: np.ndarray):
        values = np.unique(values)
        bits = max(12, int(max(len(values), 1)).bit_length() + 4)
        self.shifts = [np.uint64(64 - bits), np.uint64(max(0, 64 - 2 * bits))]
        self.mask = np.uint64((1 << bits) - 1)
        self.tables = []
        for shift in self.shifts:
            place = ((values >> shift) & self.mask).astype(np.int64)
            t = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
            t[place] = values
            self.tables.append(t)
            values = values[t[place] != values]
        self.rest = values

    def has(self, x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), bool)
        for t, shift in zip(self.tables, self.shifts, strict=True):
            found |= t[((x >> shift) & self.mask).astype(np.int64)] == x
        return found | np.isin(x, self.rest) if len(self.rest) else found


def neighbours(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    return W.mix(hashes[:-1] * np.uint64(3) + hashes[1:])


def tagged(pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
    return W.mix(pairs ^ W.mix(item + np.uint64(1)))


class Benchmark(NamedTuple):
    ids: list[Any]
    words: list[np.ndarray]  # hashes of each item's words
    flat: np.ndarray  # all of them, one after the other
    begin: np.ndarray  # where each item starts there
    short: list[tuple[int, np.ndarray, np.ndarray]]  # items of fewer than SHORT words: their length, hashes in order, items
    pairs: Members
    own_pairs: Members  # each pair of neighbouring words with its item's number mixed in
    bands: list[Band]
    share: float


def allowed(n: int, share: float) -> int:
    return int(share * n + 1e-9)


def embed(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The words that the walk from each start emits, steps x starts; zero behind a sequence's end."""
    at = start.copy()
    out = np.zeros((steps, len(start)), np.uint64)
    last = max(len(hashes) - 1, 0)
    for j in range(steps):
        out[j] = np.where(at < stop, hashes[np.minimum(at, last)], np.uint64(0)) if len(hashes) else 0
        at += (W.mix(out[j] ^ np.uint64((walk << 32) + j + 1)) & np.uint64(1)).astype(np.int64)
    return out


def keys_of(emitted: np.ndarray, pairs: np.ndarray, walk: int) -> np.ndarray:
    """pairs x starts: the sampled words of each pair of steps in one key."""
    tag = (np.arange(len(pairs)) + 1000 * (walk + 1)).astype(np.uint64)[:, None]
    return W.mix(W.mix(emitted[pairs[:, 0]] + tag) * np.uint64(3) + emitted[pairs[:, 1]])


def prepare(rows: list[tuple[Any, str]], share: float = SHARE, least_words: int = LEAST_WORDS, walks: int = WALKS, pairs: int = PAIRS) -> Benchmark:
    words = W.find_words(pa.array([t or "" for _, t in rows], pa.large_string()), SEPARATOR, LOWER)
    hashes = W.word_hashes(words)
    items = [(i, hashes[a:b]) for (i, _), a, b in zip(rows, words.first[:-1], words.first[1:], strict=True) if b - a >= least_words]
    ids, sequences = [i for i, _ in items], [s for _, s in items]
    sizes = np.array([len(s) for s in sequences], np.int64)
    flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    bands, low, random = [], max(SHORT, least_words), np.random.default_rng(7)
    while len(sizes) and low <= sizes.max():
        high = max(low, int(low * 1.15))
        steps = random.integers(0, max(4, int(1.5 * low)), (walks, pairs, 2))
        steps[:, ::2] = random.integers(0, min(max(4, int(1.5 * low)), EARLY), (walks, -(-pairs // 2), 2))
        mine = np.flatnonzero((sizes >= low) & (sizes <= high))
        if len(mine):
            keys = [keys_of(embed(flat, begin[mine], (begin + sizes)[mine], w, int(steps.max()) + 1), steps[w], w) for w in range(walks)]
            keys, of = np.stack(keys).reshape(-1), np.tile(mine, walks * pairs)
            order = np.argsort(keys, kind="stable")
            need = min(int(n) - 1 - 2 * allowed(int(n), share) for n in sizes[mine])
            bands.append(Band(low, high, need, high + allowed(high, share), steps, keys[order], of[order]))
        low = high + 1
    runs, short = W.Runs(flat), []
    for n in range(1, SHORT):
        if len(mine := np.flatnonzero(sizes == n)):
            keys = runs.of(begin[mine], begin[mine] + n)
            order = np.argsort(keys, kind="stable")
            short.append((n, keys[order], mine[order]))
    pairs_ = [neighbours(x) for x in sequences]
    own = [tagged(x, np.array([i], np.uint64)) for i, x in enumerate(pairs_)]
    both = (Members(np.concatenate(x) if x else flat) for x in (pairs_, own))
    return Benchmark(ids, sequences, flat, begin, short, *both, bands, share)


def edits(items: np.ndarray, sizes: np.ndarray, text: np.ndarray, room: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance of its item and a beginning of its text, if at most ``most`` (else most + 1),
    and how long that beginning is: of equals the one nearest to the item's length, then the shorter.

    items and text hold a row's words, ``sizes`` and ``room`` how many of them count; text has a column for every place
    up to the longest item and the largest ``most``. Only the band of lengths within ``most`` of the item's is kept: a
    column stands for that difference, and a row of the table is one numpy step for all rows at once.
    """
    widest = int(most.max(initial=0))
    shift = np.arange(-widest, widest + 1)
    none = widest + 1
    value = np.where((shift >= 0) & (shift <= room[:, None]), shift, none).astype(np.int32)
    value = np.minimum(value, none)
    best, length = most + 1, np.zeros(len(sizes), np.int64)
    rows = np.arange(len(sizes))
    for i in range(1, int(sizes.max(initial=0)) + 1):
        at = i + shift  # words of text used up
        same = items[rows, i - 1][:, None] == text[rows[:, None], np.clip(at - 1, 0, text.shape[1] - 1)]
        new = value + ~same  # a word for a word
        new[:, at < 1] = none
        new[:, :-1] = np.minimum(new[:, :-1], value[:, 1:] + 1)  # a word of the item left out
        new[(at < 0) | (at > room[rows][:, None])] = none
        new = np.minimum.accumulate(new - shift, axis=1) + shift  # words of the text put in
        new[(at < 0) | (at > room[rows][:, None])] = none
        value = np.minimum(new, none)
        done = sizes[rows] == i
        if done.any():
            ends, mine = value[done], rows[done]
            order = ends * (4 * none) + 2 * np.abs(shift) + (shift > 0)
            column = order.argmin(axis=1)
            least = ends[np.arange(len(mine)), column]
            good = least <= most[mine]
            best[mine[good]], length[mine[good]] = least[good], i + shift[column[good]]
        on = ~done & (value.min(axis=1) <= most[rows])
        if not on.all():
            rows, value = rows[on], value[on]
            if not len(rows):
                break
    return best, length


def candidates(bench: Benchmark, hashes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a start word and an item that agree on a sampled pair of steps. ``stop``: the end of each word's text."""
    if not bench.bands or len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(bench.pairs.has(neighbours(hashes)), out=shared[1 : len(hashes)])
    shared[-1] = shared[-2]
    holds = lambda p, reach: shared[np.minimum(p + reach, stop[p]) - 1] - shared[p]
    every = np.arange(len(hashes))
    maybe = every[holds(every, max(b.reach for b in bench.bands)) >= min(b.need for b in bench.bands)]
    found = []
    for band in bench.bands:
        starts = maybe[holds(maybe, band.reach) >= band.need]
        if not len(starts):
            continue
        for walk, steps in enumerate(band.steps):
            keys = keys_of(embed(hashes, starts, stop[starts], walk, int(steps.max()) + 1), steps, walk)
            low, high = np.searchsorted(band.keys, keys, "left"), np.searchsorted(band.keys, keys, "right")
            pair, window = np.nonzero(high > low)
            counts = (high - low)[pair, window]
            item = band.items[np.repeat(low[pair, window] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            found.append(np.repeat(starts[window], counts) * len(bench.ids) + item)
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    return both // len(bench.ids), both % len(bench.ids)


def exact_matches(bench: Benchmark, hashes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start words and items of fewer than SHORT words, which allow no edit."""
    at, item, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], W.Runs(hashes)
    for n, keys, items in bench.short:
        starts = np.flatnonzero(np.arange(len(hashes)) + n <= stop)
        h = runs.of(starts, starts + n)
        low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        at.append(np.repeat(starts[hit], counts))
        item.append(items[np.repeat(low[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())])
    return np.concatenate(at), np.concatenate(item)


def can_match(bench: Benchmark, pairs: np.ndarray, at: np.ndarray, item: np.ndarray, stop: np.ndarray, sizes: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Which candidates share enough pairs of neighbouring words with their own item; the others are ruled out exactly."""
    most = (bench.share * sizes + 1e-9).astype(np.int64)
    keep = np.zeros(len(at), bool)
    for a in range(0, len(at), step):
        p, i = at[a : a + step], item[a : a + step]
        size = np.minimum(p + sizes[i] + most[i], stop[p]) - 1 - p
        of = np.repeat(np.arange(len(p)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + p[of]
        hit = bench.own_pairs.has(tagged(pairs[place], i[of].astype(np.uint64)))
        keep[a : a + step] = np.bincount(of[hit], minlength=len(p)) >= sizes[i] - 1 - 2 * most[i]
    return keep


def verified(bench: Benchmark, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, stop: np.ndarray, sizes: np.ndarray, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The exact edit distance of each candidate (over the allowed one if it doesn't match) and the words it spans."""
    most = (bench.share * sizes + 1e-9).astype(np.int64)[item]
    n, length = most + 1, np.zeros(len(at), np.int64)
    order = np.argsort(sizes[item], kind="stable")  # items of similar length together
    while len(order):
        wide = int(sizes[item[order[-1]]] + most[order[-1]])
        mine, order = order[-max(1, cells // wide) :], order[: -max(1, cells // wide)]
        of, p = item[mine], at[mine]
        words = bench.flat[np.minimum(bench.begin[of][:, None] + np.arange(sizes[of].max()), len(bench.flat) - 1)]
        text = hashes[np.minimum(p[:, None] + np.arange(wide), len(hashes) - 1)]
        n[mine], length[mine] = edits(words, sizes[of], text, np.minimum(stop[p] - p, wide), most[mine])
    return n, length


def matches(bench: Benchmark, words: W.Words) -> tuple[np.ndarray, ...]:
    """text, item, first word, word after the last, edits: the best match of each text and item, in this order."""
    hashes = W.word_hashes(words)
    if not len(hashes) or not bench.ids:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    stop = words.first[words.text + 1]
    sizes = np.array([len(x) for x in bench.words], np.int64)
    at, item = candidates(bench, hashes, stop)
    keep = can_match(bench, neighbours(hashes), at, item, stop, sizes)
    at, item = at[keep], item[keep]
    n, length = verified(bench, hashes, at, item, stop, sizes)
    keep = n <= (bench.share * sizes + 1e-9).astype(np.int64)[item]
    short = exact_matches(bench, hashes, stop)
    at, item = np.concatenate([at[keep], short[0]]), np.concatenate([item[keep], short[1]])
    n, length = np.concatenate([n[keep], 0 * short[0]]), np.concatenate([length[keep], sizes[short[1]]])
    text = words.text[at]
    order = np.lexsort((at, n, item, text))
    text, item, at, n, length = (x[order] for x in (text, item, at, n, length))
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    return text[first], item[first], at[first], (at + length)[first], n[first]


def benchmark_blocks(benchmark: DataFrame, share: float, block_bytes: int, least_words: int) -> Iterator[Benchmark]:
    """The stated query set, in blocks of about block_bytes of text."""
    items = benchmark.select("item_id", "text").where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield prepare(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), share, least_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All matches of the benchmark's items in docs(doc_id, text), in one narrow pass a block."""
    kinds = (dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"])

    def block(bench: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in W.chunks(batches):
                words = W.find_words(part.column("text"), SEPARATOR, LOWER)
                text, item, first, after, n = matches(bench, words)
                if not len(text):
                    continue
                points = W.code_points(words.data)
                base = points[words.offsets[text]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), pa.array([bench.ids[i] for i in item], pa.int64() if kinds[1] == "bigint" else None), pa.array(points[words.start[first]] - base), pa.array(points[words.end[after - 1]] - base), pa.array(n), pa.array([len(bench.words[i]) for i in item], pa.int64())],
                    names=["doc_id", "item_id", "start", "end", "edits", "item_words"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long, item_words long")

    found = None
    for bench in benchmark_blocks(benchmark, share, block_bytes, least_words):
        found = block(bench) if found is None else found.unionByName(block(bench))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_bytes: int = BLOCK_BYTES, whole_below: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs(text, ...) in which no item of the benchmark matches: each row is judged by its own text, in a
    narrow pass a block, one behind the other. An item of fewer than ``whole_below`` words, which prose may hold by
    chance, matches only texts that are nothing else."""
    schema = docs.schema

    def dropping(bench: Benchmark):
        sizes = np.array([len(x) for x in bench.words], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for part in W.chunks([batch]):
                    words = W.find_words(part.column("text"), SEPARATOR, LOWER)
                    text, item, first, after, _ = matches(bench, words)
                    whole = (first == words.first[text]) & (after == words.first[text + 1])
                    keep = np.ones(part.num_rows, bool)
                    keep[text[whole | (sizes[item] >= whole_below)]] = False
                    yield batch.slice(done, part.num_rows).filter(pa.array(keep))  # a null text stays null
                    done += part.num_rows

        return run

    for bench in benchmark_blocks(benchmark, share, block_bytes, LEAST_WORDS):
        docs = docs.mapInArrow(dropping(bench), schema)
    return docs


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
