"""Quality rules: boosted trees over document statistics, with monotonic constraints on chosen features.

Statistics are taken over whole texts in numpy. The trees are grown on a bounded sample of labelled rows, flattened
into node arrays and scored for all documents of an Arrow batch at once.

Defined results: a null or blank text has no words, so ``base_failed`` is true; repeated rows are each scored; rows
with a null doc_id are scored like any other; an empty table gives an empty result; without labelled rows of both
kinds only the base rules decide. Columns of the input that are not asked for are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import table

SAMPLE_ROWS = 20_000  # labelled rows that the trees are fitted on, at most
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "digits", "capitals", "stops", "wide", "line_words", "distinct")
#: More of these can only raise the chance that a document is bad.
RISING = ("symbols", "dup_lines", "repeats")
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
STOP = np.isin(np.arange(256), list(b".!?"))


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of BASE and the features of every text of a column without nulls."""
    words = W.find_words(column)
    data, offsets, n = words.data, words.offsets, len(words.start)
    count = np.diff(words.first)
    points = W.code_points(data)
    chars = W.per_text(words, points[words.end] - points[words.start])

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    symbols = bytes_in(SYMBOL)
    # lines that hold a word
    spans = W.Spans(data)
    begin = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(data[:-1] == 10) + 1 if len(data) else [])
    begin = begin.astype(np.int64)
    stop = np.append(begin[1:], len(data))
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(data) else stop
    full = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[full], stop[full]
    of_line = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.bincount(of_line, minlength=len(count))
    tag = W.mix(np.arange(len(count), dtype=np.uint64) + np.uint64(1))
    _, at = np.unique(spans.of(begin, stop) ^ tag[of_line], return_index=True)
    dup_lines = lines - np.bincount(of_line[at], minlength=len(count))
    # words in windows of five that are found again in the same text
    hashes = spans.of(words.start, words.end)
    starts = W.windows(words, 5)
    keys = W.Runs(hashes).of(starts, starts + 5) ^ tag[words.text[starts]]
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = starts[times[inverse] > 1] if len(starts) else starts
    repeats = W.per_text(words, W.covered(twice, 5, n))
    distinct = np.bincount(words.text[np.unique(hashes ^ tag[words.text], return_index=True)[1]], minlength=len(count))
    base = dict(zip(BASE, (count, chars, symbols, dup_lines, repeats), strict=True))
    per_word, per_char = np.maximum(count, 1), np.maximum(points[offsets[1:]] - points[offsets[:-1]], 1)
    x = np.stack(
        [
            np.log1p(count), chars / per_word, symbols / per_word, dup_lines / np.maximum(lines, 1), repeats / per_word,
            bytes_in(DIGIT) / per_char, bytes_in(CAPITAL) / per_char, bytes_in(STOP) / per_word,
            1 - per_char / np.maximum(np.diff(offsets), 1), count / np.maximum(lines, 1), distinct / per_word,
        ],
        axis=1,
    )
    return base, x


class Trees(NamedTuple):
    """All nodes of all trees in one array each; a leaf has feature -1. ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of being bad, of all rows at once: every pass goes one level down."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at]))
            out += self.value[at]
        return out


def grow(x: np.ndarray, bad: np.ndarray, rising: tuple[int, ...], n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 5.0, leaf: int = 20) -> Trees:
    """Boosting with the logistic loss on binned features.

    A split on a feature of ``rising`` is allowed only if its right side's value is not below its left side's; both
    sides then inherit the middle of the two values as a bound, which keeps the whole tree monotonic.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(bad.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(x), bias)
    nodes: list[list[float]] = []
    roots = []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        worth = lambda a, b: np.clip(-a / (b + smooth), low, high)
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + smooth) * v * v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(worth(total_g, total_h))
        nodes.append([-1, 0.0, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts if level < depth and len(rows) >= 2 * leaf else []):
            if not len(c):
                continue
            size = len(c) + 1
            of = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(of, w, size))[:-1] for w in (g[rows], h[rows], None))
            left, right = worth(gl, hl), worth(total_g - gl, total_h - hl)
            gain = gain_of(gl, hl, left) + gain_of(total_g - gl, total_h - hl, right) - gain_of(total_g, total_h, value)
            ok = (nl >= leaf) & (len(rows) - nl >= leaf)
            if j in rising:
                ok &= right >= left
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(left[k]), float(right[k]))
        _, j, k, left, right = best
        if j >= 0:
            goes = binned[rows, j] <= k
            middle = (left + right) / 2
            bounds = ((low, min(high, middle)), (max(low, middle), high)) if j in rising else ((low, high), (low, high))
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = split(rows[goes], g, h, level + 1, *bounds[0])
            nodes[me][3] = split(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    every = np.arange(len(x))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(split(every, p - bad, p * (1 - p), 0, -np.inf, np.inf))
        a = np.array(nodes)
        score += Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots[-1:]), 0.0, depth).score(x)
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), bias, depth)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Trees | None:
    """Trees from at most ``sample_rows`` labelled documents, those with the least hash of doc_id.

    Their statistics are taken on the executors; the driver gets one short row of numbers a sampled document. A
    doc_id labelled twice with different qualities counts as the lower one.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), batch.column("doc_id"), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["quality", "doc_id", *FEATURES])

    # at most sample_rows ids of 12 bytes: a proven bound, whatever the tables' sizes
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
        .mapInArrow(measure, "quality int, doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))
        .dropDuplicates().toPandas()
    )
    rows = rows.sort_values(["doc_id", *FEATURES])
    bad = (rows["quality"].to_numpy() == 0).astype(float)
    if not len(bad) or bad.min() == bad.max():
        return None
    return grow(rows[list(FEATURES)].to_numpy(float), bad, tuple(FEATURES.index(f) for f in RISING), **options)


def score_quality(docs: DataFrame, trees: Trees | None, keep_below: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, kept and p_bad for each row of docs(doc_id, text), in one narrow pass.

    ``carry`` names further columns of docs to hand through, text among them if wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            for part in W.chunks([batch]):
                base, x = statistics(part.column("text"))
                failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
                p = 1 / (1 + np.exp(-trees.score(x))) if trees else np.zeros(len(x))
                own = [part.column("doc_id"), *(pa.array(base[b], pa.int64()) for b in BASE), pa.array(failed), pa.array(~failed & (p < keep_below)), pa.array(p)]
                original = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(own + [original.column(c) for c in carry], names=["doc_id", *BASE, "base_failed", "kept", "p_bad", *(f"in_{c}" for c in carry)])

    types = dict(docs.dtypes)
    wanted = list(dict.fromkeys(["doc_id", "text", *carry]))
    schema = f"doc_id {types['doc_id']}, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, p_bad double"
    return docs.select(*wanted).mapInArrow(run, schema + "".join(f", in_{c} {types[c]}" for c in carry))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "kept")
