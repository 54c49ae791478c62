"""Sparse suffix arrays: repeated passages from sorted suffixes at minimiser positions.

Of all suffixes only those that start at a window's minimiser are retained (see ``repeats``; n is the least length of
a repeat). Suffixes with equal surroundings are one entry. Entries of one minimiser are a block of the suffix array:
they are sorted by their next n words, neighbours are compared, and the intervals of entries that share r words are
extended to the left, each entry with the one of its interval that shares most words there. Both sides are marked where
a match has at least n words, so the result is exact. Minimisers that more than ``repeats.BLOCK`` different
surroundings share are no block of one task; there windows are compared by hash.

Result: one row for each document with a repeated passage: doc_id, n_words, n_repeated (words in such passages) and
spans (start:end in words, end exclusive, comma-joined). Defined results: null, blank and short texts have no repeats;
repeated rows repeat each other; a null doc_id is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from versoscan.llm import words as W
from versoscan.llm.repeats import SIZE_BITS, expand, keyed, repeated_windows, with_places
from versoscan.llm.shared import table

LEAST_WORDS = 50
SEED_WORDS = 8


def repeated_passages(docs: DataFrame, n: int = LEAST_WORDS, k: int = SEED_WORDS) -> DataFrame:
    source = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            data, offsets = W.bytes_of(part.column("text"))
            raw, (places, row) = data.tobytes(), expand(part)
            begin = places >> SIZE_BITS
            end = begin + (places & ((1 << SIZE_BITS) - 1)) + n - 1
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = []
            for i in range(part.num_rows):
                total = len(raw[offsets[i] : offsets[i + 1]].split())
                change = np.zeros(total + 2, np.int64)
                np.add.at(change, begin[first[i] : first[i + 1]] + 1, 1)
                np.add.at(change, end[first[i] : first[i + 1]] + 1, -1)
                inside = np.cumsum(change) > 0
                bounds = np.flatnonzero(np.diff(inside.astype(np.int8)))
                out.append((total, int(inside.sum()), ",".join(f"{a}:{b}" for a, b in bounds.reshape(-1, 2).tolist())))
            total, repeated, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(repeated, pa.int64()), pa.array(text)], names=["doc_id", "n_words", "n_repeated", "spans"])

    marked = with_places(source, repeated_windows(source, n, k), "inner")
    return marked.mapInArrow(merge, f"doc_id {kind}, n_words long, n_repeated long, spans string")


def suffixes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
