"""Substring deduplication by seed and extend.

Documents are joined on winnowed anchors (see ``repeats``). Equal surroundings of an anchor match as they are; where
they differ, matches are extended from the anchor word by word to the right and to the left. What is kept are the
maximal repeats of at least ``n`` words: each word covered by a window that also starts elsewhere is removed, judged on
the input.

Defined results: a null or blank text has no words; texts of fewer than n words lose none; rows that are repeated
repeat each other's windows; a row with a null doc_id is treated like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from versoscan.llm import words as W
from versoscan.llm.repeats import SIZE_BITS, expand, keyed, repeated_windows, with_places
from versoscan.llm.shared import table

WINDOW_WORDS = 35
ANCHOR_WORDS = 8


def remove_repeats(docs: DataFrame, n: int = WINDOW_WORDS, k: int = ANCHOR_WORDS, text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    source = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            data, offsets = W.bytes_of(part.column("text"))
            raw, (places, row) = data.tobytes(), expand(part)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            low, size = places >> SIZE_BITS, places & ((1 << SIZE_BITS) - 1)
            out = []
            for i in range(part.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                kept = words
                if first[i] < first[i + 1]:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, low[first[i] : first[i + 1]], 1)
                    np.add.at(change, (low + size)[first[i] : first[i + 1]] + n - 1, -1)
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if text else ""))
            total, removed, digest, joined = zip(*out, strict=True)
            columns = [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(joined)][: 5 if text else 4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 5 if text else 4])

    marked = with_places(source, repeated_windows(source, n, k), "left")
    return marked.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * text)


def substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), text=False)
