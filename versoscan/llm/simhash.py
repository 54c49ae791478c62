"""SimHash near-duplicates: fingerprints of word shingles, linked by a pigeonring search, and their components.

The 64 bits are cut into five segments in a ring. If two fingerprints differ in at most four bits, then from some
segment on every chain of l segments differs in at most floor(l * 4 / 5) bits: 0, 1, 2, 3, 4. The first two budgets
make the join's key (one segment equal, the next one equal or one bit off), the longer chains are conditions of the
same join, so only links leave it. Only one side spells out the one-bit neighbours: a segment one bit off has the
other parity, so rows of even parity probe and rows of odd parity are looked up.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows get the same
result each; a row with a null doc_id takes part but never names a component (which is null if no row of it has an
id); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import connected_components, cut, table

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
MAX_BITS = 4


def fingerprint(text: bytes, n: int = 4) -> int:
    """Of one lower-cased UTF-8 text: a bit is 1 if more than half of the shingles' hashes have it."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-n] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) and the columns of ``carry`` for each row of docs(doc_id, text), in one narrow pass."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            data, offsets = W.bytes_of(part.column("text"))
            raw = data.tobytes().lower()  # of bytes: A-Z only
            fp = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *(part.column(c) for c in carry)], names=["doc_id", "fp", *carry])

    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"doc_id {types['doc_id']}, fp long" + "".join(f", {c} {types[c]}" for c in carry))


def _ring() -> list[tuple[int, int]]:
    """Shift and width of each segment, from the low bits on."""
    out, at = [], 0
    for w in WIDTHS:
        out.append((at, w))
        at += w
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _segment(fp: Column, i: int) -> Column:
    at, width = _ring()[i % len(WIDTHS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _chains_hold(key: Column, differing: Column) -> Column:
    """The chains of three and four segments from the key's segment on, and all bits, keep their budgets."""
    ring = _ring()
    budgets = F.lit(False)
    for i in range(len(ring)):
        holds = F.lit(True)
        for length in (3, 4):
            mask = sum(((1 << w) - 1) << at for at, w in (ring[(i + k) % len(ring)] for k in range(length)))
            holds = holds & (F.bit_count(differing.bitwiseAND(F.lit(_signed(mask)))) <= length * MAX_BITS // len(ring))
        budgets = F.when(F.shiftright(key, 40) == i, holds).otherwise(budgets)
    return (F.bit_count(differing) <= MAX_BITS) & budgets


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """All links (a, b), a < b, between distinct fingerprints of fps(fp) that differ in 1 to 4 bits.

    A link that keeps the budgets from several segments on shows up once for each.
    """
    n, fp = len(WIDTHS), F.col("fp")
    segments = [F.struct(_segment(fp, i).alias("one"), _segment(fp, i + 1).alias("two"), F.lit(i).alias("i")) for i in range(n)]
    at = F.col("s")
    rows = fps.select(fp, F.explode(F.array(*segments)).alias("s"))
    key = F.shiftleft(at["one"], 16).bitwiseOR(at["two"]).bitwiseOR(F.shiftleft(at["i"].cast("long"), 40))
    flips = F.array(*(F.lit(1 << b if b >= 0 else 0).cast("long") for b in range(-1, max(WIDTHS))))
    probes = F.when(F.bit_count(at["two"]) % 2 == 0, F.transform(flips, lambda m: key.bitwiseXOR(m))).otherwise(F.array(key))
    left = rows.select(fp.alias("a"), F.explode(probes).alias("key"), (F.bit_count(at["two"]) % 2).alias("pa"))
    right = rows.select(fp.alias("b"), key.alias("k"), (F.bit_count(at["two"]) % 2).alias("pb"))
    # with equal segments a pair is met from both sides, with unequal ones from the even side only
    once = (F.col("pa") != F.col("pb")) | (F.col("a") < F.col("b"))
    found = left.join(right, (F.col("key") == F.col("k")) & once & (F.col("a") != F.col("b")) & _chains_hold(F.col("key"), F.col("a").bitwiseXOR(F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root) and the columns of ``carry`` for each row of docs(doc_id, text).

    Equal fingerprints are one node of the graph, however many documents have them. ``root`` is the component's least
    fingerprint, which stands for it even where no row has an id.
    """
    fps = cut(fingerprints(docs, shingle, carry))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = cut(connected_components(link_fingerprints(nodes.select("fp"))))
    least = nodes.join(reach, nodes["fp"] == reach["node"]).groupBy("component").agg(F.min("least").alias("least"))
    linked = reach.join(least, "component").select(F.col("node").alias("fp"), F.col("least").alias("linked"), "component")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"), F.coalesce("component", "fp").alias("root"))
    named = cut(named)  # read back, so that the join has a shuffle of its own and can split a fingerprint of very many rows
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root", *carry)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
