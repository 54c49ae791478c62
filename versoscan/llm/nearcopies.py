"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

Candidates come from two sides: SimHash fingerprints of the shingles (equal, or linked by the pigeonring search) and
bands of MinHash values, since 64 bits reach a similarity of 0.8 only with a radius at which no search is selective. A
pair of similarity 0.8 shares one of 24 bands of five with a probability of 0.99993. Every candidate pair is then
checked exactly on the texts, so nothing less similar is linked. Texts of equal shingle sets are one node.

The nodes of each band are first checked against its least node, so a large family of near copies costs little more
than a star. Nodes that still share a band with another component are joined anew, by an exact prefix filter: with the
rarest shingles first, two sets of similarity 0.8 share a shingle so early in both that enough of each is left behind
it. Thousands of texts that are cut from one passage, but differ by more than a fifth, thus meet in no join: the
shingles they share come too late. Of pairs that do meet, the parities of their shingles over 1,024 bits tell how many
shingles at least only one of the two has; where that is too many, the pair is passed over within the join.

A text of one to four words has one shingle, all its words; a null or blank text has none, and all such texts are one
node. Upper-case A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoscan.llm import words as W
from versoscan.llm.shared import HOT_SHARE, SALTS, connected_components, cut, hot_keys, joined_apart
from versoscan.llm.simhash import fingerprint, link_fingerprints

SHINGLE = 5
SHARED, OF = 4, 5  # the least similarity, 4/5
BANDS, BAND_ROWS = 24, 5
PARITIES = 16  # words of 64 bits, each bit the parity of how many shingles fall on it
BROADCAST_ROWS = 200_000  # of (node, row); beyond that the texts are shuffled
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
_draw = np.random.default_rng(7)
FLIPS, FACTORS = (_draw.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
FACTORS = FACTORS << np.uint64(1) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the n + 1 bounds of the texts."""
    words = W.find_words(column, folded=FOLDED)
    runs = W.Runs(W.word_hashes(words))
    starts = W.windows(words, n)
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < n))
    gram = np.concatenate([runs.of(starts, starts + n), runs.of(words.first[short], words.first[short + 1])])
    owner = np.concatenate([words.text[starts], short]).astype(np.int64)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(len(column) + 1))


def band_keys(gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash bands of the sets that start at ``starts``, one row a set."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for i in range(BANDS * BAND_ROWS if len(starts) else 0):
        least = np.minimum.reduceat((gram ^ FLIPS[i]) * FACTORS[i], starts)
        band = i // BAND_ROWS
        out[:, band] = W.mix(out[:, band] + least + np.uint64(i))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, fp, size, keys) of docs(doc_id, row, text): node stands for the shingle set, size counts it."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            gram, bounds = shingle_sets(part.column("text"))
            size = np.diff(bounds)
            held = np.flatnonzero(size)
            node = np.zeros(len(size), np.uint64)
            keys = np.zeros((len(size), BANDS + 1), np.uint64)
            data, offsets = W.bytes_of(part.column("text"))
            raw = data.tobytes().lower()
            fp = np.array([fingerprint(raw[a:b], SHINGLE) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            if len(held):
                node[held] = W.mix(np.add.reduceat(W.mix(gram), bounds[held]) + size[held].astype(np.uint64))
                keys[held, :BANDS] = band_keys(gram, bounds[held])
            keys[:, BANDS] = W.mix(fp)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (BANDS + 1), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), lists],
                names=["doc_id", "row", "node", "fp", "size", "keys"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row long, node long, fp long, size long, keys array<long>")


def similar(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the shingle sets of each pair of texts have a Jaccard similarity of 4/5 or more."""
    (left, la), (right, lb) = shingle_sets(a), shingle_sets(b)
    gram = np.concatenate([left, right])
    owner = np.concatenate([np.repeat(np.arange(len(a)), np.diff(la)), np.repeat(np.arange(len(b)), np.diff(lb))])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    both = np.bincount(owner[1:][(gram[1:] == gram[:-1]) & (owner[1:] == owner[:-1])], minlength=len(a))
    return OF * both >= SHARED * (np.diff(la) + np.diff(lb) - both)


def _texts(used: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes used(node); docs(row, text) holds the texts, nodes(node, row) a row of each."""
    wanted = cut(nodes.select("node", F.col("row").alias("of")).join(used, "node"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    return cut(docs.join(wanted, docs["row"] == wanted["of"]).groupBy("node").agg(F.min("text").alias("text")))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs(a, b) of nodes those whose texts(node, text) are similar."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "text"), ("b", "other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            holds = pa.array(similar(part.column("text"), part.column("other")))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(holds), part.column("b").filter(holds)], names=["a", "b"])

    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other").mapInArrow(run, "a long, b long"))


def _near_in_size(a, b):
    return (F.least(a, b) * OF >= F.greatest(a, b) * SHARED) & (F.least(a, b) > 0)


def _grams(texts: DataFrame, hot: list[int]) -> DataFrame:
    """(node, gram, salt): the distinct shingles of each text; those of ``hot`` are dealt over salts by their node."""
    often = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            gram, bounds = shingle_sets(part.column("text"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            node = np.asarray(part.column("node"))[owner]
            salt = np.where(np.isin(gram.view(np.int64), often), node % SALTS, 0)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(gram.view(np.int64)), pa.array(salt)], names=["node", "gram", "salt"])

    return texts.select("node", "text").mapInArrow(run, "node long, gram long, salt long")


def _shared_grams(texts: DataFrame) -> DataFrame:
    """(gram, n): shingles of more than one text, counted within each chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            gram, times = np.unique(shingle_sets(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(times)], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")


def _enough_left(a, at_a, b, at_b):
    """Whether sets of a and b shingles whose first common one has these places, from 1 on, can have a similarity of 4/5."""
    return (1 + F.least(a - at_a, b - at_b)) * (SHARED + OF) >= SHARED * (a + b)


def parity_words(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row a set of shingles: 64 * PARITIES bits, each set if an odd number of its shingles falls on it."""
    bits = 64 * PARITIES
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, times = np.unique(owner * bits + (W.mix(gram) % np.uint64(bits)).astype(np.int64), return_counts=True)
    at = at[times % 2 == 1]
    out = np.zeros((len(bounds) - 1) * PARITIES, np.uint64)
    np.bitwise_or.at(out, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return out.reshape(-1, PARITIES)


def _parities(texts: DataFrame) -> DataFrame:
    """(node, x0, x1, ..): the parities of each text's shingles."""
    names = [f"x{k}" for k in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches):
            words = parity_words(*shingle_sets(part.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITIES))], names=["node", *names])

    return texts.select("node", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ["node", *names]))


def _may_be_near(a: str, b: str):
    """Whether the parities of rows a and b allow a similarity of 4/5: bits that differ are shingles that only one set has."""
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    differ = sum((F.bit_count(F.col(f"{a}.x{k}").bitwiseXOR(F.col(f"{b}.x{k}"))) for k in range(PARITIES)), F.lit(0))
    return (sizes - differ) * (SHARED + OF) >= 2 * SHARED * sizes


def _prefix_pairs(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of apart(node, size, component) in different components that pass the prefix filter; no pair of
    similarity 4/5 or more is missing."""
    shared = cut(_shared_grams(texts))
    most = (shared.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = [r[0] for r in shared.where(F.col("n") > most).select("gram").collect()]  # at most HOT_SHARE
    salts = F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    held = _grams(texts, hot).join(shared.select("gram", "n", salts.alias("salt")).hint("shuffle_hash"), ["gram", "salt"])
    lists = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    size = F.col("size")
    alone = size - F.size("grams")  # shingles of this text only come first
    first = size - F.ceil(size * SHARED / OF) + 1 - alone  # how many of the others can be the first that a pair shares
    places = F.posexplode(F.slice("grams", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("k", "g")
    early = apart.join(lists, "node").select("node", "size", "component", alone.alias("alone"), places)
    early = cut(early.select("node", "size", "component", F.col("g.gram").alias("gram"), (F.col("alone") + F.col("k") + 1).alias("at")))
    # a shingle counts where it meets another component, and for texts that can pass with the smallest of the others
    met = early.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least"), F.count("*").alias("n")).where("low <> high")
    rows = joined_apart(early, cut(met), ["gram"], keep=("least",))
    least = F.greatest("least", F.ceil(size * SHARED / OF))
    rows = cut(rows.where(_enough_left(size, F.col("at"), least, F.lit(1))).drop("least"))
    # a frequent shingle's rows are dealt over salts on one side and stand once a salt on the other
    hot, _ = hot_keys(rows.groupBy("gram").agg(F.count("*").alias("n")), ["gram"])
    is_hot = F.xxhash64("gram").isin(hot) if hot else F.lit(False)
    rows = cut(rows.join(_parities(texts).hint("shuffle_hash"), "node"))
    a = rows.withColumn("salt", F.when(is_hot, F.pmod("node", F.lit(SALTS))).otherwise(0).cast("long")).alias("a")
    each = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    b = rows.withColumn("salt", F.explode(each)).alias("b")
    apart_ = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    fits = _near_in_size(F.col("a.size"), F.col("b.size")) & _enough_left(F.col("a.size"), F.col("a.at"), F.col("b.size"), F.col("b.at"))
    return a.join(b, apart_ & fits & _may_be_near("a", "b")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row, root) for each row of docs(doc_id, row, text); row is a hash of doc_id, text and any other columns."""
    found = cut(sketches(docs))
    nodes = cut(found.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("keys").alias("keys")))
    at = cut(nodes.where("size > 0").select("node", "size", F.explode("keys").alias("key")))
    one = F.struct("node", "size")
    hubs = cut(at.groupBy("key").agg(F.min(one).alias("hub"), F.count("*").alias("n")).where("n > 1"))
    met = cut(joined_apart(at, hubs, ["key"], keep=("hub",)))
    stars = met.where(_near_in_size(F.col("size"), F.col("hub.size"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = cut(nodes.where("size > 0").groupBy("fp").agg(F.min(one).alias("one")))
    links = link_fingerprints(first.select("fp"))
    ends = [first.select(F.col("fp").alias(c), F.col("one").alias(f"{c}1")) for c in ("a", "b")]
    linked = links.join(ends[0], "a").join(ends[1], "b").where(_near_in_size(F.col("a1.size"), F.col("b1.size"))).select(F.col("a1.node").alias("a"), F.col("b1.node").alias("b"))
    pairs = stars.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = cut(pairs.distinct())
    used = met.select("node").unionByName(tried.select(F.col("a").alias("node"))).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    texts = _texts(used, docs, nodes)
    close = _checked(tried, texts)

    reach = cut(connected_components(close))
    placed = cut(met.join(reach, met["node"] == reach["node"], "left").select("key", met["node"], "size", F.coalesce("component", met["node"]).alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    apart = cut(joined_apart(placed, cut(mixed), ["key"]).select("node", "size", "component").distinct())
    rest = cut(_prefix_pairs(apart, texts.join(apart.select("node"), "node", "left_semi")).join(tried, ["a", "b"], "left_anti"))
    close = close.unionByName(_checked(rest, texts))

    reach = cut(connected_components(close))
    return found.join(reach, found["node"] == reach["node"], "left").select("doc_id", "row", F.coalesce("component", found["node"]).alias("root"))
