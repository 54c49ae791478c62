"""Operators across documents against plain Python: repeats, suffixes, SimHash, sharding, archives, components, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from versoscan.llm import nearcopies, repeats, sharding, simhash, substrings, suffixes, warc
from versoscan.llm.shared import connected_components, cut, joined_apart

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    """Copies, near copies, shared passages, repeats within a text, nulls and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passages = [[word() for _ in range(r.randint(36, 90))] for _ in range(6)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 150))]
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = r.choice(passages)
        if i % 17 == 0:
            w = w + w
        if i % 5 == 0 and texts:
            w = WORD.findall(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    return [*rows, (900, None, "x", 0), (901, "", "x", 0), (902, "\n \t", "x", 0), (3, texts[3], "x", 0), (None, texts[4], "x", 0), (None, "w " * 80, "x", 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept_sha256 string, fp int").repartition(5)


def covered(rows, n):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        c = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                c[i : i + n] = True
        out.append((w, c))
    return out


def test_substrings(spark):
    rows = corpus()
    want = Counter()
    for (d, *_), (w, c) in zip(rows, covered(rows, 35)):
        kept = " ".join(x for x, bad in zip(w, c) if not bad)
        want[(d, len(w), int(c.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    got = Counter(tuple(r) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == want and sum(k[2] for k in want) > 1000
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_suffixes(spark):
    rows = corpus(2)
    got = defaultdict(set)
    for r in suffixes.repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id].add((r.n_words, r.spans))
    missed = extra = 0
    for (d, *_), (w, c) in zip(rows, covered(rows, 50)):
        mine = np.zeros(len(w), bool)
        for n, spans in got.get(d, ()):
            if n == len(w):
                for s in spans.split(","):
                    a, b = map(int, s.split(":"))
                    mine[a:b] = True
        if d is not None:
            missed, extra = missed + int((c & ~mine).sum()), extra + int((mine & ~c).sum())
    assert extra == 0 and missed == 0 and sum(c.sum() for _, c in covered(rows, 50)) > 1000
    assert suffixes.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def components(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(spark):
    rows = corpus(3) + [(700 + i, t, "x", 0) for i, t in enumerate(["É A b", "a", "A", "one two three four", "", None, "B c D e f"])]
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = components(fps)
    least = {}
    for (d, *_), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = Counter((d, f"{f:016x}", least.get(c)) for (d, *_), f, c in zip(rows, fps, comp))
    found = simhash.near_duplicates(frame(spark, rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_simhash_of_odd_texts(spark):
    """Nulls, white space, a very long text, ties of equal texts, clashing columns; a component without any id has none."""
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(60_000))
    rows = [(1, long, 0), (2, long.upper(), 0), (3, None, 0), (4, " \t", 0), (5, "", 0), (None, "only this one has no id", 0), (None, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(x.doc_id, x.fp, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fp, none = signed(brute_fingerprint(long)), signed(brute_fingerprint("only this one has no id"))
    assert got == {(1, fp, 1), (2, fp, 1), (None, fp, 1), (3, 0, 3), (4, 0, 3), (5, 0, 3), (None, none, None)}


def test_links_of_close_fingerprints(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = sorted(values)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4}
    got = simhash.link_fingerprints(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    assert {tuple(x) for x in got.distinct().collect()} == want and len(want) > 500


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 201), (201, 200), (5, 5)]
    random.Random(1).shuffle(chain)
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_sharding(spark):
    names, slots = sharding.shard_names(7), sharding.next_prime(700)
    owner = sharding.fill_table(names, slots)
    prefer = []
    for s in names:
        number = lambda salt: int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        prefer.append([(number("offset") % slots + k * (number("step") % (slots - 1) + 1)) % slots for k in range(slots)])
    want, turn = [None] * slots, 0
    while None in want:
        i = turn % len(names)
        want[next(k for k in prefer[i] if want[k] is None)] = i
        turn += 1
    assert owner == want and max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.fill_table(names[:-1], slots)
    assert sum(a != b for a, b in zip(owner, fewer) if a != 6) < 0.2 * slots
    df = spark.createDataFrame([(1, "a", "z"), (1, "a", "z"), (None, "b", "z")], "doc_id long, text string, shard string")
    rows = sharding.assign_shards(df, "doc_id", names).collect()
    key = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:15], 16) % slots
    assert sorted((r.doc_id or -1, r.shard) for r in rows) == sorted([(1, owner[key("1")]), (1, owner[key("1")]), (-1, owner[key("")])])
    assert sharding.assign_shards(df.limit(0), "doc_id", names).count() == 0


def test_archives(spark, tmp_path):
    big = "<html>" + "é text " * 40 + "</html>"
    rows = [(5, "http://a/\nb", big, 1), (2, None, big, 1), (9, "u", big, 1), (2, None, big, 1), (None, "u", big, 1), (7, "u", "x", 1), (8, "u", "x", 1), (10, "u", None, 1), (11, "u", "P*M\x18\x00\x00\x00\x00" * 30, 1)] + [(100 + i, "u", f"<p>{i}</p>" * i, 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, warc.train(pages))
    got = warc.read_warc(spark, path)
    first = {(r.page_id, r.record_type, r.refers_to) for r in got.where("page_id in (2, 5, 9) or page_id is null").collect()}
    assert first == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (None, "revisit", 2)}
    html = {(i, h or "") for i, _, h, _ in rows}
    for r in got.collect():
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in html
        assert (r.payload_bytes, r.payload_digest) in {(len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, h in html if i == r.page_id}
    assert got.count() == len(rows)
    files = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    for f in files:  # any reader of Zstandard streams that is given the dictionary can read them
        data = f.read_bytes()
        size = int.from_bytes(data[4:8], "little")
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
        assert reader.read().startswith(b"WARC/1.1\r\n")
    warc.write_warc(pages.limit(0), path, warc.train(pages.limit(0)))
    assert warc.read_warc(spark, path).count() == 0


def test_archives_roll_on_bytes(spark, tmp_path):
    """A new archive starts once the last one is full; one very long page makes one file, and is read back whole."""
    r = random.Random(1)
    long = "".join(r.choice("abcdefghij") for _ in range(3_000_000))
    rows = [(i, "u", "".join(r.choice("abcdefghij") for _ in range(2000)), "x", 1) for i in range(60)] + [(99, "u", long, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, record_type int").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), warc.train(pages), file_bytes=20_000)
    got = {x.page_id: bytes(x.payload).decode() for x in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {i: h for i, _, h, *_ in rows}
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").iterdir() if f.suffix == ".txt")
    assert len(sizes) == 3 and sizes[-2] < 20_000 + warc.DICTIONARY_BYTES + 2000 < sizes[-1]


def test_dictionary_sample_of_equal_rows(spark):
    """Very many equal rows give one sample."""
    pages = spark.range(5000).select(F.lit(None).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>some page</p>").alias("html"))
    assert len(warc.train(pages)) < 1000


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    clean = {i: prose(80) for i in range(40)}
    rows = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    rows += [(100, clean[1], "en", "s", 0), (101, "spam eggs ham now then " * 20, "en", "s", 0), (102, prose(40) + " " + item + " " + prose(40), "en", "s", 0), (103, prose(60) + " me@mail.example.com " + prose(60), "en", "s", 0), (104, None, "en", "s", 0), (None, clean[1], "en", "s", 0), (7, clean[7], "en", "s", len(clean[7]))]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        ids[name] = sorted(x.doc_id if x.doc_id is not None else -1 for x in docs.select("doc_id").collect())
    assert set(ids["quality"]) == {*range(40), 100, 102, 103, -1}
    assert ids["near_duplicates"] == [*range(40), 102, 103] and ids["decontamination"] == [*range(40), 103] == ids["personal_data"]
    masked = docs.where("doc_id = 103").first()
    assert "[EMAIL]" in masked.text and masked.n_chars == len(masked.text)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {*range(40), 103}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def test_decontamination_judges_rows(spark, tmp_path):
    """Of rows that share a doc_id, or have none, only those that hold the item go; so do whole long texts."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    spark.createDataFrame([(0, item), (1, "yes no"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = f"{prose(30)} {item} {prose(30)}"
    rows = [(None, bad, "en", "s", 0), (None, prose(80), "en", "s", 1), (7, bad, "en", "s", 2), (7, prose(80) + " yes no", "en", "s", 3), (8, prose(80), "en", "s", 4), (8, None, "en", "s", 5), (9, prose(200_000) + " " + item, "en", "s", 6)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], PIPELINE + ", edits string").repartition(3)
    kept = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(x.n_chars for x in kept.collect()) == [1, 3, 4, 5] and kept.columns == corpus_pipeline.COLUMNS
    assert sorted(x.text or "" for x in kept.collect()) == sorted(t or "" for _, t, *_, n in rows if n in (1, 3, 4, 5))


def test_pipeline_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], PIPELINE).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hot_keys_are_dealt_apart(spark):
    """A key with a third of all rows is spread over tasks; each row is joined once, rows without a key not at all."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"), "id").repartition(5, "id")
    keys = cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k < 5000"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = joined_apart(rows, keys, ["k"], keep=("top",))
        sizes = got.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 3 and max(r["count"] for r in sizes) < 1200
        assert Counter(tuple(r) for r in got.select("k", "id", "top").collect()) == Counter(tuple(r) for r in rows.join(keys, "k").select("k", "id", "top").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pipeline_near_copies(spark):
    """Planted copies with words changed, against all pairs of 5-word shingle sets; one of similarity below 0.8 stays."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    texts = [[word() for _ in range(r.randint(90, 300))] for _ in range(25)]
    for i in range(120):
        w = list(texts[i % 25])
        for _ in range(r.randint(1, max(1, len(w) // 35))):
            w[r.randrange(len(w))] = word()
        texts.append(w)
    texts += [["a", "b"], ["A", "b"], ["a", "c"]]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)] + [(None, " ".join(texts[0]), "en", "s", 0), (500, None, "en", "s", 0)]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t, *_ in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 999), 999 if d is None else d)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates_stage(spark, docs, "").select("doc_id").collect())
    assert got == sorted(least.values()) and 30 < len(got) < 120 and len(pairs) > 100


def test_parities_pass_over_pairs_that_differ_too_much(spark):
    """Texts of 30 of one passage's 40 pieces: they share early shingles, but few pairs can be near; no near pair is lost."""
    draw = random.Random(3)
    pieces = [" ".join(f"w{k}x{i}" for i in range(10)) for k in range(40)]
    rows = [(n, " ".join(pieces[k] for k in sorted(draw.sample(range(40), 30)))) for n in range(60)]
    rows += [(100 + n, rows[n][1].replace("x3", "x3 new", 1)) for n in range(5)]
    grams, bounds = nearcopies.shingle_sets(pa.array([t for _, t in rows]))
    sets = [set(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    near = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    near = {(min(p), max(p)) for p in near}
    nodes = spark.createDataFrame([(n, len(x), n) for (n, _), x in zip(rows, sets, strict=True)], "node long, size long, component long")
    found = {(r.a, r.b) for r in nearcopies._prefix_pairs(nodes, spark.createDataFrame(rows, "node long, text string")).collect()}
    assert len(near) >= 5 and near <= found and len(found) < 2 * len(near) + 20


def test_near_copies_of_one_passage(spark):
    """A family whose members mostly differ from one another by more than a fifth: links as all pairs give them, and few
    pairs are ever compared."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    base, seeds = [word() for _ in range(60)], []
    for _ in range(150):
        w = list(base)
        for k in r.sample(range(60), 3):
            w[k] = word()
        seeds.append(w)
    texts = seeds + [[*w[:-1], word()] for w in r.sample(seeds, 40)] + [w[1:] for w in r.sample(seeds, 30)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        parent[find(i)] = find(j)
    docs = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, row long, text string")
    root = {x.doc_id: x.root for x in nearcopies.near_copies(docs).collect()}
    groups = lambda of: {frozenset(k for k in range(len(texts)) if of(k) == of(i)) for i in range(len(texts))}
    assert groups(root.get) == groups(find) and 60 < len(pairs) < 2000

    nodes = spark.createDataFrame([(i, len(x), i) for i, x in enumerate(sets)], "node long, size long, component long")
    held = {tuple(sorted((x.a, x.b))) for x in nearcopies._prefix_pairs(nodes, docs.select(F.col("doc_id").alias("node"), "text")).collect()}
    assert {tuple(sorted(x)) for x in pairs} <= held and len(held) < 0.2 * len(texts) ** 2 / 2


def test_suffixes_many_contexts(spark):
    """Copies of one text edited at different places: every word that lies in a repeated window is found."""
    r = random.Random(21)
    core = [f"w{r.randrange(10**6)}" for _ in range(130)]
    rows = []
    for i in range(60):
        w = list(core)
        for _ in range(4):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "x", 0))
    want = {}
    for (d, *_), (w, c) in zip(rows, covered(rows, 50)):
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        if len(bounds):
            want[d] = ",".join(f"{a}:{b}" for a, b in bounds.reshape(-1, 2).tolist())
    assert {x.doc_id: x.spans for x in suffixes.repeated_passages(frame(spark, rows)).collect()} == want and len(want) > 10


def test_repeated_rows_have_bounded_places(spark):
    """Rows of one text and a null id share one list of places, however many they are."""
    text = " ".join(f"w{i}" for i in range(300))
    source = repeats.keyed(frame(spark, [(None, text, "x", 0)] * 2000))
    whole, _ = repeats.repeated_contexts(source, 35, 8)
    assert repeats.with_places(source, whole, "inner").agg(F.max(F.size("places"))).first()[0] <= 300
    got = substrings.remove_repeats(frame(spark, [(None, text, "x", 0)] * 2000)).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(x) for x in got] == [(300, 300, 2000)]


def test_block_matches_cover_all_pairs():
    """Every word of every match of two entries is in a kept match of the entry, and no kept match is invented."""
    r = random.Random(11)
    for _ in range(300):
        n, m = r.choice([3, 5, 8]), r.randint(2, 14)
        run = lambda size: "".join(r.choice("ab") + " " for _ in range(size))
        entries = sorted((run(r.randint(1, n)), run(r.randint(0, n))) for _ in range(m))
        right, left = [e[0] for e in entries], [e[1] for e in entries]
        got = defaultdict(set)
        for i, l, k in repeats.block_matches(right, left, n):
            assert l + k >= n and any(j != i and repeats.common(right[i], right[j]) >= k and repeats.common(left[i], left[j]) >= l for j in range(m))
            got[i] |= set(range(-l, k))
        for i in range(m):
            want = set()
            for j in range(m):
                k, l = repeats.common(right[i], right[j]), repeats.common(left[i], left[j])
                if i != j and k + l >= n:
                    want |= set(range(-l, k))
            assert got[i] == want, (right, left, n)


def families(seed=3):
    """Three and more texts around each seed, edited at different places, so that few matches are whole contexts."""
    r = random.Random(seed)
    rows = []
    for f in range(12):
        base = [f"w{f}x{r.randrange(40)}" for _ in range(160)]
        for _ in range(6):
            w = base[:]
            for _ in range(3):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "x", 0))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_repeats_come_from_sorted_blocks(spark, monkeypatch, block):
    """Blocks held by a task and blocks that are too large for one give the same; without matches of blocks words are missed."""
    rows = families()
    want = sum(int(c.sum()) for _, c in covered(rows, 35))
    monkeypatch.setattr(repeats, "BLOCK", block)
    total = lambda: substrings.remove_repeats(frame(spark, rows), text=False).agg(F.sum("n_removed")).first()[0]
    assert total() == want
    if block > 3:
        assert suffixes.repeated_passages(frame(spark, rows)).agg(F.sum("n_repeated")).first()[0] == sum(int(c.sum()) for _, c in covered(rows, 50))
        monkeypatch.setattr(repeats, "block_matches", lambda right, left, n: [])
        assert total() < want


def test_words_that_collide_are_no_repeat(spark):
    """Two long words of equal polynomials between equal words: no window is repeated."""
    s = ["a"]
    for _ in range(11):
        s += ["b" if c == "a" else "a" for c in s]
    x = "".join(s)
    y = x.translate(str.maketrans("ab", "ba"))
    common = [f"c{i}" for i in range(34)]
    rows = [(0, " ".join([*common[:17], x, *common[17:]]), "x", 0), (1, " ".join([*common[:17], y, *common[17:]]), "x", 0)]
    assert substrings.remove_repeats(frame(spark, rows)).agg(F.sum("n_removed")).first()[0] == 0
