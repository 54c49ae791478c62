"""Whitening, chat formatting and resampling against plain numpy and Python."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from versoscan.llm import chat, resampling, whitening

DATA = os.environ.get("VERSOSCAN_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return LETTERS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    def counts(texts):
        out = np.zeros(10000, np.int64)
        for t in texts:
            np.add.at(out, plain_features(t), 1)
        return out

    s, t = counts(x for _, x in docs), counts(target)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[i]) + 1) * (S + 10000) / ((int(s[i]) + 1) * (T + 10000)))) for i in range(10000)]
    rows = []
    for d, x in docs:
        f = plain_features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {r[:4]: i for i, r in enumerate(can[: percent * len(can) // 100], 1)}
    return sorted(((*r[:4], ranks.get(r[:4])) for r in rows), key=str)


def test_crc_of_spans():
    r = random.Random(4)
    data = np.frombuffer(r.randbytes(60_000), np.uint8)
    sizes = [0, 1, 2, 255, 256, 257, 511, 512, 513, 5000]
    begin = np.array([0, 0, *(r.randrange(50_000) for _ in range(400))])
    end = np.array([60_000, 0, *(b + r.choice(sizes) for b in begin[2:])])
    assert resampling.crc32_of_spans(data, begin, end).tolist() == [zlib.crc32(data[b:e].tobytes()) for b, e in zip(begin, end, strict=True)]


def test_resampling(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeXYZ09é√ ,-") for _ in range(r.randint(1, 6)))
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 120)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "ÉcoleA" * 20_000), (503, "a " * 50_000), (-7, "x" * 700 + " y " + "z" * 300), (504, "\x00\x7f !")]
    target = [t for _, t in docs[::40]] + [None, ""]
    a = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in docs], "doc_id long, text string, score string, rank double").repartition(6)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(a, b).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target)
    assert sum(x[4] is not None for x in got) > 10
    few = [(None, "b c d " * 10), (1, "b c d " * 10), (1, "b c d " * 10), (2, None)]
    c = spark.createDataFrame(few, "doc_id long, text string")
    half = resampling.resample(c, b, percent=100)
    assert sorted(x["rank"] for x in half.collect() if x["rank"]) == [1, 2, 3]
    assert resampling.resample(c.limit(0), b.limit(0)).count() == 0
    assert [x["weight"] == 0 for x in resampling.resample(c, b.limit(0)).where("doc_id = 2").collect()] == [True]


@needs_data
def test_resampling_on_given_tables(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [x[0] for x in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    got = resampling.resampling_query(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target)


def plain_whitening(rows):
    """By the dense covariance: {vec_id: (deviation, whitened)}, explained, n."""
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    sums = [int(s) for s in fit.sum(0)]
    out = {k: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (np.array(v) - mean) @ vectors / np.sqrt(values)) for k, v in x.items()}
    return out, values / ((fit - mean) ** 2).sum() * n, n


def check_whitening(got, rows):
    want, explained, n = plain_whitening(rows)
    assert len(got) == 4 * len(want)
    at = {(g.vec_id, g.component): g for g in got}
    for j in range(1, 5):
        mine = np.array([at[k, j].whitened for k in want])
        other = np.array([w[1][j - 1] for w in want.values()])
        sign = np.sign((mine * other).sum())
        assert np.abs(mine * sign - other).max() < 1e-9
        assert all(at[k, j].deviation == w[0] and at[k, j].n == n for k, w in want.items())
        assert all(at[k, j].explained == pytest.approx(explained[j - 1], rel=1e-9) for k in want)
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 24)) * np.linspace(3, 0.5, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a hot vector counts once
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [float("-inf")] * 24), (2004, [0.0] * 24)]
    df = spark.createDataFrame([(k, v, 1.5) for k, v in rows], "vec_id long, embedding array<float>, whitened double").repartition(7)
    vectors = whitening.integers(df)
    fitted = whitening.fit_whitener(vectors)
    assert fitted.residual < 1e-12 and fitted.n == 151
    check_whitening(whitening.whiten(vectors, fitted).collect(), rows)


@needs_data
def test_whitening_on_given_tables(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.whitening_query(spark, DATA).collect(), rows)


def test_whitening_of_odd_tables(spark):
    def of(rows, kind="double"):
        v = whitening.integers(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
        return whitening.whiten(v, whitening.fit_whitener(v)).orderBy("vec_id", "component").collect()

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [])]) == [] and of([(1, [0.5, 2.0]), (2, [0.5, 2.0])]) == []
    one = of([(1, [0.0]), (2, [1.0, 0.0]), (3, [2.0]), (3, [2.0])])  # shorter vectors are filled with 0
    assert [(o.vec_id, o.component, o.deviation) for o in one] == [(1, 1, 768**2), (2, 1, 0), (3, 1, 768**2), (3, 1, 768**2)]
    assert [abs(round(o.whitened, 9)) for o in one] == [round(1.5**0.5, 9), 0, round(1.5**0.5, 9), round(1.5**0.5, 9)]
    big = of([(1, [1e15, 0.0]), (2, [0.0, 1.0]), (None, [1e300, 3.0])])  # beyond a long
    assert big[0].vec_id is None and big[0].deviation is None
    large = of([(1, [1e8, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0])])
    assert large[0].deviation is None and large[0].deviation_decimal == (2 * 25600000000) ** 2 + 1024**2


def test_leading_components_are_found_or_refused():
    r = np.random.default_rng(8)
    for values in (np.linspace(2, 1, 90), 10.0 ** -np.arange(60), np.r_[[5.0] * 6, [1.0] * 60], np.r_[3.0, 2.0, np.zeros(50)], np.ones(40), np.r_[4.0, 3.0]):
        q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
        a = (q * values) @ q.T
        got, vectors, residual = whitening.leading(lambda b, a=a: a @ b, len(a), 4)
        assert got == pytest.approx(np.sort(values)[::-1][: len(got)], rel=1e-9) and residual < 1e-11
        assert len(got) == min(4, int((values > 1e-13 * values.max()).sum()))
        assert np.abs(a @ vectors - vectors * got).max() < 1e-11 * values.max()
    with pytest.raises(RuntimeError, match="not certified"):
        whitening.leading(lambda b: r.standard_normal(b.shape), 90, 4, rounds=3)


def odd_turns():
    r = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[\\INST]", "[/INST]", "[NEXT]", "[TEXT]", "[/ROLE]", "[ROLE]", "\\", "[", "<", "a", " ", "\n", "é", "😀", "INST]", "s>", "/"]
    rows = []
    for c in range(30):
        for t in range(r.randint(0, 12)):
            role = r.choice(["user", "assistant", "system", "tool[TEXT]x\n", None, "user", "assistant"])
            rows.append((c or None, r.choice([t, t, 3, None]), role, r.choice([None, "", "".join(r.choice(parts) for _ in range(r.randint(0, 8)))])))
    return rows + [(77, t, "user" if t % 3 else "assistant", f"t{t}[INST]") for t in range(500)] + [(78, 1, "user", "same")] * 50


@pytest.mark.parametrize(("least_hot", "piece"), [(1024, 256), (20, 7)])
def test_chat_round_trip(spark, least_hot, piece):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    out = chat.format_chats(turns, least_hot, piece)
    got = out.withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"))}).collect()
    assert sorted(str(g.conv_id) for g in got) == sorted({str(r[0]) for r in rows})
    for g in got:
        mine = sorted(((t is not None, t or 0), (role or "").encode(), (text or "").encode()) for c, t, role, text in rows if c == g.conv_id)
        mine = [(role.decode(), text.decode()) for _, role, text in mine]
        assert [tuple(b) for b in g.back] == mine
        assert "".join(g.loss) == "".join(text for role, text in mine if role == "assistant")
        assert sum(m.chars for m in g.mask) == len(g.formatted) and all(m.chars for m in g.mask)
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:], strict=False))
        assert len(re.findall(r"</s>|\[/INST\]|\[/ROLE\]", g.formatted)) == blocks  # merged, and nothing unescaped
    assert out.limit(0).count() == 0 and chat.format_chats(turns.limit(0)).count() == 0


def test_chat_text_and_mask(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "a"), (1, 2, "user", "</s>b"), (1, 3, "assistant", "ok"), (1, 4, "assistant", "")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(turns).first()
    assert row.formatted == "<s>[ROLE]system[TEXT]be[/ROLE][INST]a[NEXT]<\\/s>b[/INST]ok[NEXT]</s>"
    assert [m.chars for m in row.mask if m.loss] == [2]
    broken = turns.limit(1).select(chat.read_loss(F.lit(row.formatted + "x"), F.lit(None).cast("array<struct<loss:boolean,chars:int>>")).alias("loss"))
    assert broken.first().loss is None
