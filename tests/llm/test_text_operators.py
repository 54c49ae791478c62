"""Operators on single documents against plain Python: quality, personal data, packing, pages, contamination."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versoscan.llm import decontaminate, html, packing, pii, quality
from versoscan.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "é\x1cü a\xa0b", "x " * 5000, "same same same same same same same\nline\nline\n\nline", "😀 b 😀 b 😀 b 😀 b 😀 b 😀 b"]
DOCS = "doc_id long, text string, n_words string, spans int"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and extra columns whose names clash."""
    rows = [(i, t, "n", 1) for i, t in enumerate(ODD)] + [(3, "a", "n", 1), (None, "no id here at all", "n", 1)]
    return spark.createDataFrame(rows, DOCS)


def base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#😀", max_size=60), min_size=1, max_size=5))
def test_statistics(texts):
    counts, _ = quality.statistics(pa.array(texts, pa.large_string()))
    assert list(zip(*(counts[b].tolist() for b in quality.BASE))) == [base(t) for t in texts]


def test_quality_rows(spark):
    got = quality.score_quality(odd_docs(spark), None).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id here at all" if r.doc_id is None else ODD[r.doc_id]
        assert tuple(r[b] for b in quality.BASE) == base(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.score_quality(odd_docs(spark).limit(0), None).count() == 0


def test_trees_are_monotonic_and_accurate():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    bad = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * r.standard_normal(3000) > 0.8).astype(float)
    trees = quality.grow(x, bad, rising=(0,))
    test = r.random((2000, 4))
    assert (((trees.score(test) > 0) == (test[:, 0] + 0.3 * test[:, 1] > 0.8)).mean()) > 0.93
    higher = test.copy()
    higher[:, 0] += r.random(2000)
    assert (trees.score(higher) >= trees.score(test) - 1e-12).all()


def test_flattened_trees_equal_a_walk_of_their_nodes():
    r = np.random.default_rng(5)
    x = np.concatenate([r.random((800, 3)), r.integers(0, 3, (800, 1))], axis=1)
    bad = ((x[:, 0] > 0.4) ^ (x[:, 3] > 1)).astype(float)
    trees = quality.grow(x, bad, rising=(1,), n_trees=7)

    def walk(row):
        total = trees.bias
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    rows = np.concatenate([x, r.random((200, 4)) * 4 - 1])  # the cuts' own values among them
    assert (trees.feature >= 0).sum() > 10 and trees.score(rows) == pytest.approx([walk(row) for row in rows], abs=1e-12)


def test_verdicts_are_those_of_the_trees(spark):
    """The whole operator with trees: a text is kept where its base rules hold and the walk of its statistics says good."""
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdeé#") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 80))) for _ in range(300)]
    _, x = quality.statistics(pa.array(texts, pa.large_string()))
    trees = quality.grow(x, (np.array([t.count("#") for t in texts]) > 20).astype(float), tuple(quality.FEATURES.index(f) for f in quality.RISING), n_trees=9)
    got = {row.doc_id: row for row in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees).collect()}
    odds = trees.score(x)
    assert [got[i].kept for i in range(300)] == [not got[i].base_failed and odds[i] < 0 for i in range(300)]
    assert {got[i].kept for i in range(300) if not got[i].base_failed} == {True, False}


def test_fit_without_labels(spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd_docs(spark), labels) is None and quality.fit(odd_docs(spark), labels.limit(0)) is None


def brute_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1290 +-()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def test_field_on_held_out_sentences():
    rows = pii.labelled_table(600, seed=77)
    got = pii.decode(pii.trained(), [w for w, _ in rows])
    assert np.mean([[pii.LABELS[x] for x in g] == labels for g, (_, labels) in zip(got, rows)]) > 0.97


def test_viterbi_equals_enumeration():
    import itertools

    field = pii.trained()
    for words in (["call", "555-123-4567"], ["me", "(at)", "x.com", "12"], ["1.2.3.4"]):
        x = [[field.index.get(f, len(field.index)) for f in fs] for fs in pii.features(words)]
        emit = [field.weights[f].sum(axis=0) for f in x]
        score = lambda y: field.start[y[0]] + sum(e[k] for e, k in zip(emit, y)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=score)
        assert pii.decode(field, [words, ["other", "words", "1"] * 3])[0].tolist() == list(best)


def test_decoding_in_blocks(monkeypatch):
    """Blocks that hand their scores on give the labels of one block; empty sequences give none."""
    rows = [w for w, _ in pii.labelled_table(120, seed=3)] + [[]] + [[x for w, _ in pii.labelled_table(40, seed=4) for x in w]]
    whole = [x.tolist() for x in pii.decode(pii.trained(), rows)]
    monkeypatch.setattr(pii, "CELLS", 7)
    assert [x.tolist() for x in pii.decode(pii.trained(), rows)] == whole


def test_long_lines_of_numbers():
    """Very long digit runs, and a line of 50,000 numbers beside short texts, within bounded memory."""
    import tracemalloc

    r = random.Random(1)
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    line = " ".join(str(r.randint(0, 10 ** r.randint(1, 17))) for _ in range(50_000))
    field = pii.trained()
    tracemalloc.start()
    found = pii.spans_of([line, *["call 555-123-4567 now"] * 2000], field)
    assert tracemalloc.get_traced_memory()[1] < 400e6 and found[1] == ([], [(5, 3, 17)])
    tracemalloc.stop()
    assert pii.shape("1" + "a" * 100 + "-2") == "d1a-d1"


def test_personal_data_rows(spark):
    text = "Öl: max.m@mail.example.com\ncall (555) 123-4567 or +1 (988) 555-2485, card 4111-1111-1111-1111 at 10.0.0.255; 999.1.1.1 in 2024"
    docs = spark.createDataFrame([(0, text, 1), (1, None, 1), (2, "clean text of 12 words, version 4.0", 1), (2, "clean text of 12 words, version 4.0", 1)], "doc_id long, text string, n_email int")
    rows = pii.find_personal_data(docs).orderBy("doc_id").collect()
    r, spans = rows[0], brute_spans(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
    found = r.spans.split(",")
    assert set(pii.written(spans).split(",")) <= set(found) and f"phone:{text.index('(555)')}:{text.index(' or')}" in found
    assert all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in rows[1:]) and len(rows) == 4
    assert pii.masked(text, r.spans).count("[PHONE]") == 2 and "mail.example" not in pii.masked(text, r.spans)
    masked = pii.mask_personal_data(docs.drop("n_email")).orderBy("doc_id").collect()
    assert masked[2].text == "clean text of 12 words, version 4.0" and "[EMAIL]" in masked[0].text


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab, \n\t'é\xa0　12<|endoftext|>", max_size=40), min_size=1, max_size=4))
def test_encoder(texts, tokenizer):
    import public_tokenizers

    ids, bounds = packing.Encoder.of(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array(texts, pa.large_string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_encoder_on_prose(tokenizer, monkeypatch):
    """More pieces than a small table holds, long words, other white space, and pieces at a text's ends."""
    import public_tokenizers

    monkeypatch.setattr(packing, "TABLE_BITS", 8)
    r = random.Random(3)
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    word = lambda: "".join(r.choice("aeioulnrstEÉß12'.,-日") for _ in range(r.choice([1, 2, 3, 5, 8, 90])))
    for _ in range(6):
        texts = ["".join(word() + r.choice([" ", " ", " ", "  ", "\n", "\n\n", " \t", "\xa0"] if k % 3 == 0 else [" ", "\n"]) for _ in range(r.choice([0, 1, 60, 400]))) for k in range(12)]
        texts = [t.strip() if i % 2 else t for i, t in enumerate(texts)]
        ids, bounds = encoder.encode(pa.array(texts, pa.large_string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert encoder.known.pieces <= 256


def test_packing_round_trip(spark, tokenizer):
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["the", "oner", "zq", "12"]) for _ in range(r.choice([0, 3, 80, 300, 2500]))) for i in range(300)}
    docs = spark.createDataFrame([(i, t or None, "x") for i, t in texts.items()], "doc_id long, text string, start string")
    rows = packing.packing_of(docs.repartition(3)).collect()
    assert packing.packing_of(docs.limit(0)).count() == 0
    pieces, sequences = {}, {}
    for x in rows:
        pieces.setdefault(x.doc_id, []).append(x)
        sequences.setdefault(x.sequence_id, []).append(x)
    for i, t in texts.items():
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        mine = sorted(pieces[i], key=lambda x: x.start)
        assert [x.start for x in mine] == np.cumsum([0] + [x.length for x in mine[:-1]]).tolist() and sum(x.length for x in mine) == len(want) == mine[0].doc_tokens
        assert all(zlib.crc32(np.array(want[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 for x in mine)
    fills = []
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == np.cumsum([0] + [x.length for x in s[:-1]]).tolist()
        fills.append(sum(x.length for x in s))
    assert all(f == 1024 or f & (f - 1) == 0 for f in fills)


def fill(pieces):
    return sum(len(x[2]) for x in pieces)


def squares(p):
    return sum(c * c for c in Counter(fill(w) for level in p.levels for w in level).values())


def test_placement_is_the_least_sum_of_squares():
    """Every placement against all levels tried by hand; ties go to the fullest window."""
    r = random.Random(8)
    p = packing.Packer(window=20)
    for i in range(1500):
        n = r.choice([1, 3, 6, 7, 9, 12, 19])
        count = Counter(fill(w) for level in p.levels for w in level)
        options = []
        for h in [0, *(h for h in count if h + n <= 20)]:
            after = Counter(count)
            after[h] -= h > 0
            after[h + n] += h + n < 20
            options.append((sum(c * c for c in after.values()), -h))
        p.add(i, np.full(n, i, np.uint32))
        assert squares(p) == min(options)[0] and {h: int(c) for h, c in enumerate(p.counts[:20]) if c} == dict(Counter(fill(w) for level in p.levels for w in level))


def test_packer_bounds_open_windows():
    p = packing.Packer(window=16, max_open=4)
    for i in range(200):
        p.add(i, np.full(9, i, np.uint32))
        assert p.open <= 4
    p.close()
    assert sum(map(fill, p.done)) == 1800
    assert Counter(map(fill, p.done))[16] == 112


def test_last_windows_are_closed_by_the_rule():
    """Of 1000 documents: all but one of the windows that are open at the end are filled by placement, none is padded."""
    r = np.random.default_rng(2)
    p = packing.Packer()
    for i, n in enumerate(r.lognormal(5, 1.2, 1000).astype(int) + 1):
        p.add(i, np.zeros(n, np.uint32))
    before, total = len(p.done), sum(map(fill, p.done)) + sum(fill(w) for level in p.levels for w in level)
    p.close()
    sizes = Counter(map(fill, p.done))
    assert before > 0 and sizes[1024] == total // 1024 and sum(k * v for k, v in sizes.items()) == total
    assert all(k & (k - 1) == 0 for k in sizes) and len(p.done) - sizes[1024] <= 10
    seen = {}
    for pieces in p.done:
        for doc, start, ids, tokens in pieces:
            seen.setdefault((doc, tokens), []).append((start, len(ids)))
    for (_, tokens), parts in seen.items():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts)[:-1])]).tolist() and sum(n for _, n in parts) == tokens


def test_packing_odd_rows(spark):
    rows = packing.packing_of(odd_docs(spark)).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 6 and {r.doc_id for r in rows} == {None, *range(len(ODD))}
    assert sorted(r.doc_tokens for r in rows if r.doc_id == 3) == [2, 2] and max(r.doc_tokens for r in rows) > 5000


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("plain words only", "plain words only"),
        ("<article><h1>A &amp; B</h1><p>one<br>two &lt;b&gt;&nbsp; c <!-- no --> d<p>t<b>hr</b>ee</article><footer>&copy; x</footer>", "A & B\n\none two <b> c d\n\nthree"),
        ("<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy this thing now.</div><article><h1>Title</h1><p>Some long sentence of the article itself.</p></article><div id=comments><p>I like this a lot, thanks.</p></div>", "Title\n\nSome long sentence of the article itself."),
        ("<script>var a='<p>no</p>';</script><article><p>x > y and z &am w</p></article><div class=\"a", "x > y and z &am w"),
        ("<nav><a href=/>Home</a></nav><footer>© 2024</footer>", ""),
        ("<article><p>A good start here.</p><script src=/js/>var secret = 1;</script><p>And an end to it.</p></article>", "A good start here.\n\nAnd an end to it."),
        ("<article><p>A start it is.</p><script src=a.js />hidden()</script><p>The <a href=/x/>end</a> of it all.</p></article>", "A start it is.\n\nThe end of it all."),
        ("<article><p>First of them.</p><button>Share<p>Second one here.</p><p>Third and last.</p></article>", "First of them.\n\nSecond one here.\n\nThird and last."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds here.</p><svg viewBox='0 0'/><p>After it all.</p></article>", "So x=1 holds here.\n\nAfter it all."),
        ("<div><div><a href=/>Home</a> <a href=/b>News</a></div><div>The river rose by two metres overnight, and the town was cut off.</div><div>Nobody was hurt, said the mayor on Tuesday.</div><div>© 2024 Site</div></div>", "The river rose by two metres overnight, and the town was cut off.\n\nNobody was hurt, said the mayor on Tuesday."),
    ],
)
def test_main_text(source, text):
    assert html.main_texts([source], html.trained()) == [text]


def test_held_out_pages():
    pages, labels = html.labelled_pages(200, seed=11)
    forest = html.gather(pages, html.trained().index)
    kept = html.marginals(forest, html.trained())[forest.leaf] >= 0.5
    assert len(pages) > 190 and (kept == np.concatenate([np.array(x, bool) for x in labels])).mean() > 0.985


def test_messages_equal_enumeration():
    import itertools

    page = html.parse("<div><p>a b c.</p><ul><li>x</li></ul></div>")
    model = html.trained()
    forest = html.gather([page], model.index)
    unary = model.weights[forest.features].sum(axis=1)
    total, one = 0.0, np.zeros(len(page.parent))
    for z in itertools.product((0, 1), repeat=len(page.parent)):
        s = sum(unary[i] for i, v in enumerate(z) if v) + sum(model.edges[int(forest.leaf[i])][z[page.parent[i]]][z[i]] for i in range(1, len(z)))
        total += np.exp(s)
        one += np.array(z) * np.exp(s)
    assert html.marginals(forest, model) == pytest.approx(one / total)


def test_page_rows(spark):
    rows = [(0, "u", "<article><p>long enough text here.</p></article>", "x"), (1, None, None, "x"), (None, "u", "", "x"), (0, "u", "<article><p>long enough text here.</p></article>", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("long enough text here.", 22), ("long enough text here.", 22)]
    paragraphs = ["The river rose by two metres overnight, and the town was cut off.", "Nobody was hurt, said the mayor on Tuesday."]
    inside = "".join(f"<p>{p}</p>" for p in paragraphs)
    for deep in ("<div>" * 3000 + inside, "<div>" * 3000 + inside + "</div>" * 3000 + "<footer>© x</footer>"):
        assert html.main_texts([deep], html.trained()) == ["\n\n".join(paragraphs)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 4))
def test_edits(item, text, most):
    each = [levenshtein(item, text[:n]) for n in range(len(text) + 1)]
    rows = [(item, text, most), (item[:1], text[:2], most), (item, [], most)]
    sizes, room = (np.array([len(x[k]) for x in rows]) for k in (0, 1))
    items, texts = (np.array([[*x[k], *[9] * (30 - len(x[k]))] for x in rows], np.uint64) for k in (0, 1))
    n, length = decontaminate.edits(items, sizes, texts, room, np.array([x[2] for x in rows]))
    assert n[0] == min(min(each), most + 1) and (n[0] > most or each[length[0]] == n[0])
    assert n[0] > most or abs(length[0] - len(item)) == min(abs(k - len(item)) for k, e in enumerate(each) if e == n[0])
    assert n[2] == min(len(item), most + 1)


def exhaustive(items, docs, share=0.2):
    """The best match of each text and item over all start words: (doc, item) -> (edits, first start word)."""
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            x = split(item)
            most = int(share * len(x) + 1e-9)
            best = min(((min(levenshtein(x, w[p : p + n]) for n in range(max(0, len(x) - most), len(x) + most + 1)), p) for p in range(len(w))), default=(most + 1, 0)) if x else (1, 0)
            if x and best[0] <= most:
                out[d, i] = best
    return out


def test_leaks_equal_exhaustive_search(spark):
    """Ids, edits and starts of all matches against every window of every text, ties and short items included."""
    r = random.Random(31)
    word = lambda: r.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 12])] + [(20, "ab cd!"), (21, ""), (22, None)]
    items[0] = (0, "zebra")
    docs = []
    for d in range(70):
        w = [word() for _ in range(r.randint(3, 20))]
        if d % 5:
            x = (items[d % 8][1] or "").split()
            changed = [v if r.random() > 0.08 else word() for v in x]
            w[2:2] = changed + (x if d % 5 == 1 else [])
        docs.append((d, " ".join(w)))
    want = exhaustive(items, docs)
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = dict(docs)
    got = {(x.doc_id, x.item_id): (x.edits, len(texts[x.doc_id][: x.start].split())) for x in rows}
    assert len(got) == len(rows) and set(got.items()) <= set(want.items())
    assert len(got) >= 0.95 * len(want) > 40


@pytest.mark.parametrize("n", [5, 8, 15, 30, 60, 200, 400])
def test_recall_at_the_largest_distance(n):
    """Items of n words with as many edits as may be, each in a text of its own."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    count = 60 if n < 100 else 25
    items = [(i, [word() for _ in range(n)]) for i in range(count)]
    bench = decontaminate.prepare([(i, " ".join(w)) for i, w in items])
    texts = []
    for _, w in items:
        w, places = list(w), sorted(r.sample(range(n), n // 5), reverse=True)
        for k in places:
            w[k : k + 1] = r.choice([[word()], [], [w[k], word()]])
        texts.append(" ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]))
    text, item, *_ = decontaminate.matches(bench, W.find_words(pa.array(texts, pa.large_string()), decontaminate.SEPARATOR, decontaminate.LOWER))
    found = set(zip(text.tolist(), item.tolist()))
    assert found <= {(i, i) for i in range(count)} and len(found) >= 0.95 * count


def test_leaks_and_recall(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 50))).capitalize() + ".") for i in range(60)]
    docs, planted = [], set()
    for d in range(300):
        body = [word() for _ in range(120)]
        if d % 3 == 0:
            i, text = r.choice(items)
            w = text.lower().strip(".").split()
            for _ in range(r.randint(0, int(0.2 * len(w)))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[word()], [], [w[k], word()]])
            body[40:40] = w
            planted.add((d, i))
        docs.append((d, " ".join(body), 1))
    docs += [(1000, None, 1), (1001, "", 1), (0, docs[0][1], 1)]
    bench = spark.createDataFrame([*items, (90, None), (91, "not found"), (92, items[0][1])], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, edits int")
    for size in (1 << 20, 700):  # in one block and in several
        rows = decontaminate.find_leaks(frame, bench, block_bytes=size).collect()
        found = {(x.doc_id, x.item_id) for x in rows if x.item_id != 92}
        assert found <= planted and len(found) >= 0.97 * len(planted) and {x.edits <= 0.2 * x.item_words for x in rows} == {True}
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_leaks_of_odd_rows(spark):
    """Null ids, repeated rows, a very long text, a text that is one long word; equal items match alike."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    item = " ".join(word() for _ in range(20))
    long = " ".join([*(word() for _ in range(50_000)), item, *(word() for _ in range(50_000))])
    rows = [(None, item), (1, item), (1, item), (2, long), (3, "x" * 300_000), (4, None), (5, item + "é " + item)]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, start string")
    bench = spark.createDataFrame([(7, item, 0), (8, item, 0), (None, item, 0)], "item_id long, text string, edits int")
    got = Counter((x.doc_id, x.item_id, x.edits, x.start) for x in decontaminate.find_leaks(docs, bench).collect())
    want = Counter((d, i, 0, s) for d, s in ((None, 0), (1, 0), (1, 0), (2, long.index(item)), (5, len(item) + 2)) for i in (7, 8, None))
    assert got == want


def test_words_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, ""]), pa.array([1, 2, 3, 4])], names=["text", "k"])
    parts = list(W.chunks([batch], limit=10))
    assert [p.column("k").to_pylist() for p in parts] == [[1, 2], [3, 4]] or [p.column("k").to_pylist() for p in parts] == [[1, 2], [3], [4]]
    assert [t for p in parts for t in p.column("text").to_pylist()] == ["ab", "", "c" * 50, ""]


@pytest.mark.parametrize(
    "source, parts",
    [
        ("<article><p>First.</p><button>Share<p>Second.</p><p>Third.</p></article><p>Last.</p>", ["First.", "Second.", "Third.", "Last."]),
        ("<div><button>One</div><p>Text.</p><button>Two</button><p>More.</p>", ["Text.", "More."]),
        ("<div><svg><g></div><p>Text.</p><svg></svg>", ["Text."]),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", ["So x=1 holds."]),
        ("<p>See <object data=a>the fallback</object> here.</p>", ["See the fallback here."]),
        ("<p>Hi <button>x <b>y</b></button> you</p><noscript><p>no</p></noscript>", ["Hi you"]),
    ],
)
def test_unclosed_elements(source, parts):
    assert [t for t in html.parse(source).text if t is not None] == parts


def thue_morse(a, b, doublings):
    """A word over two letters; with a and b swapped, its polynomial modulo a power of two is the same from some length on."""
    s = [a]
    for _ in range(doublings):
        s += [b if c == a else a for c in s]
    return "".join(s)


def test_texts_of_equal_polynomials_are_told_apart():
    x, y = thue_morse("a", "b", 11), thue_morse("b", "a", 11)
    words = W.find_words(pa.array([f"{x} {y} {x}"]))
    h = W.word_hashes(words)
    assert h[0] == h[2] != h[1]
    base, _ = quality.statistics(pa.array([f"{x}\n{y}\n{x}", f"{x}\n{y}"]))
    assert base["n_dup_lines"].tolist() == [1, 0]


def test_field_looks_at_spelled_addresses():
    """Hand-written sentences, through the whole search: the words alone make the field look."""
    wanted = {
        "write to john (at) example.com please": "john (at) example.com",
        "ask mary [at] example.org about it": "mary [at] example.org",
        "call 555-123-4567 after noon": "555-123-4567",
        "we meet at noon, at the mill (see above)": None,
        "the sign (at) is read as at": None,
        "version 3.11.2 of 2024-05-01": None,
    }
    found = pii.spans_of(list(wanted), pii.trained())
    for (text, span), (_, spans) in zip(wanted.items(), found, strict=True):
        assert [text[a:b] for a, _, b in spans] == ([span] if span else [])


PARAGRAPH = "<p>The old mill stood by the river for many years. People came from far away to see it turn.</p>"
SENTENCE = "The council met on Tuesday to decide what the town should do."


@pytest.mark.parametrize("wrap", ["<div><p>{}</p></div>", "<div class='wp-block-group'><p>{}</p></div>", "<div><div><p>{}</p></div></div>", "<section><p>{}</p></section>", "<div class='figure'><p>{}</p></div>", "<blockquote><p>{}</p><footer>John Smith</footer></blockquote>"])
@pytest.mark.parametrize("times", [1, 3])
def test_wrapped_paragraphs_stay(wrap, times):
    source = f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A title here</h1>{PARAGRAPH}{wrap.format(SENTENCE) * times}{PARAGRAPH}</article><footer><p>Copyright 2024</p></footer></body></html>"
    text = html.main_texts([source], html.trained())[0]
    assert text.count(SENTENCE) == times and text.count("old mill") == 2 and "Home" not in text and "Copyright" not in text


def test_unbalanced_elements_are_linear():
    def seconds(n):
        began = time.perf_counter()
        html.parse("<article>" + "<button>x " * n + "</article>" + "</button>" * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 5


def test_short_items_match_whole_texts(spark):
    docs = spark.createDataFrame([(0, "Red fox!"), (1, "red FOX!"), (2, "the red fox! ran"), (3, None), (4, "one two three four five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "red fox!"), (1, "two three four five six")], "item_id long, text string")
    kept = decontaminate.without_leaks(docs, bench, whole_below=5).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3]
