"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The field adds spans in other spellings (national phone numbers, addresses written
with "(at)", cards grouped unusually): it is trained on the driver from a small labelled table of sentences, and
decoded by Viterbi in numpy over all word sequences of a batch at once. Its sequences are the words around each word
with a digit, an at sign or "(at)" in any brackets, up to six to either side within a line; other words never carry a
label. An added span
must be plausible for its kind and must not touch a base span, so base spans always stay.

Defined results: a null or empty text has no spans (and the hash of the empty string); repeated rows and null ids get
a row each; an empty table gives an empty result; a text's length does not matter, all of it is read, and a line of
very many numbers is decoded in blocks of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from versoscan.llm import words as W
from versoscan.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
# fixed patterns; digit runs are entered at their start only, which finds the same matches in linear time
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = r"[0-9@]|[(\[{<][aA][tT][)\]}>]"  # what the field looks around
TRIGGER = re.compile(AT)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIDE = 6
CELLS = 16_384  # words, with padding, that go through Viterbi at once
BEFORE = 3  # words before a word that its features look at; one behind it
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CUES = {"call": "phone", "phone": "phone", "tel": "phone", "tel.": "phone", "mobile": "phone", "fax": "phone", "dial": "phone", "mail": "email", "email": "email", "e-mail": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "mastercard": "card", "amex": "card"}

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, not overlapping: from each at sign back over the local part and on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def in_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    spans = [(a, 0, b) for a, b in emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(in_byte(p) for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(word: str) -> str:
    """Runs of digits and letters as one character each, digits with their number: +1 is +d1, (988) is (d3)."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word, re.S):
        c = m[0][0]
        out.append(f"d{min(len(m[0]), 13)}" if "0" <= c <= "9" else "a" if c.isalpha() else c)
    return "".join(out)


def features(words: list[str]) -> list[list[str]]:
    """Of each word: its shape, its make-up, its neighbours' make-up and a cue word nearby."""
    kind = []
    for w in words:
        n = sum("0" <= c <= "9" for c in w)
        bare = w.strip("()[]<>.,;:!?\"'")
        made = "at" if "@" in w or bare.lower() in ("at", "(at)", "[at]") else "plain" if not n else "digits" if bare.isdigit() else "numeric" if n * 2 >= len(bare) else "mixed"
        kind.append((f"m={made}", f"n={min(n, 20)}", f"p={w.count('.') if n else 0}{'+' * w.startswith('+')}{'(' * w.startswith('(')}{'-' * ('-' in bare)}"))
    lower = [w.lower().strip("()[]<>,;:!?") for w in words]
    out = []
    for i, w in enumerate(words):
        cue = next((CUES[lower[j]] for j in range(i - 1, max(-1, i - 4), -1) if lower[j] in CUES), "none")
        around = [kind[j][0] if 0 <= j < len(words) else "m=edge" for j in (i - 1, i + 1)]
        out.append(["bias", f"s={shape(w)}", *kind[i], f"c={cue}/{kind[i][0]}", f"l={around[0]}/{kind[i][0]}", f"r={around[1]}/{kind[i][0]}", f"ln={kind[i - 1][1] if i else 'edge'}/{kind[i][1]}", f"rn={kind[i + 1][1] if i + 1 < len(words) else 'edge'}/{kind[i][1]}"])
    return out


def labelled_table(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled sentences: spellings of each kind, and numbers that are none, between ordinary words."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(1, 9)))

    def card() -> str:
        number = "4" + d(14)
        return next(number + c for c in "0123456789" if luhn(number + c))

    def grouped(sep: str) -> str:
        c = card()
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    made = [
        ("email", lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com"), ("email", lambda: f"{w()}@{w()}.org"), ("email", lambda: f"{w()} (at) {w()}.com"), ("email", lambda: f"{w()}{d(2)} [at] {w()}.net"), ("email", lambda: f"{w()} [at] {w()}.org"), ("email", lambda: f"{w()}.{w()} (at) {w()}.com"),
        ("ip", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))), ("ip", lambda: "[" + ".".join(str(r.randint(1, 255)) for _ in range(4)) + "]:" + d(4)),
        ("card", card), ("card", lambda: grouped(" ")), ("card", lambda: grouped("-")), ("card", lambda: grouped(".")), ("card", lambda: grouped("/")),
        ("phone", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}"), ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"00{d(2)} {d(3)} {d(7)}"), ("phone", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        ("", lambda: r.choice(["19", "20"]) + d(2)), ("", lambda: f"{d(1)}.{d(1)}"), ("", lambda: f"version {d(1)}.{d(1)}.{d(2)}"), ("", lambda: f"{d(2)}%"), ("", lambda: f"{d(3)},{d(3)}"), ("", lambda: f"{d(4)}-{d(2)}-{d(2)}"), ("", lambda: d(r.randint(1, 9))), ("", lambda: d(20) + d(r.randint(0, 9))),
        ("", lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(16))), ("", lambda: "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18))), ("", lambda: f"@{w()}"), ("", lambda: f"{d(2)}:{d(2)}"), ("", lambda: f"{w()}-{d(2)}"), ("", lambda: f"{d(1)}) {w()}"), ("", lambda: f"{d(2)}.{d(2)}.{d(4)}"), ("", lambda: f"{d(3)} {w()} {d(3)}"),
        ("", lambda: f"{w()} at {w()}"), ("", lambda: f"{w()} {r.choice(('(at)', '[at]'))} {w()} {w()}"), ("", lambda: f"{d(5)}-{d(4)}"), ("", lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}"), ("", lambda: f"{d(3)} {d(3)}"),
    ]
    out = []
    for i in range(n):
        kind, text = made[i % len(made)]
        words, labels = [w() for _ in range(r.randint(0, 5))], []
        if kind and r.random() < 0.3:
            words.append(r.choice([c for c, k in CUES.items() if k == kind]))
        labels = ["O"] * len(words)
        tokens = text().split(" ")
        words += tokens
        labels += [f"{'I' if j else 'B'}-{kind}" if kind else "O" for j in range(len(tokens))]
        if r.random() < 0.3:
            words[-1] += r.choice(".,;")
        tail = [w() for _ in range(r.randint(0, 5))]
        out.append((words + tail, labels + ["O"] * len(tail)))
    return out


class Field(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  # features x labels; the last row is that of unknown features and stays zero
    moves: np.ndarray  # labels x labels, from the row to the column
    start: np.ndarray


def _padded(sequences: list[list[list[int]]], unknown: int) -> tuple[np.ndarray, np.ndarray]:
    longest, wide = max(map(len, sequences)), max(len(f) for s in sequences for f in s)
    x = np.full((len(sequences), longest, wide), unknown, np.int64)
    for i, s in enumerate(sequences):
        if s:
            x[i, : len(s)] = s
    return x, np.array([len(s) for s in sequences])


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.1, decay: float = 2e-4) -> Field:
    """Maximum likelihood by gradients from forward and backward passes over all sentences at once."""
    found = [features(w) for w, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for s in found for x in s for f in x}))}
    x, sizes = _padded([[[index[f] for f in fs] for fs in s] for s in found], len(index))
    labels = len(LABELS)
    y = np.zeros(x.shape[:2], np.int64)
    for i, (_, names) in enumerate(rows):
        y[i, : len(names)] = [LABELS.index(v) for v in names]
    inside = np.arange(x.shape[1])[None] < sizes[:, None]
    count, length = x.shape[:2]
    parts = [np.zeros((len(index) + 1, labels)), np.zeros((labels, labels)), np.zeros(labels)]
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    one = np.eye(labels)
    gold = one[y] * inside[..., None]
    pairs = inside[:, 1:]
    order = np.argsort(x.reshape(-1), kind="stable")  # groups the words that have a feature
    word = order // x.shape[2]
    present, first = np.unique(x.reshape(-1)[order], return_index=True)
    gold_moves = np.einsum("itj,itk->jk", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    for step in range(1, rounds + 1):
        weights, moves, start = parts
        emit = weights[x].sum(axis=2)
        forward, backward = np.zeros((count, length, labels)), np.zeros((count, length, labels))
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, length):
            forward[:, t] = np.where(inside[:, t, None], lse(forward[:, t - 1, :, None] + moves[None], 1) + emit[:, t], forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            backward[:, t] = np.where(inside[:, t + 1, None], lse(moves[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None], 2), backward[:, t + 1])
        z = lse(forward[:, -1], 1)
        at = np.exp(forward + backward - z[:, None, None]) * inside[..., None]
        both = np.exp(forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None] - z[:, None, None, None]) * pairs[..., None, None]
        wrong = gold - at
        slope = [np.zeros_like(weights), gold_moves - both.sum(axis=(0, 1)), wrong[:, 0].sum(axis=0)]
        slope[0][present] = np.add.reduceat(wrong.reshape(-1, labels)[word], first, axis=0)
        for p, g, (m, v) in zip(parts, slope, memory, strict=True):
            g = g / count - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        parts[0][-1] = 0
    return Field(index, *parts)


@functools.cache
def trained() -> Field:
    return train(labelled_table())


def decode(field: Field, sequences: list[list[str]]) -> list[np.ndarray]:
    """The best labels of each word sequence. Sequences of similar length go through Viterbi together, as many as have
    CELLS words with padding; a longer one goes alone, in blocks that hand their scores on."""
    unknown, labels = len(field.index), np.arange(len(LABELS))
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    while order:
        # the longest of those that are left, and as many more as fit beside it
        longest = len(sequences[order[-1]])
        count = max(1, CELLS // max(1, longest))
        mine, order = order[-count:], order[:-count]
        if not longest:
            break
        sizes = np.array([len(sequences[i]) for i in mine])
        back = np.zeros((len(mine), longest, len(LABELS)), np.uint8)
        best, width = np.zeros(0), max(1, CELLS // len(mine))
        for a in range(0, longest, width):
            begin = max(0, a - BEFORE)
            found = [features(sequences[i][begin : a + width + 1])[a - begin : a - begin + width] for i in mine]
            x, _ = _padded([[[field.index.get(f, unknown) for f in fs] for fs in s] for s in found], unknown)
            emit = field.weights[x].sum(axis=2)
            for t in range(a, a + emit.shape[1]):
                if not t:
                    best = field.start + emit[:, 0]
                    continue
                options = best[:, :, None] + field.moves[None]
                inside = (t < sizes)[:, None]
                back[:, t] = np.where(inside, options.argmax(axis=1), labels)
                best = np.where(inside, options.max(axis=1) + emit[:, t - a], best)
        label = best.argmax(axis=1)
        found = np.zeros((len(mine), longest), np.uint8)
        for t in range(longest - 1, -1, -1):
            found[:, t] = label
            label = back[np.arange(len(mine)), t, label]
        for i, s, n in zip(mine, found, sizes.tolist(), strict=True):
            out[i] = s[:n]
    return out


def sequences_of(text: str) -> Iterator[np.ndarray]:
    """Words around those with a digit or an at sign, within a line: start and end of each."""
    at = 0
    while m := TRIGGER.search(text, at):
        begin = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        words = np.fromiter((x for w in WORD.finditer(text, begin, end) for x in w.span()), np.int64).reshape(-1, 2)
        marks = np.fromiter((t.start() for t in TRIGGER.finditer(text, begin, end)), np.int64)
        hit = np.unique(np.searchsorted(words[:, 0], marks, side="right") - 1)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.maximum(hit - SIDE, 0), 1)
        np.add.at(change, np.minimum(hit + SIDE + 1, len(words)), -1)
        wanted = np.flatnonzero(np.cumsum(change)[:-1])
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
            yield words[run]
        at = end


def plausible(kind: int, text: str) -> bool:
    n = len(only_digits(text))
    if kind == 0:
        return "." in text and ("@" in text or "at" in text.lower())
    if kind == 1:
        return len(parts := re.findall(r"[0-9]+", text)) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    return luhn(only_digits(text)) and 12 <= n <= 19 if kind == 2 else 7 <= n <= 15


def added_spans(text: str, words: np.ndarray, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """The labelled runs of words that are plausible and touch none of the sorted base spans."""
    out, i = [], 0
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    while i < len(words):
        name = LABELS[labels[i]]
        if name == "O":
            i += 1
            continue
        kind, j = name[2:], i + 1
        while j < len(words) and LABELS[labels[j]] == f"I-{kind}":
            j += 1
        a, b = int(words[i, 0]), int(words[j - 1, 1])
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        k = KINDS.index(kind)
        before = bisect_left(starts, b)  # base spans that start before the end; reach is how far they go
        if plausible(k, text[a:b]) and not (before and reach[before - 1] > a):
            out.append((a, k, b))
        i = j
    return out


def spans_of(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    runs = [(i, run) for i, t in enumerate(texts) for run in sequences_of(t)]
    all_spans = [list(b) for b in base]
    for (i, run), labels in zip(runs, decode(field, [[texts[i][a:b] for a, b in run.tolist()] for i, run in runs]), strict=True):
        all_spans[i] += added_spans(texts[i], run, labels, base[i])
    return list(zip(base, (sorted(s) for s in all_spans), strict=True))


RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find_personal_data(docs: DataFrame, field: Field | None = None, mask: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text, ...): the counts of base spans, their hash and all spans; the other columns stay.

    A column of docs named like a result is left out. With ``mask`` each span found in text is replaced by [EMAIL], [IP],
    [CARD] or [PHONE], overlapping spans as one; the spans are those of the text as it was. One narrow pass.
    """
    field = field or trained()
    keep = [c for c in docs.columns if c not in RESULTS]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in W.chunks([batch]):
                marked = np.flatnonzero(pc.match_substring_regex(part.column("text"), AT).to_numpy(zero_copy_only=False))
                found: list[tuple[list[Span], list[Span]]] = [([], [])] * part.num_rows
                texts = part.column("text").take(pa.array(marked)).to_pylist()
                for i, spans in zip(marked.tolist(), spans_of(texts, field), strict=True):
                    found[i] = spans
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found])
                original = batch.slice(done, part.num_rows)
                done += part.num_rows
                columns = {c: original.column(c) for c in keep}
                if mask and any(spans for _, spans in found):
                    columns["text"] = pa.array([masked(t, written(spans)) if spans else t for t, (_, spans) in zip(original.column("text").to_pylist(), found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), *counts, digests, pa.array([written(s) for _, s in found])], names=[*keep, *RESULTS])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return docs.select(*keep).mapInArrow(run, schema)


def mask_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with each span found in text replaced by a mark of its kind."""
    found = find_personal_data(docs, field, mask=True)
    return found.select(*(c for c in docs.columns if c in found.columns and c not in RESULTS))


def masked(text: str, spans: str) -> str:
    out, at = [], 0
    for span in spans.split(","):
        kind, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
