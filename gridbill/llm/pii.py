"""Personal data by fixed patterns and a character-level bidirectional LSTM-CRF (operator 6).

The patterns give the base spans. The tagger adds spans that the patterns miss
(written-out addresses, numbers without a prefix, other separators). It is trained in
numpy on labelled spans: windows of a bounded sample of the documents, labelled by
the patterns, and the same windows with their spans rewritten. Every kind needs a
digit, an ``@`` or a bracketed "at", so the tagger reads each whole text around all
of these: windows that overlap by half, whose emissions are averaged (the middle of
a window counts most) before one Viterbi pass per region, so that neighbouring
windows agree on one reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common, sample

KINDS = ("email", "ip", "card", "phone")
WINDOW, REACH = 64, 32
HIDDEN, EPOCHS, BATCH, RATE = 24, 8, 64, 0.01
#: Windows of documents that the tagger learns from, at most (those with the smallest hashes).
TRAIN_WINDOWS = 1500
#: Windows that are scored at once, about 25 kB each.
AT_ONCE = 512

# Possessive repeats and look-behinds change no match of the plain patterns; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.I)
_AT, _DOT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]", re.I), re.compile(r"\.|[(\[{]\s?dot\s?[)\]}]|\sdot\s", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def valid(kind: str, s: str) -> bool:
    """What a span of a kind must satisfy."""
    digits = _digits(s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return bool(_AT.search(s) and _DOT.search(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > end and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
                start -= 1
            if start < at:
                yield start, domain.end()
                end = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind as listed, then start; leftmost, non-overlapping within a kind, failing matches dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text within ``REACH`` characters of a digit, an ``@`` or a bracketed "at"."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


# Symbols of the tagger: a letter by its name (case aside), all digits as one, other ASCII characters as they are, the rest in two classes.
PAD, OTHER, LETTER = 0, 1, 2
_ASCII = np.array([3 if chr(i).isdigit() else 3 + ord(chr(i).lower()) for i in range(128)])
SYMBOLS = 3 + 128
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def coded(s: str) -> np.ndarray:
    points = np.frombuffer(s.encode("utf-32-le"), "<u4")
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], np.where(points < 0x250, LETTER, OTHER))


def tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, int)
    for kind, a, b in reversed(spans):  # of two kinds at one place the first listed stays
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def spans_of(path: np.ndarray) -> list[Span]:
    """Spans that a sequence of tags writes."""
    out: list[Span] = []
    for i in np.flatnonzero(path).tolist():
        t = int(path[i])
        kind = KINDS[(t - 1) // 2]
        if t % 2 == 0 and out and out[-1][0] == kind and out[-1][2] == i:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights: for either direction X (input by symbol), R (recurrent), B; then E, e (emissions) and C (transitions)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {"E": rng.normal(0, 0.2, (2 * h, TAGS)), "e": np.zeros(TAGS), "C": np.zeros((TAGS, TAGS))}
        for d in "<>":
            self.w |= {"X" + d: rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "R" + d: rng.normal(0, h**-0.5, (h, 4 * h)), "B" + d: np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        legal = np.ones((TAGS, TAGS), bool)
        for t in range(2, TAGS, 2):  # inside only after begin or inside of its kind
            legal[:, t] = False
            legal[[t - 1, t], t] = True
        self.illegal = np.where(legal, 0.0, -1e4)

    def _lstm(self, ids: np.ndarray, d: str) -> Iterator[tuple]:
        """States of one direction, step by step: (position, gates, cell before, cell, hidden before, hidden)."""
        h, c = np.zeros((len(ids), HIDDEN)), np.zeros((len(ids), HIDDEN))
        for t in range(ids.shape[1]) if d == ">" else range(ids.shape[1] - 1, -1, -1):
            z = self.w["X" + d][ids[:, t]] + h @ self.w["R" + d] + self.w["B" + d]
            z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            now = f * c + i * g
            new = o * np.tanh(now)
            yield t, z, c, now, h, new
            h, c = new, now

    def _hidden(self, states: dict[str, list[tuple]], shape: tuple) -> np.ndarray:
        both = np.empty((*shape, 2 * HIDDEN))
        for k, d in enumerate("<>"):
            for s in states[d]:
                both[:, s[0], k * HIDDEN : (k + 1) * HIDDEN] = s[5]
        return both

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(windows, positions, tags)"""
        both = np.empty((*ids.shape, 2 * HIDDEN))
        for k, d in enumerate("<>"):
            for s in self._lstm(ids, d):
                both[:, s[0], k * HIDDEN : (k + 1) * HIDDEN] = s[5]
        return both @ self.w["E"] + self.w["e"]

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tag sequences under the CRF, and its gradients."""
        n, steps = ids.shape
        states = {d: list(self._lstm(ids, d)) for d in "<>"}
        both = self._hidden(states, ids.shape)
        em, trans = both @ self.w["E"] + self.w["e"], self.w["C"] + self.illegal
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = em[:, t] + _lse(alpha[:, t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = em[rows, np.arange(steps), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - total[:, None, None])
        de[rows, np.arange(steps), y] -= 1
        de /= n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps):
            g["C"] += np.exp(alpha[:, t - 1][:, :, None] + trans + (em[:, t] + beta[:, t] - total[:, None])[:, None, :]).sum(0) / n
        np.add.at(g["C"], (y[:, :-1], y[:, 1:]), -1 / n)
        g["E"], g["e"] = np.einsum("nth,ntk->hk", both, de), de.sum((0, 1))
        back = de @ self.w["E"].T
        for k, d in enumerate("<>"):
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, z, before, now, h, _ in reversed(states[d]):
                i, f, o, c = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
                dh = dh + back[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                th = np.tanh(now)
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - c * c)], 1)
                np.add.at(g["X" + d], ids[:, t], dz)
                g["R" + d] += h.T @ dz
                g["B" + d] += dz.sum(0)
                dh, dc = dz @ self.w["R" + d].T, dc * f
        return float((total - gold).mean()), g

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """The best tags of one region."""
        trans = self.w["C"] + self.illegal
        best, came = em[0] + np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0), 0, -1e4), np.empty((len(em), TAGS), int)
        for t in range(1, len(em)):
            reach = best[:, None] + trans
            came[t] = reach.argmax(0)
            best = reach.max(0) + em[t]
        path = np.empty(len(em), int)
        path[-1] = best.argmax()
        for t in range(len(em) - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return path

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """For each text the tagger's spans that are valid and touch no base span."""
        places = [(k, a, b) for k, t in enumerate(texts) for a, b in regions(t)]
        out: list[list[Span]] = [[] for _ in texts]
        weigh = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
        for block in _blocks(places):
            codes = [coded(texts[k][a:b]) for k, a, b in block]
            cuts = [(r, s) for r, c in enumerate(codes) for s in range(0, max(1, len(c) - WINDOW // 2), WINDOW // 2)]
            sums = [np.zeros((len(c), TAGS + 1)) for c in codes]
            for first in range(0, len(cuts), AT_ONCE):
                some = cuts[first : first + AT_ONCE]
                ids = np.zeros((len(some), WINDOW), int)
                for row, (r, s) in zip(ids, some, strict=True):
                    piece = codes[r][s : s + WINDOW]
                    row[: len(piece)] = piece
                for e, (r, s) in zip(self.emissions(ids), some, strict=True):
                    n = min(WINDOW, len(codes[r]) - s)
                    sums[r][s : s + n] += np.c_[e, np.ones(WINDOW)][:n] * weigh[:n]
            for (k, a, _), x in zip(block, sums, strict=True):
                x = x[:, :-1] / x[:, -1:]
                if not (x.argmax(1) > 0).any():
                    continue
                for kind, s, e in spans_of(self.viterbi(x)):
                    s, e = s + a, e + a
                    if valid(kind, texts[k][s:e]) and all(e <= p or s >= q for _, p, q in bases[k]):
                        out[k].append((kind, s, e))
        return out


def _blocks(places: list[tuple[int, int, int]], most: int = 1 << 16) -> Iterator[list[tuple[int, int, int]]]:
    """Regions in blocks of some characters; a region longer than that is a block."""
    now, n = [], 0
    for p in places:
        if now and n + p[2] - p[1] > most:
            yield now
            now, n = [], 0
        now.append(p)
        n += p[2] - p[1]
    if now:
        yield now


def rewritten(window: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window with its spans in forms that the patterns miss."""
    out, new, at = [], [], 0
    pick = lambda *xs: xs[rng.integers(len(xs))]
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        s = window[a:b]
        if kind == "email":
            s = s.replace("@", pick(" (at) ", " [at] ", "(at)", "[at]", " @ ")).replace(".", pick(" (dot) ", " [dot] ", " dot ", "."))
        elif kind == "ip":
            s = s.replace(".", pick(" . ", " .", ". ", "[.]"))
        elif kind == "card":
            d, sep = _digits(s), pick(".", "/", "_", "  ")
            s = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            s = re.sub(r"^\+[0-9]{1,2}[\x20.-]?", pick("", "", "00"), s) if rng.random() < 0.7 else s.replace("-", pick("/", " / ", "_"))
        out += [window[at:a], s]
        start = sum(map(len, out)) - len(s)
        new.append((kind, start, start + len(s)))
        at = b
    return "".join([*out, window[at:]]), new


#: Labelled windows that are always there, so that there is a tagger for any table.
_SEEDS = ("write to jane.doe42@mail.example.com today", "from 192.168.10.25 at noon", "card 4111 1111 1111 1111 paid", "call +1 (202) 555-0143 now", "version 3.0 of 2024-01-05, price 19.99", "id 7f3a9c0e51b2 in section 12")


def train(windows: list[str]) -> Tagger:
    """A tagger from windows of documents (labelled by the patterns) and their rewritten forms; Adam, fixed seed."""
    rng = np.random.default_rng(3)
    rows = []
    for w in [*windows, *_SEEDS * 8]:
        spans = base_spans(w)
        rows.append((w, spans))
        if spans:
            rows.append(rewritten(w, spans, rng))
    shift = [int(rng.integers(0, max(1, len(w) - WINDOW + 1))) for w, _ in rows]
    x, y = np.zeros((len(rows), WINDOW), int), np.zeros((len(rows), WINDOW), int)
    for i, ((w, spans), s) in enumerate(zip(rows, shift, strict=True)):
        c = coded(w)[s : s + WINDOW]
        x[i, : len(c)] = c
        t = tags(len(w), spans)[s : s + WINDOW]
        if len(t) and t[0] and t[0] % 2 == 0:
            t[0] -= 1  # a span that the window cuts begins at its edge
        y[i, : len(t)] = t
    tagger = Tagger()
    first, second = ({k: np.zeros_like(v) for k, v in tagger.w.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), BATCH):
            step += 1
            _, grads = tagger.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                tagger.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tagger


def sample_windows(docs: DataFrame, most: int = TRAIN_WINDOWS) -> list[str]:
    """At most ``most`` windows around digits and ``@`` of all whole texts: those with the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text"):
            found = {t[a : a + 3 * REACH] for t in b.column(0).to_pylist() if t for r in regions(t) for a in range(r[0], r[1], 3 * REACH)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    found = common.stored(docs.select("text").mapInArrow(run, "w string").where(F.length("w") > 8), "windows")
    return [r["w"] for r in sample.lowest(found, F.pmod(F.xxhash64("w"), F.lit(1 << 30)), most, found.count()).collect()]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of each whole text, as kind:start:end joined by commas.

    Kinds as listed, then start; code points, end exclusive. A null text is an empty one.
    """

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in b.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = tagger.added(texts, bases)
            everything = [sorted([*x, *y], key=lambda s: (KINDS.index(s[0]), s[1])) for x, y in zip(bases, more, strict=True)]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(written, bases), pa.string()), pa.array(map(written, everything), pa.string())], ["doc_id", "base", "spans"])

        return one

    return common.map_batches(docs.select("doc_id", "text"), "text", make, "doc_id bigint, base string, spans string", 4 << 20)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals and brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` with the personal data of ``text`` masked and ``n_chars`` counted anew where it changed; other columns and null texts as they are."""
    columns = docs.columns

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            bases = [base_spans(t or "") for t in texts]
            more = tagger.added([t or "" for t in texts], bases)
            new = [t if t is None else masked(t, [*x, *y]) for t, x, y in zip(texts, bases, more, strict=True)]
            arrays = {c: b.column(c) for c in columns} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                arrays["n_chars"] = pa.array([n if s is None or s == t else len(s) for n, s, t in zip(b.column("n_chars").to_pylist(), new, texts, strict=True)], pa.int64())
            return pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns)

        return one

    return common.map_batches(docs, "text", make, docs.schema, 4 << 20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans of each kind (numbers and digest) and all spans."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = find(docs, train(sample_windows(docs)))
    count = lambda kind: (F.size(F.split("base", f"(^|,){kind}:")) - 1).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
