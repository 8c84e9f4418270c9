"""Cutting texts into stretches that byte-level BPE encodes independently, and encoding each distinct one once.

The pre-token pattern never joins characters across a single space that has a
non-space character on both sides, except that the space opens the pre-token on
its right. So a text may be cut before each such space, each stretch encoded on
its own, and the encoding of a stretch remembered. The cutting, the distinct
stretches of a batch and the gathering of ids are Arrow and numpy operations over
a whole batch; Python sees each distinct stretch of a batch once.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Below this, letters are the same under all versions of Unicode.
_KNOWN_LETTERS = "ɐ"
_MARKS = ".,;:!?"
#: Bytes beside text and ids that a remembered stretch takes (measured: two objects and a table entry).
ENTRY_BYTES = 190


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def mapped(s: str, table: dict[int, str] = dict(enumerate(byte_characters()))) -> str:  # noqa: B006
    """A text with each byte of its UTF-8 form as its printable character."""
    if s.isascii() and s.isprintable():
        return s.replace(" ", table[32])
    return s.encode().decode("latin-1").translate(table)


def runs(values: list[bytes]) -> pa.Array:
    """Byte strings as a table to ``gather`` from."""
    return pa.array(values, pa.large_binary())


def as_runs(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of ``flat`` that end at ``ends`` as such a table, without a copy."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def gather(table: pa.Array, which: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings at ``which`` end to end, seen as numbers, and where each ends."""
    kind = np.dtype(dtype)
    if not len(which):
        return np.empty(0, kind), np.empty(0, np.int64)
    got = table.take(pa.array(which, pa.int64()))
    ends = np.frombuffer(got.buffers()[1], np.int64)[1 : len(got) + 1] // kind.itemsize
    return np.frombuffer(got.buffers()[2], kind, int(ends[-1])) if ends[-1] else np.empty(0, kind), ends


def binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``flat`` that end at ``ends`` as an Arrow array of byte strings for Spark."""
    return as_runs(flat, ends).cast(pa.binary())


def cut(texts: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(words, specials, which, last): the stretches of a batch of texts, each distinct one once.

    ``words`` stand for stretches of a blank and a word; ``specials`` are stretches as they are, which open
    a text or hold runs of white space. ``which``: for each stretch in order its place among words and specials;
    ``last``: the last stretch of each text. A null text is an empty one; each text has a stretch.
    """
    if not len(texts):
        return [], [], np.empty(0, np.int64), np.empty(0, np.int64)
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    first = np.asarray(split.offsets)[:-1].astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    # a blank beside white space, or at an end of the text, is no place to cut
    size = np.asarray(pc.binary_length(coded.dictionary))
    odd_left = (np.asarray(pc.binary_length(pc.utf8_ltrim_whitespace(coded.dictionary))) != size) | (size == 0)
    odd_right = (np.asarray(pc.binary_length(pc.utf8_rtrim_whitespace(coded.dictionary))) != size) | (size == 0)
    glued = np.zeros(len(codes), bool)
    glued[1:] = odd_left[codes[1:]] | odd_right[codes[:-1]]
    glued[first] = False
    opens = np.zeros(len(codes), bool)
    opens[first] = True
    starts = np.flatnonzero(~glued)
    ends = np.append(starts[1:], len(codes))
    which = codes[starts].astype(np.int64)
    seen: dict[str, int] = {}
    for k in np.flatnonzero(opens[starts] | (ends - starts > 1)).tolist():
        a, b = int(starts[k]), int(ends[k])
        s = " ".join([words[c] for c in codes[a:b].tolist()])
        which[k] = len(words) + seen.setdefault(s if opens[a] else " " + s, len(seen))
    return words, list(seen), which, np.append(np.searchsorted(starts, first[1:], "left"), len(starts)) - 1


class Encoder:
    """Whole texts to unsigned 32-bit ids through a memory of encoded stretches that is bounded in bytes."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]], most_bytes: int = 160 << 20, longest: int = 48):
        """``encode``: pre-tokens, byte by byte as printable characters (``mapped``), to ids; ``most_bytes``: what the memory may take before it is emptied;
        ``longest``: stretches of more characters are encoded but not remembered."""
        import regex

        self.cut, self.encode, self.most, self.longest = regex.compile(pattern), encode, most_bytes, longest
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.marks: dict[str, bytes] = {}
        # whether a line feed between two characters that are no white space is a pre-token of its own
        self.line_feeds = self.cut.findall(" a.\nB\n!") == [" a", ".", "\n", "B", "\n", "!"]

    def lines(self, w: str) -> list[str]:
        """A word as its first line and, each with the line feed before it, its other lines; nothing where lines cannot be cut."""
        parts = w.split("\n")
        if self.line_feeds and len(parts) > 1 and all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            return [parts[0], *("\n" + p for p in parts[1:])]
        return []

    def pre_tokens(self, s: str) -> list[str]:
        """Matches of the pattern; a blank and letters are seen without it."""
        if s[:1] == " " and s[1:].isalpha() and (s.isascii() or max(s) < _KNOWN_LETTERS):
            return [s]
        return self.cut.findall(s)

    def stretches(self, some: list[str]) -> list[bytes]:
        """The packed ids of each stretch, each distinct pre-token encoded once."""
        out = []
        for i in range(0, len(some), 4096):
            pre = list(map(self.pre_tokens, some[i : i + 4096]))
            each = list({t for ts in pre for t in ts})
            ids = dict(zip(each, self.packed(list(map(mapped, each))), strict=True))
            out += [ids[ts[0]] if len(ts) == 1 else b"".join([ids[t] for t in ts]) for ts in pre]
        return out

    def packed(self, some: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.encode(some)]

    def blank_led(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word with a blank before it."""
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        if not self.marks:
            self.marks = dict(zip(_MARKS, self.stretches(list(_MARKS)), strict=True))
        known, letters, others, marked, broken = self.known, {}, [], [], []
        got = list(map(known.get, words))
        for i, g in enumerate(got):
            if g is not None:
                continue
            w = words[i]
            if w.isalpha() and w.isascii():
                letters[w] = i
            # letters and one mark are two pre-tokens, so only the letters are remembered
            elif w and w[-1] in self.marks and (b := w[:-1]).isalpha() and (b.isascii() or max(b) < _KNOWN_LETTERS):
                marked.append((i, b))
                if b not in known:
                    if b.isascii():
                        letters.setdefault(b, -1)
                    else:
                        others.append((-1, b))
            elif "\n" in w and (parts := self.lines(w)):
                broken.append((i, parts))
            else:
                others.append((i, w))
        # lines recur more than what stands around a line feed
        firsts = list({parts[0] for _, parts in broken})
        lines = list({p for _, parts in broken for p in parts[1:]})
        fresh_lines = [p for p in lines if p not in known]
        of_line = dict(zip(fresh_lines, self.stretches(fresh_lines), strict=True))
        of_line.update((p, known[p]) for p in lines if p in known)
        of_first = dict(zip(firsts, self.blank_led(firsts) if firsts else [], strict=True))
        for i, parts in broken:
            got[i] = of_first[parts[0]] + b"".join([of_line[p] for p in parts[1:]])
        # ASCII letters with a blank before them are one pre-token
        blank = mapped(" ")
        fresh = [*letters, *(w for _, w in others)]
        done = self.packed([blank + w for w in letters]) + self.stretches([" " + w for _, w in others])
        for i, ids in zip([*letters.values(), *(i for i, _ in others)], done, strict=True):
            if i >= 0:
                got[i] = ids
        new = dict(zip(fresh, done, strict=True))
        for i, b in marked:
            got[i] = (known.get(b) or new[b]) + self.marks[words[i][-1]]
        # a line is remembered with its line feed, which no word after a blank begins with
        new.update((p, of_line[p]) for p in fresh_lines)
        size = 0
        for w, ids in new.items():
            if len(w) <= self.longest:
                known[w] = ids
                size += len(w) + len(ids) + ENTRY_BYTES
        self.held += size
        return got

    def special(self, some: list[str]) -> list[bytes]:
        """The packed ids of stretches that open a text or hold runs of white space."""
        led = [i for i, s in enumerate(some) if s[:1] == " " and s[1:2] and " " not in s[1:] and not s[1].isspace() and not s[-1].isspace()]
        out = [b""] * len(some)
        for i, ids in zip(led, self.blank_led([some[i][1:] for i in led]), strict=True):
            out[i] = ids
        rest = sorted({*range(len(some))} - {*led})
        for i, ids in zip(rest, self.stretches([some[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end; a null text is an empty one.

        The cyclic collector rests meanwhile: nothing here is a cycle, and it would walk all new lists again and again.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            words, specials, which, last = cut(texts)
            ids, ends = gather(runs(self.blank_led(words) + self.special(specials)), which, "<u4")
        finally:
            if collects:
                gc.enable()
        return ids, ends[last] if len(last) else ends

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.batch(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
