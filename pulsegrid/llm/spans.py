"""Texts cut into spans at their blanks, in bulk, so that what a word comes to is worked out once and looked up from then on.

A byte-level BPE first cuts text into pieces by a fixed pattern. A single blank between other characters always begins a
piece, as do two line feeds, so what stands from one to the next, a span, can be treated by itself, whatever is around it.
Arrow cuts a slice of texts, finds its distinct spans and takes stops off their ends; numpy puts the bytes of all texts together from
those of the distinct words. Only words not seen lately reach Python code and the library. Texts with longer blanks,
characters outside the plain set below or special strings are treated one by one.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters, digits and blanks for which the pattern below cuts as the library's own does, whatever the Unicode version.
_PLAIN = r"\n -~À-ÖØ-öø-ÿ"
UNUSUAL = re.compile(f"[^{_PLAIN}]")
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+")
#: What may stand after a letter or digit at the end of a span and is a piece of its own there.
STOPS = ".,;:!?"

#: Marks before the first span of a text and before one that follows two line feeds, at a text's end, and for a text that can't be cut.
FIRST, TWO_LINES, END, WHOLE = "\x01", "\x02", "\x03", "\x04"

#: Longer words and pieces are worked out each time.
LONG = 48


def slices(texts: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(start, part) of a column of texts with about so many bytes each, one text at least; null becomes empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, pc.fill_null(texts.slice(at, stop - at).cast(pa.string()), "")
        at = stop


class Kept:
    """key -> bytes for the keys asked for lately: two generations of at most so many short keys."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def get(self, keys: list[str], make) -> list[bytes]:
        """What is kept for distinct keys; make(keys) gives it for those not kept."""
        out = list(map(self.now.get, keys))
        late = [i for i, x in enumerate(out) if x is None]
        if late:
            if len(self.now) >= self.most:
                self.now, self.before = {}, self.now
            before = self.before
            for i in late:
                out[i] = before.get(keys[i])
            new = [i for i in late if out[i] is None]
            for i, x in zip(new, make([keys[i] for i in new]) if new else (), strict=True):
                out[i] = x
            self.now.update({keys[i]: out[i] for i in late if len(keys[i]) <= LONG and keys[i][:1] != WHOLE})
        return out


def together(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of pool one after the other. A slice's items stay far below 2 ** 31, so that 32 bits do."""
    kind = np.int32 if max(len(pool), int(sizes.sum())) < 1 << 31 else np.int64
    ends = np.cumsum(sizes, dtype=kind)
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


class Table:
    """The items (of ``kind``) that texts come to. What pieces, whole texts and the ends of texts come to is the subclass's."""

    kind, end = np.dtype("u1"), b""

    def __init__(self, special: list[str], most: int) -> None:
        self.special, self.words, self.pieces = special, Kept(most), Kept(most // 4)

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """For texts that can't be cut into spans, without their ends."""
        raise NotImplementedError

    def of_lines(self, text: str) -> bytes:
        """For plain text that begins with two line feeds."""
        return self.of_plain(text)

    def of_plain(self, text: str) -> bytes:
        """For a stretch of plain text that begins and ends where a piece does."""
        pieces = PIECE.findall(text)
        own = dict(zip(distinct := list(set(pieces)), self.pieces.get(distinct, self.of_pieces), strict=True))
        return b"".join(map(own.__getitem__, pieces))

    def of_words(self, words: list[str], texts: dict[str, bytes]) -> list[bytes]:
        """For distinct words: spans without the stops at their ends; ``texts`` has those that stand for whole texts."""
        out: list[bytes | None] = [None] * len(words)
        single, at, several = [], [], []
        for i, word in enumerate(words):
            mark = word[:1]
            if mark in (TWO_LINES, END, WHOLE):
                out[i] = self.of_lines("\n\n" + word[1:]) if mark == TWO_LINES else self.end if mark == END else texts[word]
                continue
            text = word[1:] if mark == FIRST else word if mark == "\n" else " " + word
            pieces = PIECE.findall(text)
            if len(pieces) == 1:
                single.append(text)
                at.append(i)
            else:
                several.append((i, pieces))
        for i, x in zip(at, self.of_pieces(single), strict=True):
            out[i] = x
        distinct = list({p for _, pieces in several for p in pieces})
        own = dict(zip(distinct, self.pieces.get(distinct, self.of_pieces), strict=True))
        for i, pieces in several:
            out[i] = b"".join(map(own.__getitem__, pieces))
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The items of all texts of a slice, each followed by the end's, and how many each has."""
        running = gc.isenabled()
        gc.disable()  # none of the many small objects below is part of a cycle
        try:
            return self._of(texts)
        finally:
            pa.default_memory_pool().release_unused()
            if running:
                gc.enable()

    def _of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, f"[^{_PLAIN}]|  | \\n|\\n |\\n\\n\\n")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lines = pc.replace_substring(pc.replace_substring(texts, "\n\n", " " + TWO_LINES), "\n", " \n")
        lines = pc.binary_join_element_wise(FIRST, lines, " " + END, "")
        if len(whole):
            lines = pc.if_else(odd, pc.binary_join_element_wise(WHOLE, pa.array(np.arange(len(texts))).cast(pa.string()), " " + END, ""), lines)
        cut = pc.split_pattern(lines, " ")
        spans = cut.values.dictionary_encode()
        pool, starts, sizes = self._distinct(spans.dictionary, dict(zip((f"{WHOLE}{i}" for i in whole), self.of_texts(texts.take(pa.array(whole)).to_pylist()) if len(whole) else (), strict=True)))
        at = spans.indices.to_numpy()
        own = sizes[at]
        ends = np.concatenate(([0], np.cumsum(own, dtype=np.int64)))
        return together(pool, starts[at], own), np.diff(ends[cut.offsets.to_numpy()])

    def _distinct(self, spans: pa.Array, texts: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items of distinct spans: a pool of them, and where each span's begin and how many they are."""
        bare = pc.ascii_rtrim(spans, STOPS)
        stops = pc.binary_length(spans).to_numpy() - pc.binary_length(bare).to_numpy()
        stops[(stops > 3) | ~pc.match_substring_regex(bare, f"[0-9{_LETTERS}]$").to_numpy(zero_copy_only=False)] = 0
        words = pc.if_else(pa.array(stops > 0), bare, spans).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.words.get(names, lambda new: self.of_words(new, texts))
        # stops come after the words; the first of them stands for none
        tail = np.full(len(spans), len(names))
        found.append(b"")
        for n in range(1, 4):
            rows = np.flatnonzero(stops == n)
            own = pc.utf8_slice_codeunits(spans.take(pa.array(rows)), -n).dictionary_encode()
            tail[rows] = len(found) + own.indices.to_numpy()
            marks = own.dictionary.to_pylist()
            found += self.pieces.get(marks, self.of_pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        both = np.stack((words.indices.to_numpy(), tail), axis=1).ravel()
        total = sizes[both].reshape(-1, 2).sum(axis=1)
        return together(np.frombuffer(b"".join(found), self.kind), starts[both], sizes[both]), np.cumsum(total) - total, total
