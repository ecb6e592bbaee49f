"""Token counts at every prefix, by dynamic programming over byte-pair merges.

A byte-pair encoding is settled by its neighbours: a sequence of tokens is the encoding of its bytes just when each
adjacent pair is the encoding of the pair's own bytes. So the last token of a prefix is the one that ends there and forms
such a pair with the last token of the prefix before it, and the prefix's count is one more than that one's. One
pass over a piece, with an automaton that names the tokens ending at each byte, thus counts every prefix of it. The counts of a text are stored as differences, one byte to each byte of the text, and
answer how many tokens a prefix has, or how much of a text fits a budget, without encoding anything again.

Counts are exact for prefixes that end at a character; inside a character they are those of the bytes so far.

Defined results: null text counts as empty, with no tokens; equal texts get equal counts; an empty table gives an empty
result; other columns are not used.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import PIECE, UNUSUAL, Table, slices
from .tokens import byte_letters, vocabulary_path

LIMIT = 1024
#: Words kept by a worker, in each of two generations, and pairs of tokens of which it is known whether they fit.
WORDS, FITS = 300_000, 300_000


class Merges:
    """What the vocabulary file says: tokens' bytes, the merges that form them and their ranks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw = {chr(letter): byte for byte, letter in byte_letters().items()}
        of = lambda token: bytes(raw[c] for c in token)
        names = {of(t): i for t, i in spec["model"]["vocab"].items() if all(c in raw for c in t)}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (of(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[names[a] << 24 | names[b]] = rank
            self.parts[names[a + b]] = (rank, names[a], names[b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = ahocorasick.Automaton()
        for token, i in names.items():
            self.tokens.add_word(token.decode("latin-1"), (i, len(token)))
        self.tokens.make_automaton()
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at an end of token while it is being merged, with the rank at which each is absorbed."""
        key = (token, side)
        if key not in self.edges:
            out, x = [(token, float("inf"))], token
            while x in self.parts:
                rank, *two = self.parts[x]
                x = two[side]
                out.append((x, rank))
            self.edges[key] = out
        return self.edges[key]

    def pair(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their bytes: no merge across their border comes before those that form them."""
        found, rank, right = True, self.rank, self.edge(b, 0)
        for x, until_x in self.edge(a, 1):
            for y, until_y in right:
                r = rank.get(x << 24 | y)
                # of equal merges the left one goes first: inside a before the border, at the border before those inside b
                if r is not None and r < until_x and r <= until_y:
                    found = False
        if len(self.fits) >= FITS:
            self.fits.clear()
        self.fits[a << 24 | b] = found
        return found

    def counts(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """For each piece the number of tokens of each prefix, from none on; the list is good until the next one is taken.

        The automaton names the tokens that end at each byte, the longest first. Of pieces in ascending order, what a piece
        has in common with the one before it isn't counted again.
        """
        before, last, count, fits, pair, tokens = b"", [0], [0], self.fits, self.pair, self.tokens.iter
        for piece in pieces:
            n, done = len(piece), 0
            while done < n and done < len(before) and piece[done] == before[done]:
                done += 1
            before = piece
            if len(last) <= n:
                last += [0] * (n + 1 - len(last))
                count += [0] * (n + 1 - len(count))
            for at, (token, size) in tokens(piece.decode("latin-1")):
                if at >= done:
                    start = at + 1 - size
                    if start:
                        ok = fits.get(last[start] << 24 | token)
                        if ok is None:
                            ok = pair(last[start], token)
                        if not ok:
                            continue
                    done = at + 1
                    last[done], count[done] = token, count[start] + 1
            yield count[: n + 1]


class Prefixes(Table):
    """Differences of the counts at successive bytes of a text, as signed bytes."""

    kind = np.dtype("i1")

    def __init__(self, path: str, most: int = WORDS) -> None:
        import public_tokenizers

        self.merges = Merges(path)
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        super().__init__(self.merges.special, most)

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [x.encode() for x in pieces]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out = [b""] * len(raw)
        for i, count in zip(order, self.merges.counts(map(raw.__getitem__, order)), strict=True):
            if pieces[i] in ("'re", "'ve", "'ll"):  # before its last letter it is two pieces
                count[2] = 2
            out[i] = array("b", map(sub, count[1:], count)).tobytes()
        return out

    def of_lines(self, text: str) -> bytes:
        return self.plain(text)

    def of_texts(self, texts: list[str]) -> list[bytes]:
        return list(map(self.whole, texts))

    def plain(self, text: str) -> bytes:
        pieces = PIECE.findall(text) if not UNUSUAL.search(text) else self.cut(text)
        own = dict(zip(distinct := list(dict.fromkeys(pieces)), self.pieces.get(distinct, self.of_pieces), strict=True))
        steps = b"".join(map(own.__getitem__, pieces))
        blank = {x for x in distinct if x.isspace()}
        runs = [i for i, x in enumerate(pieces[:-1]) if x in blank and pieces[i + 1][0].isspace()] if blank else []
        if not runs:
            return steps
        # where the last of a run of blanks begins the next piece, a prefix that ends with it still has the run as one piece
        counts = np.concatenate(([0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)))
        starts = np.concatenate(([0], np.cumsum([len(own[x]) for x in pieces])))
        befores = counts[starts[runs]].tolist()
        for i, before in zip(runs, befores, strict=True):
            run, at = pieces[i] + pieces[i + 1][0], int(starts[i + 1])
            first = len(pieces[i + 1][0].encode())
            counts[at + 1 : at + 1 + first] = np.frombuffer(self.pieces.get([run], self.of_pieces)[0], np.int8).cumsum(dtype=np.int64)[-first:] + before
        return np.diff(counts).astype(np.int8).tobytes()

    def whole(self, text: str) -> bytes:
        """Special strings are one token once complete, and plain text until then."""
        out: list[bytes] = []
        while at := [(text.find(s), s) for s in self.special if s in text]:
            start, special = min(at)
            before, partly = text[:start], self.plain(text[: start + len(special) - 1])
            now, upto = (int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in (partly, self.plain(before)))
            # the step of the special string's last byte leads from the plain count to one more than the count before it
            out += [partly, np.array([upto + 1 - now], np.int8).tobytes()]
            text = text[start + len(special) :]
        return b"".join([*out, self.plain(text)]) if text else b"".join(out)


def count_at(steps: bytes, n_bytes: int) -> int:
    """The tokens of the first n_bytes of the text behind steps."""
    return int(np.frombuffer(steps, np.int8, n_bytes).sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """The most bytes that a prefix of at most budget tokens has. It may end inside a character of more bytes than one."""
    if len(steps) == 0:
        return 0
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_known: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    if path not in _known:
        _known[path] = Prefixes(path)
    return _known[path]


def _counted(path: str, keep: bool):
    def run(batches):
        of = prefixes(path).of
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                steps, n_bytes = of(texts)
                ends = np.cumsum(n_bytes)
                upto = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
                n_tokens = upto[ends] - upto[ends - n_bytes]
                cut = n_bytes.copy()
                for i in np.flatnonzero(n_tokens > LIMIT).tolist():
                    cut[i] = longest_within(steps[ends[i] - n_bytes[i] : ends[i]].tobytes(), LIMIT)
                columns = [batch.column("doc_id").slice(start, len(texts)), *map(pa.array, (n_bytes, n_tokens, cut))]
                kept = [pa.array([steps[b - n : b].tobytes() for b, n in zip(ends.tolist(), n_bytes.tolist(), strict=True)], pa.binary())] if keep else []
                yield pa.RecordBatch.from_arrays(columns + kept, ["doc_id", "n_bytes", "n_tokens", "limit_bytes"] + ["steps"] * keep)

    return run


def token_counts(docs: DataFrame, path: str, keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, limit_bytes (the longest prefix of at most LIMIT tokens) and steps, the counts at all prefixes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(path, keep_steps), f"doc_id {kind}, n_bytes long, n_tokens long, limit_bytes long" + ", steps binary" * keep_steps)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), keep_steps=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "limit_bytes")
