"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary made from text covers words with few tokens and random strings with many, so a long run of letters
and digits that comes to few characters a token is random. What is random but known to be harmless is left out first:
digests by their lengths, UUIDs, plain numbers, and identifiers, which fall apart into words at their humps and dashes.
Where a run as a whole passes, as a key behind a path does, each stretch of its tokens is tested in the same way.

Defined results: null text counts as empty and has no spans; spans count code points, end exclusive; equal texts have
equal spans; an empty table gives an empty result; other columns are carried along by redact() and left out by the query.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, table

KINDS = ("assign", "access", "hex", "dense")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Any of these must be there for ASSIGN to match.
KEYS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}  # of the common digests, in hex
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ATOM = re.compile(r"[A-Za-z0-9]+")
#: Characters a token: below the first a run is random, below the second one of single-case words.
RATIO, LETTERS_RATIO = 2.0, 1.5
#: A stretch of one case beyond this length is no word by its looks alone.
LONGEST_WORD = 16
#: Characters of the stretches tested inside a run, and how many there are to a joint (/ = + _ -) at least: dates and versions have more joints.
STRETCH, JOINT = 20, 8


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and identifiers: random-looking at times, but no secret."""
    bare = run.strip("=-_/+")
    if bare.replace("-", "").replace("_", "").replace("/", "").isdigit() or UUID.fullmatch(bare):
        return True
    if DIGEST.fullmatch(bare) and len(bare) in DIGEST_CHARS:
        return True
    parts = PART.findall(bare)
    letters = [p for p in parts if not p.isdigit()]
    if any(len(p) > LONGEST_WORD for p in letters):
        return False
    # an identifier's words are longer than the stretches of one case in random letters, and its numbers are few
    return bool(letters) and sum(map(len, letters)) >= 4 * len(letters) and len(parts) - len(letters) <= len(letters) // 2


@cache
def ranks(path: str):
    """The tiktoken vocabulary at path; one to a Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        pairs = [line.split() for line in f]
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def ratio(run: str) -> float:
    """The characters a token that run has to reach."""
    mixed = any(c.isdigit() for c in run) or not (run.islower() or run.isupper())
    return RATIO if mixed or any(len(x) > LONGEST_WORD for x in ATOM.findall(run)) else LETTERS_RATIO


def random_run(run: str, vocabulary) -> bool:
    return not known(run) and len(run) < ratio(run) * len(vocabulary.encode_ordinary(run))


def harmless_parts(run: str) -> list[tuple[int, int]]:
    """UUIDs and digests that joints set off within a run."""
    digests = [m.span() for m in ATOM.finditer(run) if len(m[0]) in DIGEST_CHARS and DIGEST.fullmatch(m[0])]
    return [m.span() for m in UUID.finditer(run)] + digests


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans in order, none of which meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_parts(run: str, taken: list[tuple[int, int]], vocabulary) -> list[tuple[int, int]]:
    """Where stretches of tokens in a run are random, clear of what is taken; widened to the joints around them.

    Stretches, taken places and atoms are all in order, so each is gone through once.
    """
    taken = united(taken + harmless_parts(run))
    edges = [0]
    for t in vocabulary.encode_ordinary(run):
        edges.append(edges[-1] + len(vocabulary.decode_single_token_bytes(t)))
    found, j, k = [], 0, 0
    for i, a in enumerate(edges):
        while j < len(edges) and edges[j] < a + STRETCH:
            j += 1
        if j == len(edges):
            break
        b = edges[j]
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        part = run[a:b]
        if b - a >= ratio(part) * (j - i) or JOINT * sum(not c.isalnum() for c in part) > b - a:
            continue
        if known(part):
            continue
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    out: list[tuple[int, int]] = []
    atoms = [m.span() for m in ATOM.finditer(run)] if found else []
    starts, ends = [x for x, _ in atoms], [y for _, y in atoms]
    for a, b in found:
        whole = atoms[bisect_right(ends, a) : bisect_left(starts, b)]
        # a word at the edge of a stretch is no part of the string
        while len(whole) > 1 and known(run[slice(*whole[0])]):
            whole = whole[1:]
        while len(whole) > 1 and known(run[slice(*whole[-1])]):
            whole = whole[:-1]
        a, b = whole[0][0], whole[-1][1]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(text: str | None, vocabulary) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each span, in order."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= 24]
    base, k = united([(a, b) for a, _, b in out]), 0
    for at, run in runs:
        while k < len(base) and base[k][1] <= at:
            k += 1
        last = k
        while last < len(base) and base[last][0] < at + len(run):
            last += 1
        taken = [(a - at, b - at) for a, b in base[k:last]]
        if not taken and not harmless_parts(run) and random_run(run, vocabulary):
            out.append((at, 3, at + len(run)))
        else:
            out += [(at + a, 3, at + b) for a, b in random_parts(run, taken, vocabulary)]
    return sorted(out)


def _scanned(path: str, redacted: bool, text_column: str, out: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        vocabulary = ranks(path)
        for batch in batches:
            spans, texts = [], []
            for x in batch.column(text_column):
                spans.append(found := scan_text(text := x.as_py(), vocabulary))
                texts.append(blank(text, found) if redacted else None)
            names = [n for n in batch.schema.names if n != text_column]
            column = pa.array(texts, pa.string()) if redacted else pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [column], [*names, out])

    return run


def blank(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return text if not spans else "".join(out) + text[at:]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def scan(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned(path, False, "text", "spans"), f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, path: str) -> DataFrame:
    """docs, all columns and rows, with secrets in their texts replaced by a mark, and n_chars made to fit where it is there."""
    found = fresh(docs, "_found")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    out = docs.mapInArrow(_scanned(path, True, "text", found), StructType([*rest, StructField(found, StringType())]))
    out = out.withColumnRenamed(found, "text").select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), vocabulary_path())
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "dense")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
