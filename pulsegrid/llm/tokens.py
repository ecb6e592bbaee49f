"""Token ids of whole texts, as the tokenizers library gives them, at the speed of a table look-up.

The library's own model merges the bytes of each distinct piece; from then on the word it stands in is looked up in a
table of bounded size, see spans. Texts with any character outside the plain set there, or with the vocabulary's special strings,
are encoded whole by the library. Ids are held in 16 bits where the vocabulary allows.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table
from .spans import UNUSUAL, Table, slices

VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[int, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 stays, other bytes follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + hidden.index(b) if b in hidden else b for b in range(256)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words kept by an encoder, in each of two generations.
WORDS = 300_000


class Encoder(Table):
    """Ids of many texts, id 0 after each; one to a Python worker, see encoder()."""

    def __init__(self, path: str, most: int = WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cutter = self.tokenizer.pre_tokenizer
        self.letters = {byte: letter for byte, letter in byte_letters().items() if byte}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = bytes(self.kind.itemsize)
        super().__init__([t.content for t in self.tokenizer.get_added_tokens_decoder().values()], most)

    def packed(self, cutter, texts: list[str], most: int = 4096) -> list[bytes]:
        """The library's ids of texts that cutter cuts; so many to a call, as its own form of ids takes much memory."""
        kind, out, self.tokenizer.pre_tokenizer = "H" if self.kind.itemsize == 2 else "I", [], cutter
        for at in range(0, len(texts), most):
            out += [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[at : at + most], add_special_tokens=False)]
        return out

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        # one translation for all of them: NUL is in no piece
        letters = "\0".join(pieces).encode().decode("latin-1").translate(self.letters)
        return self.packed(None, letters.split("\0")) if pieces else []

    def of_texts(self, texts: list[str]) -> list[bytes]:
        blanks = [i for i, x in enumerate(texts) if not UNUSUAL.search(x) and not any(s in x for s in self.special)]
        plain = dict(zip(blanks, map(self.of_plain, (texts[i] for i in blanks)), strict=True))
        rest = iter(self.packed(self.cutter, [x for i, x in enumerate(texts) if i not in plain], 1))
        return [plain[i] if i in plain else next(rest) for i in range(len(texts))]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = WORDS) -> Encoder:
    if (path, most) not in _encoders:
        _encoders.clear()  # one to a worker
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


# --- Token-ID output -------------------------------------------------------------------------------------------------

#: The file format: small row groups and pages with page indexes, so that a reader that wants some documents' tokens,
#: or metadata only, fetches little else. Ids are dictionary-coded (at most 16 bits each, before compression); the second
#: format version codes the ascending metadata columns by their deltas where a dictionary doesn't pay.
FORMAT = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#part_start": "false",
}


def bounds(docs: DataFrame, n: int) -> list:
    """Greatest doc_ids, null first, of all but the last of n files of like many rows; a doc_id that fills several is there as often.

    Found in a scan of doc_id alone; at most n - 1 values come to the driver, as in any range partitioning.
    """
    ranged = docs.select("doc_id", F.rand(1).alias("at")).repartitionByRange(n, "doc_id", "at").select("doc_id", F.spark_partition_id().alias("file"))
    ends = [r["end"] for r in ranged.groupBy("file").agg(F.max("doc_id").alias("end")).collect()]
    return sorted(ends, key=lambda x: (x is not None, x))[:-1]


def _encoded(path: str, ends: list):
    blank = ends.count(None)
    known = ends[blank:]

    def place(doc, tie):
        """The file of a document; the rows of a doc_id that fills several go there in the order of their ties."""
        low, high = (0, blank) if doc is None else (blank + bisect_left(known, doc), blank + bisect_right(known, doc))
        return low + ((tie + (1 << 63)) * (high - low + 1) >> 64)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                flat, n = enc.of(texts)
                ends = np.concatenate(([0], np.cumsum(n) * enc.kind.itemsize)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, enc.kind))])
                own = batch.slice(start, len(texts))
                files = pa.array(map(place, own.column("doc_id").to_pylist(), own.column("tie").to_pylist()), pa.int32())
                width = pa.array(np.full(len(n), enc.kind.itemsize, np.int8))
                yield pa.RecordBatch.from_arrays([files, own.column("doc_id"), own.column("tie"), width, ids], ["file", "doc_id", "tie", "width", "packed"])

    return run


#: Ids in a batch that goes back to Spark, unless one document has more.
BATCH_IDS = 1 << 20


def _placed(batches):
    """Number the ids of a file, and unpack them to lists."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        packed, width = batch.column("packed").cast(pa.binary()), batch.column("width")[0].as_py()
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // width
        flat, low = np.frombuffer(packed.buffers()[2], f"<u{width}", ends[-1]), 0
        while low < len(packed):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + BATCH_IDS, "right")) - 1)
            own = ends[low : high + 1] - ends[low]
            ids = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(flat[ends[low] : ends[high]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), pa.array(np.full(high - low, part, np.int32)), pa.array(at + own[:-1]), pa.array(np.diff(own)), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"]
            )
            at, low = at + int(own[-1]), high


def write_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Write doc_id and all token ids of docs (doc_id, text) to a table in ascending doc_id order; gives the table.

    Columns: doc_id; part, which numbers the files in order; part_start, the ids before the document in its file;
    n_tokens; ids (list of int). A document's place among all ids is its file's start, see starts(), plus part_start.
    Each text ends with id 0. Null text counts as empty; a null doc_id comes first; equal doc_ids stand together, in the
    order of a hash of their texts; an empty table gives an empty one; other columns of docs are left out.

    Texts are encoded where they are read: what is shuffled and sorted is their packed ids, and the order's bounds come from
    doc_id alone, so no text is read twice. There are as many files as the session has shuffle partitions.
    """
    kind, n = docs.schema["doc_id"].dataType.simpleString(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    packed = texts.mapInArrow(_encoded(path, bounds(docs, n)), f"file int, doc_id {kind}, tie long, width byte, packed binary")
    rows = packed.repartitionById(n, "file").drop("file").sortWithinPartitions("doc_id", "tie")
    return stash(rows.mapInArrow(_placed, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>"), "tokens", FORMAT)


def of_documents(tokens: DataFrame, doc_ids: list) -> DataFrame:
    """The rows of some documents of a table of write_tokens(), of which only the pages that may hold them are read.

    Documents that aren't there give no row, equal doc_ids all of theirs, and an empty list none; None stands for a null doc_id.
    The ids asked for are meant to be few: files, row groups and pages are left out by the least and greatest doc_id they hold.
    """
    doc, known = F.col("doc_id"), sorted({x for x in doc_ids if x is not None})
    wanted = doc.isin(known) & (doc >= F.lit(known[0])) & (doc <= F.lit(known[-1])) if known else F.lit(False)
    return tokens.filter(wanted | doc.isNull() if None in doc_ids else wanted)


def starts(tokens: DataFrame) -> DataFrame:
    """part, base: the ids of all files before. Reads metadata columns only; one row to a file."""
    ends = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stash(ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-starts")


def _checksums(batches):
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8).data
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"]
        )


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = write_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    kind = tokens.schema["doc_id"].dataType.simpleString()
    read = tokens.select("doc_id", "part", "part_start", "ids").mapInArrow(_checksums, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(starts(tokens), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
