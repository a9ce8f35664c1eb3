"""Token ids in ORC: ascending doc_id, integer run-length encoding, row indexes, Bloom filters on doc_id.

Texts are dealt by doc_id range, sorted, encoded, and written by Spark's ORC writer:
``ids`` is an integer list column (run-length encoded, version 2), a row index entry
every STRIDE rows and a Bloom filter per entry on ``doc_id`` let a reader skip
stripes and row groups by metadata alone; stripes of one file are read in parallel.

Encoding.  The tokenizer splits at white space before its merges and never joins
across it, and it cuts between letters and marks.  NumPy cuts a slice of texts into such
units (runs of letters, runs of marks, or a whole piece that holds anything else),
Arrow numbers the distinct ones, the library is asked once for each of them (kept in a bounded
cache of two generations), and the ids of all units are gathered by number.  A test
holds this against whole-text encoding.

Defined results: a null or empty text has the end id alone; very long texts are encoded
whole; rows of one doc_id stand next to each other by the checksums of their ids in each file,
and a doc_id with very many rows spans files; ``start`` follows the files; null doc_ids
stand first; other columns are not written; an empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

VOCABULARY, END = "word_bpe_49k.json", 1
#: Rows between two row index entries; bytes of a stripe.
STRIDE, STRIPE = 1000, 16 << 20
#: Units in each of the two generations of a worker's cache; longer units than LONG bytes are not kept.
KEPT, LONG = 300_000, 48
SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: Marks that the tokenizer cuts off from letters and keeps in one run (no apostrophe, and no "<", which begins special tokens).
MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Bytes of text that are cut into units at once.
CUT_BYTES = 4_000_000
#: Letters up to here have the same normal form and lower case in Python and in the tokenizer, but for one.
LATIN, DOTTED = "\u0250", "\u0130"


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


SPACE_CLASS, LETTERS, MARK_RUN, OTHER = range(4)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, dtype=np.uint8)
    kind[C.SPACE] = SPACE_CLASS
    kind[[*range(65, 91), *range(97, 123)]] = LETTERS
    kind[list(MARKS)] = MARK_RUN
    return kind


CLASS = _classes()


def units(s: C.Slice) -> tuple[pa.Array, np.ndarray]:
    """The units of a slice (ASCII letters in lower case), and the first unit of each row."""
    buf, n = s.buf, len(s.buf)
    kind = CLASS[buf]
    high = np.flatnonzero(buf >= 0x80)
    if len(high):                                    # letters of two bytes below LATIN, but for the two signs and DOTTED
        lead = high[(high + 1 < n) & (buf[high] >= 0xC3) & (buf[high] <= 0xC9)]
        code = (buf[lead].astype(np.int32) & 0x1F) << 6 | buf[lead + 1] & 0x3F
        good = (buf[lead + 1] & 0xC0 == 0x80) & (code < ord(LATIN)) & (code != 0xD7) & (code != 0xF7) & (code != ord(DOTTED))
        kind[lead[good]] = LETTERS
        kind[lead[good] + 1] = LETTERS
    first, last = C.runs(kind != SPACE_CLASS, s.offs)
    other = np.concatenate([[0], np.cumsum(kind == OTHER)])
    mixed = other[last] > other[first]
    if mixed.any():                                  # a piece with anything else stays whole
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[first[mixed]] += 1
        np.subtract.at(inside, last[mixed], 1)
        kind[np.cumsum(inside)[:-1] > 0] = OTHER
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[s.offs] = True
    starts = np.flatnonzero(edge[:-1] & (kind != SPACE_CLASS)) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(edge[1:] & (kind != SPACE_CLASS)) + 1 if n else starts
    spelt = np.where(kind == OTHER, buf, C.LOWER[buf])[kind != SPACE_CLASS]
    offs = np.concatenate([[0], np.cumsum(ends - starts)])
    col = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(spelt.tobytes())])
    return col, np.searchsorted(starts, s.offs)


class Encoder(dict):
    """Whole texts to little-endian 32-bit ids; as a dict, the newer generation of encoded units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_letters()
        self.older: dict[bytes, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, unit: bytes) -> bytes | None:
        """Letters of the Latin range: one unit of the tokenizer, so its merges can be asked for directly."""
        if unit.isalpha():                           # ASCII, in lower case already
            spelt = unit.decode()
        else:
            text = unit.decode("utf-8", "replace")
            if not text.isalpha() or max(text) >= LATIN or DOTTED in text:
                return None
            spelt = "".join([self.alphabet[b] for b in unicodedata.normalize("NFC", text).lower().encode()])
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __missing__(self, unit: bytes) -> bytes:
        known = self.older.get(unit)
        if known is None:
            known = self._letters(unit) if len(unit) <= LONG else None
            if known is None:
                known = self._library(unit.decode("utf-8", "replace"))
            if len(unit) > LONG:
                return known
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[unit] = known
        return known

    def encode(self, s: C.Slice, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a slice, each row with ``end`` behind it, and the number of ids of each row."""
        col, rows = units(s)
        number = col.dictionary_encode()
        runs = [self[u] for u in number.dictionary.to_pylist()] + [end]
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        flat, first = np.frombuffer(b"".join(runs), dtype="<i4"), np.cumsum(size) - size
        which = np.insert(number.indices.to_numpy(), rows[1:], len(runs) - 1)
        many = size[which]
        done = np.cumsum(many)
        ids = flat[np.repeat(first[which] - (done - many), many) + np.arange(done[-1] if len(done) else 0)]
        return ids, np.diff(done[rows[1:] + np.arange(s.rows())], prepend=0)


_encoders: dict[str, Encoder] = {}


def checksums(ids: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """crc32 and adler32 of each row's ids; together the order of equal doc_ids in a file."""
    raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
    parts = [raw[4 * a:4 * b] for a, b in zip(offs.tolist(), offs[1:].tolist())]
    return (pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([zlib.adler32(x) for x in parts], pa.int64()))


def _encode(path: str, end: int):
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        if path not in _encoders:
            pa.default_memory_pool().release_unused()     # what earlier stages have left in this worker
            _encoders[path] = Encoder(path)
        known = _encoders[path]
        for rb in batches:
            for s in C.slices(rb.column("body"), CUT_BYTES):
                ids, size = known.encode(s, last)
                offs = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([
                    rb.column("doc_id").slice(s.lo, s.rows()), C.int64s(size), C.lists(pa.array(ids, pa.int32()), offs),
                    *checksums(ids, offs)], names=["doc_id", "n_tokens", "ids", "crc", "adler"])
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, end: int = END) -> None:
    """Encode whole texts and write doc_id, n_tokens, ids as ORC, in ascending doc_id order over the files."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.body(F.col("text")).alias("body"),
                       C.text_key(F.col("text")).alias("th"), F.monotonically_increasing_id().alias("m"))
    # a doc_id with very many rows is split by text, and by place in the input where even the texts are equal
    encoded = (rows.repartitionByRange("doc_id", "th", "m").select("doc_id", "body")
               .mapInArrow(_encode(vocabulary_path or vocabulary(), end), SCHEMA + ", crc long, adler long")
               .sortWithinPartitions("doc_id", "crc", "adler", "n_tokens").drop("crc", "adler"))
    with C.small_batches(docs.sparkSession):
        (encoded.write.option("compression", "zstd").option("orc.stripe.size", STRIPE).option("orc.create.index", "true")
         .option("orc.row.index.stride", STRIDE).option("orc.bloom.filter.columns", "doc_id")
         .option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The token table; with ``doc_ids`` the predicate reaches the ORC reader (file, stripe, row index, Bloom filter)."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def _sum_up(batches):
    for rb in batches:
        ids = rb.column("ids")
        offs = ids.offsets.to_numpy().astype(np.int64)
        crc, adler = checksums(ids.values.to_numpy(), offs)
        yield pa.RecordBatch.from_arrays([rb.column("file"), rb.column("doc_id"), C.int64s(np.diff(offs)), crc, adler],
                                         names=["file", "doc_id", "n_tokens", "ids_crc32", "adler"])


def layout(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a written token table, all from its files.

    The running sum has two levels: over the files, then within each file.
    """
    rows = C.written(read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "ids")
                     .mapInArrow(_sum_up, "file string, doc_id long, n_tokens long, ids_crc32 long, adler long"), "layout")
    before = Window.orderBy(F.asc_nulls_first("first"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = (rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"),
                                      F.count("doc_id").alias("ids"), F.min("doc_id").alias("low"))
             .withColumn("first", F.when(F.col("ids") == F.col("rows"), F.col("low")))
             .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "ids_crc32", "adler", "n_tokens")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("i", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file")
            .select("doc_id", (F.col("offset") + F.col("i")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = C.scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return layout(spark, path)


def token_query(spark, sf_dir: str) -> DataFrame:
    return token_output(spark, C.table(spark, sf_dir, "documents"), sf_dir)
