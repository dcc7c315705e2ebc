"""10. Token-ID output in independent zstandard frames with a seek table.

A file holds documents in ascending id order. Each frame is an own zstandard frame; after the last
data frame come an index frame and a seek table in a skippable frame:

    data frame    count u32, then count x (doc id i64, ids u32), then the ids of all its documents, u16 or u32;
                  the highest bit of a document's number of ids says that its doc id is null
    index frame   the first row of each data frame: first document's number u64, ids before it u64
    seek table    magic 0x184D2A5E, size u32, then per frame: compressed size u32, size u32, low half
                  of XXH64 of the content u32; at the end frames u32, flags u8 (bit 7: checksums; bit 0:
                  ids of 32 bits), magic 0x8F92EAB1

so a reader reads the table from the end of the file and decompresses only the frames it needs.

Tasks write under a name of their own and report it with their rows; the manifest, written by
Spark's commit, lists the files of the attempts that counted. What a lost or repeated attempt left
is never read. Files go through pyarrow's file systems, so the folder may be on any shared store.

Edge cases: a null text is encoded as empty, and still has its end id; repeated document ids are
all written, ordered by their ids' bytes; a null id comes first and is read back as null; a document has
less than 2**31 ids (ValueError beyond); texts of any length are encoded in windows; further columns are
not read, whatever their names; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.llm import bpe, order
from wordmill.llm.common import fresh_path, slices, small_batches

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
LEVEL = 3
ENTRY, FOOT = struct.Struct("<III"), struct.Struct("<IBI")
#: The bit of a document's number of ids that says that its doc id is null.
NO_DOC = 1 << 31


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one file; rows must come in order."""

    def __init__(self, out, wide: bool, frame_bytes: int = FRAME_BYTES):
        self.out, self.wide, self.frame_bytes = out, wide, frame_bytes
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.heads: list[tuple[int | None, int]] = []
        self.bodies: list[bytes] = []
        self.size = self.documents = self.ids = self.written = 0
        self.entries: list[tuple[int, int, int]] = []
        self.first: list[tuple[int, int]] = []

    def _frame(self, data: bytes) -> None:
        packed = self.press.compress(data)
        self.out.write(packed)
        self.written += len(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if len(ids) >= NO_DOC:
            raise ValueError("too many ids in a document")
        self.heads.append((doc, len(ids)))
        self.bodies.append(ids.astype("<u4" if self.wide else "<u2").tobytes())
        self.size += len(self.bodies[-1])
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.heads:
            self.first.append((self.documents, self.ids))
            heads = b"".join([struct.pack("<qI", 0, n | NO_DOC) if doc is None else struct.pack("<qI", doc, n) for doc, n in self.heads])
            self._frame(struct.pack("<I", len(self.heads)) + heads + b"".join(self.bodies))
            self.documents += len(self.heads)
            self.ids += sum(n for _, n in self.heads)
            self.heads, self.bodies, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        self._frame(b"".join(struct.pack("<QQ", *x) for x in self.first))
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOT.pack(len(self.entries), 0x80 | self.wide, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.written += 8 + len(table)


class Reader:
    """Reads frames of one file (a file object that can seek); checks sizes and checksums."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOT.size)
        frames, flags, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        self.wide = bool(flags & 1)
        table = frames * ENTRY.size
        source.seek(size - FOOT.size - table)
        self.entries = list(ENTRY.iter_unpack(source.read(table)))
        self.starts = np.cumsum([0, *(e[0] for e in self.entries)]).tolist()
        if self.starts[-1] + 8 + table + FOOT.size != size:
            raise ValueError("the seek table does not fit the file")
        self.index = list(struct.iter_unpack("<QQ", self._data(frames - 1)))
        self.read_frames = 0

    def _data(self, frame: int) -> bytes:
        packed, length, check = self.entries[frame]
        self.source.seek(self.starts[frame])
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=length)
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        return data

    def __len__(self) -> int:
        return len(self.entries) - 1

    def frame(self, frame: int) -> Iterator[tuple[int | None, np.ndarray, int]]:
        """(document id, ids, ids before it in the file) of each document in a frame."""
        self.read_frames += 1
        data, before = self._data(frame), self.index[frame][1]
        (count,) = struct.unpack_from("<I", data)
        heads = list(struct.iter_unpack("<qI", data[4 : 4 + 12 * count]))
        kind, at = np.dtype("<u4" if self.wide else "<u2"), 4 + 12 * count
        for doc, n in heads:
            doc, n = (None, n ^ NO_DOC) if n & NO_DOC else (doc, n)
            yield doc, np.frombuffer(data, kind, n, at), before
            at, before = at + n * kind.itemsize, before + n

    def document(self, number: int) -> tuple[int | None, np.ndarray, int]:
        """The document of that number (from 0) in the file; decompresses its frame only."""
        frame = int(np.searchsorted([f for f, _ in self.index], number, side="right")) - 1
        for i, row in enumerate(self.frame(frame), self.index[frame][0]):
            if i == number:
                return row
        raise IndexError(number)


class LibraryWords:
    """Encodes distinct words with the tokenizers library's BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(bpe.local(path)).model
        self.symbol = bpe.byte_symbols()

    def __call__(self, words) -> dict[bytes, list[int]]:
        symbol, tokenize = self.symbol, self.model.tokenize
        return {w: [t.id for t in tokenize(w.decode() if w.isalpha() else "".join([symbol[b] for b in w]))] for w in words}


_coders: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    if path not in _coders:
        _coders[path] = bpe.Encoder(path, LibraryWords(path))
    return _coders[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", cuts: list[int] | None = None) -> DataFrame:
    """doc_id long, ids binary (packed 16-bit if the vocabulary allows), part int. One scan."""
    cuts = cuts or []
    small_batches(docs.sparkSession)
    bpe.ship(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(tokenizer)
        kind = "<u4" if len(coder.vocabulary.content) > 1 << 16 or end_id >= 1 << 16 else "<u2"
        for piece in slices(batches, "text"):
            ids, at = coder.column(piece.column(1))
            ended = np.insert(ids.astype(kind), at[1:], end_id)
            keys = piece.column(0).cast(pa.int64())
            ranks = keys.fill_null(order.LOWEST).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, ranks, side="right").astype(np.int32) if cuts else np.zeros(len(ranks), np.int32)
            yield pa.RecordBatch.from_arrays([keys, bpe.packed(ended, at + np.arange(len(at))), pa.array(part)], names=["doc_id", "ids", "part"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, part int")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write docs to folder in ascending order of key, a file for each range of it. Returns the manifest
    (also in folder/manifest): part int, file string, documents long, ids long, bytes long.

    Range bounds come from a sketch of the key column, so texts are encoded once and only packed
    ids are shuffled."""
    spark = docs.sparkSession
    n = partitions or order.partitions_of(docs)
    cuts = order.bounds(docs, key, n)
    wide = len(bpe.vocabulary(tokenizer).content) > 1 << 16 or end_id >= 1 << 16
    rows = order.spread(tokenize(docs, tokenizer, end_id, key, text, cuts), "part", n).sortWithinPartitions("part", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        done: list[tuple] = []
        writer, out, name, part = None, None, "", None

        def close() -> None:
            writer.close()
            out.close()
            done.append((part, name, writer.documents, writer.ids, writer.written))

        for piece in slices(batches, "ids"):
            for doc, ids, here in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if here != part:
                    if writer:
                        close()
                    part, name = here, f"tokens-{here:05d}-{uuid.uuid4().hex}.zst"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    writer = Writer(out, wide, frame_bytes)
                writer.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2"))
        if writer:
            close()
        if done:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["part", "file", "documents", "ids", "bytes"])

    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    rows.mapInArrow(run, "part int, file string, documents long, ids long, bytes long").write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, file string, documents long, ids long, bytes long").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned
    32-bit little-endian) and, if asked, ids array<int>, read back from the files of the manifest."""
    files = manifest(spark, folder)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    listed = files.withColumn("before", before).select("file", "bytes", "before")
    many = max(1, min(order.partitions_of(files), 10_000))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{at}/{name}") as source:
                    reader = Reader(source, size)
                    for frame in range(len(reader)):
                        rows = list(reader.frame(frame))
                        made = [
                            pa.array([d for d, _, _ in rows], pa.int64()),
                            pa.array([start + b for _, _, b in rows], pa.int64()),
                            pa.array([len(x) for _, x, _ in rows], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x, _ in rows], pa.int64()),
                        ]
                        if with_ids:
                            made.append(pa.array([x.astype(np.int32) for _, x, _ in rows], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return listed.repartition(many, "file").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs to a fresh shared folder and read the files back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokenfile")
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    write(docs, folder, tokenizer, end_id, key, text)
    return read(spark, folder, with_ids=False)
