"""Operator 6: token ids in bit-plane files.

Documents are put in ascending ``doc_id`` order (a range shuffle; repeated ids
are spread by a running number), encoded, and written as one stream of ids, an end id
after each document. A file holds fixed-size blocks of 32-bit ids. A block is
transposed into 4 byte planes or 32 bit planes (all first bytes, all second
bytes, ...), so that the near-constant high planes shrink to almost nothing,
and every plane is compressed with zstandard on its own.

File layout, little-endian; every record ends with one line feed::

    block*  "BLK1" u32 ids, u8 planes, planes x u32 sizes, the planes (zstd)
    docs    "DOC1" u32 size, zstd of: i64 doc_id x n, u8 is-null x n, u64 ids x n
    index   "IDX1" u32 blocks, blocks x (u64 offset, u32 ids), u64 offset of docs,
            u32 documents, u64 offset of this record, "END1"

The line feeds let Spark's text writer carry the records: files are written by
Spark's own commit protocol to any file system it knows, a lost executor's
part is simply written again, and no task needs a local path. Reading uses
``binaryFile``; the number of files follows from the bytes of all texts, so that
a file stays near ``file_bytes`` and far below that reader's 2 GB.

Defined results: a null text is encoded as the empty text (one end id); rows
with a null id come first; repeated rows follow one another; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesonar.llm.common import arrow_rows, fresh, held, partitions, text_or_empty, write_table
from lakesonar.session import new_table_path

# An empty entry, a lone line feed, or white space behind the entry's first place (in front, but
# for a line feed).
SPACES = r"\x{09}\x{0b}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"^\n?$|[{SPACES}]|.\n"
SLICE_ROWS = 256  # of ids read back at a time
SLICE_BYTES = 4 << 20  # of text encoded at a time
BATCH_ROWS = 1000  # documents sent to a task at a time


# encoding ------------------------------------------------------------------

class Encoder:
    """Whole texts to ids through the tokenizers library, with a memo of words.

    The vocabulary's pre-tokenizer never joins characters across a lone space or
    line feed between two other characters: a piece begins at the space, and a
    lone line feed is a piece. Texts with no other white space are cut there, and
    each distinct (space +) word is encoded once by the library while the memo holds
    it; new words go through it together, one a line, and the ids are cut at the
    line feeds' ids. Closing marks after a letter or digit are a piece of their own, so
    a word with them is put together from the word and the marks. All other texts are encoded whole. The memo has two
    generations of ``memo`` words each, so its memory is bounded.
    """

    TOGETHER = 200  # new words in one call's text
    MARKS = ".,;:!?"

    def __init__(self, path: str, memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.memo = memo
        self.added = re.compile("|".join(
            re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")
        (self.feed,) = self._whole(["\n"])
        self.marks: dict[str, bytes] = {}
        self.first: list[dict] = [{}, {}]  # words at the start of a line
        self.later: list[dict] = [{}, {}]  # words after a space

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[str]) -> list[bytes]:
        """Ids of words without white space inside (a space may stand in front)."""
        out = []
        feed = int.from_bytes(self.feed, "little")
        for at in range(0, len(new), self.TOGETHER):
            text = "\n".join(new[at:at + self.TOGETHER])
            if len(self.feed) > 4 or self.added.search(text):  # an added token cuts the text elsewhere
                out += self._whole(new[at:at + self.TOGETHER])
                continue
            (data,) = self._whole([text])
            ids = np.frombuffer(data, "<u4")
            cuts = np.flatnonzero(ids == feed).tolist()
            out += [data[4 * a + 4:4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
        return out

    def _learn(self, memo: list[dict], lacking: set, prefix: str) -> None:
        """Put the ids of ``lacking`` words into the young generation."""
        young, old = memo
        new = lacking - old.keys()
        young.update([(w, old[w]) for w in lacking - new])
        stems = {}  # of words with marks
        for w in new:
            if w[-1] in self.MARKS:
                stem = w.rstrip(self.MARKS)
                if stem and stem[-1].isalnum():
                    stems[w] = stem
        new.difference_update(stems)
        new.update([s for s in stems.values() if s not in young])
        order = list(new)
        young.update(zip(order, self._words([prefix + w for w in order])))
        for w, stem in stems.items():
            marks = w[len(stem):]
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                (self.marks[marks],) = self._whole([marks])
            young[w] = young[stem] + self.marks[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The words of the texts become a dictionary, whose entries are looked up once each; the
        texts' ids are then taken from it and cut at the texts' ends. An entry with a line
        feed in front begins a line; a text's first word is an entry of its own."""
        for memo in (self.first, self.later):
            if len(memo[0]) > self.memo:
                memo[0], memo[1] = {}, memo[0]
        first, later = self.first[0], self.later[0]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = lists.offsets.to_numpy()
        begins, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        words = lists.flatten().dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        place = words.indices.to_numpy(zero_copy_only=False).copy()
        # a separator is not a space or line feed, alone, where an entry is empty or holds white space
        wrong = pc.match_substring_regex(words.dictionary, ODD).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(wrong[place], begins) if wrong.any() else np.zeros(len(texts), bool)
        known = [*map(later.get, keys)]
        new = [j for j, ids in enumerate(known) if ids is None and not wrong[j]]
        starts = [keys[j] for j in place[begins].tolist()]
        openers = list({w for w, o in zip(starts, odd.tolist()) if not o})
        lines = [j for j in new if keys[j][0] == "\n"]
        self._learn(self.first, {w for w in [*openers, *[keys[j][1:] for j in lines]] if w not in first}, "")
        self._learn(self.later, {keys[j] for j in new if keys[j][0] != "\n"}, " ")
        for j in new:
            known[j] = later[keys[j]] if keys[j][0] != "\n" else self.feed + first[keys[j][1:]]
        at = {w: len(keys) + n for n, w in enumerate(openers)}
        place[begins] = [at.get(w, 0) for w in starts]
        ids = pa.array([*[k or b"" for k in known], *[first[w] for w in openers]], pa.binary()).take(pa.array(place))
        _, offsets, data = ids.buffers()
        offsets = np.frombuffer(offsets, np.int32)[ids.offset:ids.offset + len(ids) + 1]
        data = memoryview(data)
        out = [bytes(data[a:b]) for a, b in zip(offsets[begins].tolist(), offsets[ends].tolist())]
        whole = np.flatnonzero(odd).tolist()
        for i, found in zip(whole, self._whole([texts[i].as_py() for i in whole])):
            out[i] = found
        return out


MEMO = 400_000  # words of a generation


def encoder(path: str, memo: int = MEMO) -> Encoder:
    return held(f"tokens {path} {memo}", lambda: Encoder(path, memo))


# blocks --------------------------------------------------------------------

def pack_block(ids: np.ndarray, planes: str, level: int) -> bytes:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        parts = [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    else:
        parts = [rows[:, i].tobytes() for i in range(4)]
    z = zstandard.ZstdCompressor(level=level)
    packed = [z.compress(p) for p in parts]
    return b"".join([b"BLK1", struct.pack("<IB", len(ids), len(packed)),
                     struct.pack(f"<{len(packed)}I", *map(len, packed)), *packed, b"\n"])


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    n, planes = struct.unpack_from("<IB", data, at + 4)
    sizes = struct.unpack_from(f"<{planes}I", data, at + 9)
    at += 9 + 4 * planes
    z = zstandard.ZstdDecompressor()
    rows = np.zeros((n, 4), np.uint8)
    for i, size in enumerate(sizes):
        plane = np.frombuffer(z.decompress(data[at:at + size]), np.uint8)
        at += size
        if planes == 32:
            bits = np.unpackbits(plane, count=n, bitorder="little")
            rows[:, i // 8] |= bits << (i % 8)
        else:
            rows[:, i] = plane
    return rows.reshape(-1).view("<u4")


class FileWriter:
    """Turns encoded documents, in order, into the records of one file."""

    def __init__(self, block_ids: int, planes: str, level: int):
        self.block_ids, self.planes, self.level = block_ids, planes, level
        self.pending: list[bytes] = []
        self.n_pending = 0
        self.offset = 0
        self.blocks: list[tuple[int, int]] = []
        self.doc_ids: list = []
        self.lengths: list[int] = []

    def _block(self, ids: np.ndarray) -> bytes:
        record = pack_block(ids, self.planes, self.level)
        self.blocks.append((self.offset, len(ids)))
        self.offset += len(record)
        return record

    def add(self, doc_id, ids: bytes) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.block_ids:
            whole = np.frombuffer(b"".join(self.pending), "<u4")
            full = len(whole) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                yield self._block(whole[i:i + self.block_ids])
            self.pending = [whole[full:].tobytes()]
            self.n_pending = len(whole) - full

    def close(self) -> Iterator[bytes]:
        if self.n_pending:
            yield self._block(np.frombuffer(b"".join(self.pending), "<u4"))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        table = zstandard.ZstdCompressor().compress(
            ids.tobytes() + null.tobytes() + np.array(self.lengths, "<u8").tobytes())
        docs_at = self.offset
        record = b"DOC1" + struct.pack("<I", len(table)) + table + b"\n"
        yield record
        index_at = docs_at + len(record)
        yield b"".join([b"IDX1", struct.pack("<I", len(self.blocks)),
                        *[struct.pack("<QI", *b) for b in self.blocks],
                        struct.pack("<QIQ", docs_at, len(self.doc_ids), index_at), b"END1\n"])


def read_file(content: bytes) -> Iterator[tuple]:
    """(doc_id, start in the file, ids) of each document of a file, block by block."""
    data = memoryview(content)
    if bytes(data[-5:]) != b"END1\n":
        raise ValueError("not a bit-plane token file, or cut short")
    docs_at, n, index_at = struct.unpack("<QIQ", data[-25:-5])
    (n_blocks,) = struct.unpack_from("<I", data, index_at + 4)
    (size,) = struct.unpack_from("<I", data, docs_at + 4)
    table = zstandard.ZstdDecompressor().decompress(data[docs_at + 8:docs_at + 8 + size])
    ids = np.frombuffer(table, "<i8", n)
    null = np.frombuffer(table, np.uint8, n, 8 * n)
    lengths = np.frombuffer(table, "<u8", n, 9 * n)
    offsets = (struct.unpack_from("<QI", data, index_at + 8 + 12 * b)[0] for b in range(n_blocks))
    have, start = np.zeros(0, "<u4"), 0
    for i in range(n):
        length = int(lengths[i])
        parts = [have]
        got = len(have)
        while got < length:
            parts.append(unpack_block(data, next(offsets)))
            got += len(parts[-1])
        have = np.concatenate(parts) if len(parts) > 1 else have
        yield None if null[i] else int(ids[i]), start, have[:length]
        have = have[length:]
        start += length


# Spark ---------------------------------------------------------------------

def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text (column 1), one row at least."""
    full = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      block_ids: int = 65_536, planes: str = "byte", level: int = 3,
                      file_bytes: int = 64 << 20, memo: int = MEMO) -> None:
    """Encode ``docs`` (doc_id, text) and write them as bit-plane files under ``path``. A smaller ``memo`` of words
    takes less memory and more time; the ids are the same."""
    if planes not in ("byte", "bit"):
        raise ValueError("planes is 'byte' or 'bit'")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(partitions(docs.sparkSession), -(-total // file_bytes))
    tie, num = fresh(rows, "_tie", "_num")
    ranged = (rows.withColumns({tie: F.xxhash64("text"), num: F.monotonically_increasing_id()})
              .repartitionByRange(files, "doc_id", tie, num).sortWithinPartitions("doc_id", tie)
              .select("doc_id", "text"))
    end = np.array([end_id], "<u4").tobytes()

    def records(batches):
        enc = encoder(tokenizer, memo)
        out = FileWriter(block_ids, planes, level)
        for batch in batches:
            for part in slices(batch):
                encoded = enc.encode_column(part.column(1))
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded):
                    for record in out.add(doc_id, ids + end):
                        yield pa.RecordBatch.from_arrays([pa.array([record[:-1]], pa.binary())], ["value"])
        for record in out.close() if out.doc_ids else ():
            yield pa.RecordBatch.from_arrays([pa.array([record[:-1]], pa.binary())], ["value"])

    # a cast from binary keeps the bytes; the writer adds the line feed of each record
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        (ranged.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
         .write.option("lineSep", "\n").text(path))


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Documents in files of :func:`write_token_files`: (file, start_in_file,
    doc_id, n_tokens, ids_crc32[, ids]); ``ids`` adds the ids as an array."""
    schema = "file int, start_in_file long, doc_id long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if ids else ""

    def documents(batches):
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * ids
        names = ["file", "start_in_file", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * ids

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                file, rows = batch.column(0)[i].as_py(), []
                for doc_id, start, got in read_file(batch.column(1)[i].as_buffer()):
                    row = (file, start, doc_id, len(got), zlib.crc32(got.tobytes()))
                    rows.append(row + (got.tolist(),) if ids else row)
                    if len(rows) >= 4096 or ids and len(rows) >= SLICE_ROWS:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return (files.filter(F.col("length") > 0)
            .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
            .mapInArrow(documents, schema))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the
    files: ``start`` counts the ids of all documents before it. Only one row per file is summed up
    in order."""
    rows = write_table(read_token_files(spark, path), "token-rows")
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = per_file.select("file", F.coalesce(
        F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("base"))
    return rows.join(base, "file").select(
        "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str, path: str | None = None, **params) -> DataFrame:
    """Write the files (default: a new folder in the shared folder) and return their index."""
    spark = docs.sparkSession
    path = path or new_table_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **params)
    return token_index(spark, path)
