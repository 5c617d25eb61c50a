"""Token-ID output as patched frame-of-reference blocks.

File: 8 bytes magic, blocks, document index, block index, footer.  A block holds
up to ``BLOCK`` ids: their minimum is subtracted, the rest packed at a width that a
percentile of them fits; those that don't fit are exceptions: their low bits are
packed with the others, position and high part follow in a list.  The width is the
percentile whose block comes out smallest.  The block index has each block's byte
position, so any block can be read alone.  The document index (doc_ids as differences,
numbers of ids) and the block index are blocks of the same kind.

Documents are dealt to tasks by ranges of doc_id, their number by the bytes of text, and
a task begins a new file after ``FILE_IDS`` ids, so files in order hold all
documents in ascending doc_id order and none is much longer than that plus one document.  A task writes a file under an own name and
renames it, so a task that runs twice leaves whole files.  Files go through
``pyarrow.fs``, to any file system that the shared folder's address names; readers read the
indexes, then a run of blocks at a time.

Ids come from a public tokenizer.  Its tokens never span white space, so each
word between ``\\x20 \\x09-\\x0D`` is encoded once per worker and looked up by its
64-bit hash after that.

Edge cases: null and empty texts hold the end id alone; rows with null doc_id come
first and are written under id 0, repeated doc_ids next to each other in order of their text; very long texts span
blocks, a task holds one at a time; bytes that are no UTF-8 are read as U+FFFD; an empty table gives no file and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .shared import discarded_at_end, shared_path, ship

MAGIC, BLOCK, PERCENTILES = b"PFORBLK1", 4096, (75, 90, 95, 98, 100)
CACHE_WORDS = 1_500_000
FILE_IDS, TASK_BYTES, LEAST_BYTES = 1 << 26, 256 << 20, 4 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- blocks ---------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    whole[:, : packed.shape[1]] = packed
    return whole.view("<u8").ravel().astype(np.uint64)


def encode_block(values: np.ndarray) -> bytes:
    """A block of unsigned values: n, minimum, width, exceptions' width and number, packed low parts, exceptions."""
    values = values.astype(np.uint64)
    least = values.min() if len(values) else np.uint64(0)
    rest = values - least
    sorted_ = np.sort(rest)
    widest = int(sorted_[-1]).bit_length() if len(rest) else 0
    best = None
    for p in PERCENTILES:
        w = int(sorted_[max(0, -(-len(rest) * p // 100) - 1)]).bit_length() if len(rest) else 0
        n_out = len(rest) - int(np.searchsorted(sorted_, np.uint64((1 << w) - 1), "right"))
        cost = len(rest) * w + n_out * (16 + widest - w)
        if best is None or cost < best[0]:
            best = cost, w
    w = best[1]
    low = rest & np.uint64((1 << w) - 1)
    out = np.flatnonzero(rest >> np.uint64(w)) if w < 64 else np.zeros(0, np.int64)
    high = rest[out] >> np.uint64(w)
    return b"".join([
        np.array([len(rest)], "<u4").tobytes(), np.array([least], "<u8").tobytes(), bytes([w, max(widest - w, 0)]), np.array([len(out)], "<u2").tobytes(),
        _pack(low, w), out.astype("<u2").tobytes(), _pack(high, max(widest - w, 0)),
    ])


def decode_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The values of the block at byte ``at`` and the byte after it."""
    n = int(np.frombuffer(data, "<u4", 1, at)[0])
    least = np.frombuffer(data, "<u8", 1, at + 4)[0]
    w, more = data[at + 12], data[at + 13]
    n_out = int(np.frombuffer(data, "<u2", 1, at + 14)[0])
    at += 16
    size = (n * w + 7) // 8
    values = _unpack(data[at : at + size], n, w)
    at += size
    where = np.frombuffer(data, "<u2", n_out, at).astype(np.int64)
    at += 2 * n_out
    size = (n_out * more + 7) // 8
    if n_out:
        values[where] |= _unpack(data[at : at + size], n_out, more) << np.uint64(w)
    return values + np.uint64(least), at + size


def _sequence(values: np.ndarray) -> bytes:
    return b"".join(encode_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK))


def _read_sequence(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    parts = []
    while n > 0:
        part, at = decode_block(data, at)
        parts.append(part)
        n -= len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), at


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, stream):
        self.stream, self.at, self.starts, self.docs, self.lengths = stream, len(MAGIC), [], [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        stream.write(MAGIC)

    def add(self, doc_ids: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths += lengths.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            block = encode_block(ids[i : min(i + BLOCK, whole)])
            self.starts.append(self.at)
            self.stream.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        """Writes the indexes; the number of ids."""
        self._flush(True)
        docs = np.array(self.docs, np.int64)
        first = docs[0] if len(docs) else np.int64(0)
        steps = np.diff(docs, prepend=first).view(np.uint64)
        index = _sequence(steps) + _sequence(np.array(self.lengths, np.uint64)) + _sequence(np.diff(np.array([0, *self.starts], np.uint64)))
        self.stream.write(index + np.array([self.at, len(docs), first, len(self.starts)], "<i8").tobytes() + MAGIC)
        return int(sum(self.lengths))


def read_file(stream, run: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of a file's documents, a run of whole documents at a time; ``run`` blocks are read at once."""

    def part(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)

    size = stream.seek(0, 2)
    if size < 48 or part(0, 8) != MAGIC or part(size - 8, 8) != MAGIC:
        raise ValueError("not a token file")
    index, n_docs, first, n_blocks = np.frombuffer(part(size - 40, 32), "<i8").tolist()
    data = part(index, size - 40 - index)
    steps, at = _read_sequence(data, 0, n_docs)
    lengths, at = _read_sequence(data, at, n_docs)
    starts, _ = _read_sequence(data, at, n_blocks)
    docs = first + np.cumsum(steps.view(np.int64))
    lengths, have, done = lengths.astype(np.int64), [], 0
    ends = np.cumsum(lengths)
    n_have = given = 0
    bounds = [*np.cumsum(starts.view(np.int64)).tolist(), index]
    for k in range(0, n_blocks, run):
        upto = min(k + run, n_blocks)
        data, at = part(bounds[k], bounds[upto] - bounds[k]), 0
        for _ in range(k, upto):
            block, at = decode_block(data, at)
            have.append(block.astype("<u4"))
            n_have += len(block)
        upto = int(np.searchsorted(ends, given + n_have, "right"))
        if upto > done:
            ids = np.concatenate(have)
            n = int(ends[upto - 1]) - given
            yield docs[done:upto], lengths[done:upto], ids[:n]
            have, given, done = [ids[n:]], given + n, upto
            n_have = len(have[0])


# ---- ids of texts -----------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by the tokenizer, each distinct word encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, all ids), every row closed by ``end``."""
        starts, ends, rows = A.word_spans(data, offsets)
        hashes = A.span_hashes(data, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            count = np.array([len(x) for x in found], np.int64)
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))])
            into = np.searchsorted(self.hashes, distinct[new])  # both are sorted
            self.hashes = np.insert(self.hashes, into, distinct[new])
            self.first, self.count = np.insert(self.first, into, first), np.insert(self.count, into, count)
            at = np.searchsorted(self.hashes, distinct)
        first, count = self.first[at][inverse], self.count[at][inverse]
        n_rows = len(offsets) - 1
        lengths = np.bincount(rows, weights=count, minlength=n_rows).astype(np.int64) + 1
        stop = np.cumsum(lengths)
        ids = np.full(int(stop[-1]) if n_rows else 0, end, np.uint32)
        free = np.ones(len(ids), bool)
        free[stop - 1] = False
        total = np.cumsum(count)
        source = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)
        ids[free] = self.ids[source]
        return lengths, ids


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of this tokenizer; its words stay from task to task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- the operator -----------------------------------------------------------------------------------------------


def _open_folder(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system, path


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    encoder, task = word_encoder(path), TaskContext.get().partitionId()
    system = where = writer = None
    made: list[tuple[str, int, int]] = []

    def begin() -> tuple[Writer, str]:
        own = f"{where}/.part-{uuid.uuid4().hex}"
        return Writer(system.open_output_stream(own)), own

    def finish() -> None:
        n_ids, name = writer.close(), f"part-{task:05d}-{len(made):05d}.pfor"
        writer.stream.close()
        system.move(own, f"{where}/{name}")
        made.append((name, len(writer.docs), n_ids))

    n_ids = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if system is None:
            system, where = _open_folder(folder)
        ids = [0 if i is None else i for i in batch.column("doc_id").to_pylist()]
        for row, data, offsets in A.text_slices(batch.column("text"), min(4 << 20, 4 * most)):
            if writer is None:
                (writer, own), n_ids = begin(), 0
            lengths, tokens = encoder.encode(data, offsets, end)
            writer.add(ids[row : row + len(lengths)], lengths, tokens)
            n_ids += len(tokens)
            if n_ids >= most:
                finish()
                writer = None
    if writer is not None:
        finish()
    if made:
        names, n_docs, n_ids = zip(*made)
        yield pa.record_batch({"part": pa.array([task] * len(made), pa.int32()), "seq": pa.array(range(len(made)), pa.int32()), "file": pa.array(names), "n_docs": pa.array(n_docs, pa.int64()), "n_ids": pa.array(n_ids, pa.int64())})


def _read_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            system, where = _open_folder(folder)
            with system.open_input_file(f"{where}/{name}") as f:
                for docs, lengths, ids in read_file(f):
                    ends = np.cumsum(lengths)
                    raw, sums = memoryview(ids.tobytes()), []
                    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                        sums.append(zlib.crc32(raw[4 * a : 4 * b]))
                    yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})
                    start += int(ends[-1]) if len(ends) else 0


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, tasks: int | None = None, most: int = FILE_IDS) -> DataFrame:
    """Write all documents in doc_id order; (part, seq, file, n_docs, n_ids, start) of each file.

    The table of files is written beside them, so the files are made once.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not tasks:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(1, size // TASK_BYTES, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES))
    dealt = docs.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(lambda b: _write_files(b, folder, tokenizer, end, most), "part int, seq int, file string, n_docs long, n_ids long").write.parquet(f"{folder}/files.parquet")
    made = spark.read.parquet(f"{folder}/files.parquet")
    # one row a file
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(n, "file").mapInArrow(lambda b: _read_files(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Write files of all documents' ids to the shared folder and read their digest back."""
    folder = shared_path(docs.sparkSession, "tokens")
    files = write_token_files(docs, folder, tokenizer or tokenizer_path(), end)
    discarded_at_end(docs.sparkSession, folder)
    return read_token_files(files, folder)


def op7_query(spark, sf_dir: str) -> DataFrame:
    """The digest of all documents' ids."""
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
