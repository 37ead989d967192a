"""Token ids in binary files: frequency-ranked ids in one or more bytes each, lengths in separate control bytes.

File format (numbers little-endian): ``TOKF`` and seven unsigned 64-bit numbers (range, start, documents, ids, bits of a
control code, control bytes, data bytes), then doc_id as signed 64-bit, a byte for each id that says whether it is null, the
number of ids of each document as unsigned 64-bit, the control bytes and the data bytes.  A control code says in how many
bytes, less one, the rank of an id stands; codes fill a control byte from its low bits on, and each document starts a new
one.  ``ids`` lists the ids by rank.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import range_of, range_tops, shared_path, small_batches, stored, text_of
from assayer.llm.tokens import encoder

MAGIC = b"TOKF"
HEAD = "<4s7Q"
HEAD_BYTES = struct.calcsize(HEAD)
SHARD_IDS = 8_000_000
IDS_AT_ONCE = 1_000_000


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool = True) -> DataFrame:
    """doc_id, ids: each text's ids and the end id as unsigned 32-bit integers; null texts are empty."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces).many
        for b in batches:
            ids = [x + end for x in encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n over all documents; a task sends each id once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u4"))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
            total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame) -> np.ndarray:
    """Ids by falling count, ties by id; at most the size of the vocabulary."""
    rows = sorted((-r["n"], r["id"]) for r in counts.collect())
    return np.array([i for _, i in rows], dtype=np.uint32)


def _padded(n: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes of documents of n ids stand if each starts a new control byte, and their control bytes each."""
    held = -(-n // per)
    return np.arange(int(n.sum())) + np.repeat(np.cumsum(held) * per - held * per - (np.cumsum(n) - n), n), held


def compress(ranks: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the ranks of documents of n ids, and how many of each a document has.

    ``bits`` of a code must be enough for the largest rank.
    """
    size = np.ones(len(ranks), dtype=np.int64)
    for k in range(1, 1 << bits):
        size += ranks >= 1 << 8 * k
    per = 8 // bits
    at, held = _padded(n, per)
    codes = np.zeros(int(held.sum()) * per, dtype=np.uint8)
    codes[at] = size - 1
    control = np.bitwise_or.reduce(codes.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(bits)), axis=1)
    ends = np.cumsum(size)
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(1 << bits):
        own = size > k if k else slice(None)
        data[(ends - size)[own] + k] = ranks[own] >> 8 * k & 255
    last = np.concatenate([[0], ends])[np.cumsum(n)]
    return control.astype(np.uint8), data, held, np.diff(last, prepend=0)


def expand(control: np.ndarray, data: np.ndarray, n: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    """The ids again: a table gives the lengths for each control byte, another the id for each rank."""
    per = 8 // bits
    lengths = ((np.arange(256)[:, None] >> np.arange(per) * bits & (1 << bits) - 1) + 1).astype(np.uint8)
    size = lengths[control].reshape(-1)[_padded(n, per)[0]]
    at = np.cumsum(size, dtype=np.int64) - size
    rank = data[at].astype(np.int64)
    for k in range(1, 1 << bits):
        own = np.flatnonzero(size > k)
        rank[own] |= data[at[own] + k].astype(np.int64) << 8 * k
    return ids[rank]


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def write_files(encoded: DataFrame, folder: str, ids: np.ndarray) -> None:
    """Write ``encoded`` as files in ascending doc_id order; ``folder`` is a URI that executors reach with pyarrow.

    A task writes its range in files of about SHARD_IDS ids, under another name first, so that a task run again or twice
    leaves whole files.
    """
    bits = 1 if len(ids) <= 1 << 16 else 2 if len(ids) <= 1 << 32 else 4
    sc = encoded.sparkSession.sparkContext
    shared = sc.broadcast(ids)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(shared.value.max(initial=0)) + 1, dtype=np.int64)
        rank[shared.value] = np.arange(len(shared.value))
        for b in batches:
            docs = b.column(0).to_pylist()
            held = b.column(1).to_pylist()
            first = 0
            while first < len(docs):
                last, total = first, 0
                while last < len(docs) and (last == first or total + len(held[last]) // 4 <= IDS_AT_ONCE):
                    total += len(held[last]) // 4
                    last += 1
                n = np.array([len(x) // 4 for x in held[first:last]], dtype=np.int64)
                control, data, nc, nd = compress(rank[np.frombuffer(b"".join(held[first:last]), dtype="<u4")], n, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[first:last], pa.int64()), pa.array(n), _binary(control, nc), _binary(data, nd), b.column(2).slice(first, last - first)],
                    names=["doc_id", "n", "control", "data", "part"])
                first = last

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, shard, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        files, root = _filesystem(folder)

        def flush() -> None:
            nonlocal start, shard, held, size
            doc = np.array([d or 0 for d, *_ in held], dtype="<i8")
            null = np.array([d is None for d, *_ in held], dtype=np.uint8)
            n = np.array([x[1] for x in held], dtype="<u8")
            control, data = b"".join(x[2] for x in held), b"".join(x[3] for x in held)
            name = f"{root}/{part:06d}-{shard:06d}.tok"
            own = f"{root}/.{part:06d}-{shard:06d}-{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write(struct.pack(HEAD, MAGIC, part, start, len(held), size, bits, len(control), len(data)))
                for x in (doc.tobytes(), null.tobytes(), n.tobytes(), control, data):
                    f.write(x)
            files.move(own, name)
            start, shard, held, size = start + size, shard + 1, [], 0

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append(row)
                size += row[1]
                if size >= SHARD_IDS:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([start], pa.int64())], names=["part", "ids"])

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    tops = range_tops(encoded, "doc_id", int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = encoded.withColumn("part", range_of(F.col("doc_id"), tops)).mapInArrow(shrink, "doc_id long, n long, control binary, data binary, part int")
    (small.repartitionById(max(1, len(tops)), "part").drop("part").sortWithinPartitions("doc_id", "n", "data")
     .mapInArrow(save, "part long, ids long").count())


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value per size, in a row from ``flat`` (of under 2 GB)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def read_files(spark, folder: str, ids: np.ndarray, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, unsigned 32-bit) of every document in the files of a folder."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [struct.unpack_from(HEAD, c) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                                             names=["part", "ids"])

    # one row a range
    sizes = {r["part"]: r["n"] for r in files.select(F.substring("content", 1, HEAD_BYTES).alias("content"))
             .mapInArrow(heads, "part long, ids long").groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _documents(b.column(0)[i].as_buffer(), before, shared.value, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.select("content").mapInArrow(decode, schema)


def _documents(content, before: dict[int, int], ids: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    magic, part, start, docs, total, bits, n_control, n_data = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD_BYTES
    doc = np.frombuffer(content, "<i8", docs, at)
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs).astype(bool)
    n = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    flat = expand(np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control), n, bits, ids)
    flat = flat.astype("<u4")
    ends = np.cumsum(n)
    first = 0
    while first < docs:  # a batch holds about IDS_AT_ONCE ids
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + IDS_AT_ONCE)))
        own = [flat[e - k:e].tobytes() for e, k in zip(ends[first:last].tolist(), n[first:last].tolist())]
        arrays = [pa.array(doc[first:last], mask=null[first:last]), pa.array(before[part] + start + ends[first:last] - n[first:last]),
                  pa.array(n[first:last]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(own, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)
        first = last


def tokenize_to_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, spaces: bool = True) -> tuple[str, np.ndarray]:
    """Encode all documents, rank the ids by their count in the corpus, write the files; returns the folder and the ranks.

    A null text is empty (its document is the end id); null doc_ids come first and stay null; repeated rows are written
    each for itself; an empty table gives no files.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    encoded = stored(encode_documents(docs, tokenizer, end_id, spaces), "ids")
    ids = ranked(id_counts(encoded))
    folder = folder or shared_path(spark, "token-files")
    write_files(encoded, folder, ids)
    return folder, ids
