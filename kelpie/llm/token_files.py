"""Token-id files: ids ranked by corpus frequency in a byte-aligned variable-length code.

Writing. Documents are ordered by range partitioning on doc_id, encoded, and gathered in blocks; the ids of all blocks
are counted and ranked (the vocabulary bounds that table), and each run of blocks up to FILE_TOKENS becomes one file: a header, the documents'
ids and lengths, control bytes (two bits for each token: bytes of its rank less 1, four tokens in a byte) and, apart
from them, the ranks' bytes. Frequent ids have small ranks, so most take one byte. A file's name has its place in the
order. A task writes under a name of its own and renames, so a retry or a twin leaves one whole file.

Reading. A control byte indexes a table of its four lengths; their running sum gives each rank's offset, and one
gather, masked by length, gives all ranks of the block.

Defined results. A null text is empty and still has its end id; a null doc_id comes first; rows with equal doc_id are
ordered by their text's hash. An empty table gives no file and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"KFR1"
HEAD = struct.Struct("<4sIQQ")  # magic, documents, tokens, bytes of data
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 22
SHARD_BYTES = 16 << 20
NULL_ID = np.iinfo(np.int64).min

#: Lengths of the four ranks of each control byte.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """ranks (32-bit) -> control bytes, data bytes."""
    r = ranks.astype("<u4")
    lens = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = lens - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < lens[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lens, dtype=np.int64) - lens
    padded = data + b"\0\0\0"
    every = np.ndarray((max(1, len(data)),), "<u4", padded, strides=(1,)) if data else np.zeros(1, "<u4")
    return every[at] & MASKS[lens - 1]


def block_bytes(doc_ids: np.ndarray, lens: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)) + doc_ids.astype("<i8").tobytes() + lens.astype("<i8").tobytes() + control + data


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, docs, n, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    ids = np.frombuffer(raw, "<i8", docs, at)
    lens = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    control = -(-n // 4)
    return ids, lens, unpack(raw[at : at + control], raw[at + control : at + control + size], n)


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, block_tokens: int, shards: int) -> DataFrame:
    """(part, block, doc_ids, lens, ids): blocks in ascending doc_id order."""
    # The hash parts rows that share an id, and null ids, among tasks.
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
    )

    def blocks(batches):
        enc, part, no, n = tokens.encoder(vocabulary, True), TaskContext.get().partitionId(), 0, 0
        size = np.dtype("<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4")
        keys, lens, ids = [], [], []

        def out():
            doc_ids, sizes = (np.asarray(x, "<i8").tobytes() for x in (keys, lens))
            return common.batch(part=np.array([part], "i4"), block=np.array([no], "i4"), doc_ids=[doc_ids], lens=[sizes], ids=[b"".join(ids)])

        for b in common.text_slices(batches, tokens.CHUNK):
            for key, raw in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                own = np.append(raw, np.uint32(end_id)).astype(size)
                keys.append(NULL_ID if key is None else key)
                lens.append(len(own))
                ids.append(own.tobytes())
                n += len(own)
                if n >= block_tokens:
                    yield out()
                    no, n, keys, lens, ids = no + 1, 0, [], [], []
        if keys:
            yield out()

    return ordered.mapInArrow(blocks, "part int, block int, doc_ids binary, lens binary, ids binary")


def _item(ids: bytes, lens: np.ndarray) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * int(lens.sum()) else "<u4")


def frequencies(blocks: DataFrame) -> DataFrame:
    """(id, n), summed in tasks first: at most one row for each id from a task."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids, lens in zip(b.column("ids").to_pylist(), b.column("lens").to_pylist(), strict=True):
                own = np.bincount(_item(ids, np.frombuffer(lens, "<i8")))
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), np.int64))
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield common.batch(id=found, n=total[found])

    return blocks.select("ids", "lens").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the manifest (file, start, n_docs, n_tokens)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = common.written(_encoded(docs, id_col, text_col, vocabulary, end_id, block_tokens, max(1, size // SHARD_BYTES + 1)), "token-blocks")
    ranked = [r["id"] for r in frequencies(blocks).orderBy(F.desc("n"), "id").select("id").collect()]  # bounded by the vocabulary
    folder = common.scratch_path(spark, "token-files")
    order = np.asarray(ranked, "<u4")

    _put(folder, "ranks.u4", order.tobytes())

    def store(batches):
        rank = np.zeros(int(order.max(initial=0)) + 1, "<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        held: list[tuple] = []

        def put():
            keys, lens, ranks = (np.concatenate(x) for x in zip(*(h[1:] for h in held), strict=True))
            name = f"{held[0][0][0]:08d}-{held[0][0][1]:06d}.kfr"
            _put(folder, name, block_bytes(keys, lens, ranks))
            return common.batch(file=[name], n_docs=[len(keys)], n_tokens=[len(ranks)])

        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())  # a row is a block
        for r in rows:
            part, no, doc_ids, lens, ids = r["part"], r["block"], r["doc_ids"], r["lens"], r["ids"]
            keys, lens = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lens, "<i8")
            # Only neighbours in the order share a file.
            if held and (held[-1][0] != (part, no - 1) or sum(len(h[3]) for h in held) >= FILE_TOKENS):
                yield put()
                held.clear()
            held.append(((part, no), keys, lens, rank[_item(ids, lens)]))
        if held:
            yield put()

    manifest = common.written(blocks.mapInArrow(store, "file string, n_docs bigint, n_tokens bigint"), "token-manifest")
    common.forget(blocks)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return folder, manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _put(folder: str, name: str, raw: bytes) -> None:
    """Writes a file under a name of its own, then renames it."""
    import uuid

    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    there.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with there.open_output_stream(own) as f:
        f.write(raw)
    there.move(own, f"{path}/{name}")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ranks = spark.read.format("binaryFile").option("pathGlobFilter", "ranks.u4").load(folder).select("content").first()
    order = np.frombuffer(bytes(ranks[0]) if ranks else b"", "<u4")  # an empty file isn't read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kfr").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "start"), "file")

    def decode(batches):
        for b in batches:
            for i, start in enumerate(b.column("start").to_pylist()):
                keys, lens, ranks = read_block(b.column("content")[i].as_py())
                ids, ends = order[ranks], np.cumsum(lens)
                firsts = ends - lens
                view = memoryview(ids).cast("B")
                crc = np.array([zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(firsts.tolist(), ends.tolist(), strict=True)], np.int64)
                yield common.batch(doc_id=pa.array(keys, mask=keys == NULL_ID), start=firsts + start, n_tokens=lens, ids_crc32=crc)

    return named.select("content", "start").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_frequency_coded_tokens(spark, sf_dir: str) -> DataFrame:
    folder, manifest = write(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, folder, manifest)
