"""Token ids as byte-aligned variable-length numbers.

Format: a folder of Parquet files whose rows are blocks. A block holds the whole documents from one
range of doc_id, in order; blocks are ordered by (shard, block). Each id is replaced by its rank
by frequency over all documents (the most frequent id has rank 0), and a rank is written in the one
to four bytes that it needs. The two bits that say how many are kept apart: control has a byte for
four ranks, data has the bytes. The rank table lies beside the blocks, in ranks.
A block has as many documents as come to block_tokens ids, one at least.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare, scratch
from codelode.llm.pieces import blocks, worker_table

BLOCK = "shard int, block int, n_tokens long, doc_ids array<long>, doc_tokens array<int>, control binary, data binary"

#: Ids of a shard at most on average, and at least where there are fewer shards than shuffle partitions.
SHARD_IDS, LEAST_IDS = 1 << 26, 1 << 20

#: By control byte: the bytes of each of its four numbers.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    width = 2 if not len(values) or values.max() < 1 << 16 else 4  # no number needs more bytes
    v = np.ascontiguousarray(values, f"<u{width}")
    full = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code = full[: len(v)]
    np.add(code, v > 0xFF, out=code, casting="unsafe")
    used = np.ones((len(v), width), bool)
    used[:, 1] = v > 0xFF
    if width == 4:
        for k, least in ((2, 0xFFFF), (3, 0xFFFFFF)):
            used[:, k] = v > least
            code += used[:, k]
    control = full[0::4] | full[1::4] << 2 | full[2::4] << 4 | full[3::4] << 6
    return control.tobytes(), v.view(np.uint8)[used.reshape(-1)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that pack() wrote."""
    lens = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lens, dtype=np.int64) - lens
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype("<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype("<u4") << (8 * k)
    return out


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 0, block_tokens: int = 1 << 20) -> None:
    """Encode every whole text, append end_id to each, and write the format to the folder out.

    Null texts are empty and hold end_id alone. Rows are ordered by doc_id, nulls first, rows that
    share one by a hash of their ids; repeated rows are all written. Shards are ranges of that order, so
    the rows of one doc_id, or those without any, may fill many. Other columns are ignored. Of an
    empty table the folder has no blocks and no ranks.
    """
    spark = prepare(docs.sparkSession)
    # until they are ranked, ids are held in two bytes where all of them fit
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    plain_type = "<u2" if most < 1 << 16 else "<u4"

    def run(batches):
        """A row per document, and last one that says in met how often each id was met."""
        table, task, seq = worker_table(path, "library"), TaskContext.get().partitionId(), 0
        met = np.zeros(most + 1, np.int64)
        for part, texts in blocks(batches):
            ids, n = table.encode(texts)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id).astype(plain_type)
            met += np.bincount(ids, minlength=most + 1)
            offsets = np.concatenate([[0], (ends + np.arange(1, len(n) + 1)) * ids.itemsize]).astype(np.int32)
            raw = ids.tobytes()
            tie = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)
            own = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            place = (task << 40) + seq + np.arange(len(n))
            seq += len(n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tie), pa.array(place), own, pa.nulls(len(n), pa.binary())], _SCRATCH_NAMES)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([met.astype("<i8").tobytes()], pa.binary())], _SCRATCH_NAMES)

    as_text(docs).mapInArrow(run, SCRATCH).write.option("compression", "zstd").parquet(plain := scratch(spark, "ids"))
    stored = spark.read.schema(SCRATCH).parquet(plain)

    def count(batches):
        total = np.zeros(most + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    # one row per id of the vocabulary: bounded, whatever the input
    counts = stored.select("met").where("met is not null").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)
    ranked.select("rank", "id", "n").coalesce(1).write.parquet(f"{out}/ranks")
    table = spark.read.parquet(f"{out}/ranks").select("rank", "id", "n").toPandas()
    rank_of = np.zeros(most + 1, "<u4")
    rank_of[table["id"]] = table["rank"]
    to_rank = spark.sparkContext.broadcast(rank_of)
    total = int(table["n"].sum())
    shards = max(total // SHARD_IDS, min(total // LEAST_IDS, int(spark.conf.get("spark.sql.shuffle.partitions")))) + 1

    def write(batches):
        ranks, shard, block = to_rank.value, TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, block
            docs_, lens = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]).astype(np.int32)
            control, data = pack(ranks[np.concatenate([x[2] for x in held])])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size]), one(docs_), one(pa.array(lens)), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            held, size, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            column = batch.column(1)
            n = np.asarray(pc.binary_length(column)).astype(np.int64) // np.dtype(plain_type).itemsize
            flat, ends, at = np.frombuffer(_bytes(column), plain_type), np.cumsum(n), 0
            while at < len(n):
                before = int(ends[at - 1]) if at else 0
                end = int(np.searchsorted(ends, before + block_tokens - size, side="right"))
                if end <= at:
                    if held:
                        yield flush()
                        continue
                    end = at + 1
                held.append((batch.column(0).slice(at, end - at), n[at:end], flat[before : ends[end - 1]]))
                size += int(ends[end - 1]) - before
                at = end
        if held:
            yield flush()

    key = ["doc_id", "tie", "place"]
    ordered = stored.where("met is null").select(*key, "ids").repartitionByRange(shards, *key).sortWithinPartitions(*key)
    ordered.select("doc_id", "ids").mapInArrow(write, BLOCK).write.parquet(f"{out}/blocks")


SCRATCH = "doc_id long, tie long, place long, ids binary, met binary"
_SCRATCH_NAMES = [x.split()[0] for x in SCRATCH.split(", ")]
def _bytes(column: pa.Array) -> memoryview:
    """The bytes of all values of a binary column, end to end."""
    if not len(column):
        return memoryview(b"")
    width = pa.types.is_large_binary(column.type) and np.int64 or np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[at[0] : at[-1]] if column.buffers()[2] is not None else memoryview(b"")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document, read from the files in out."""
    return _read(spark, out, False)


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files in out.

    start counts the ids of all documents before it; ids_crc32 is taken over its ids as little-endian
    unsigned 32-bit numbers, the end id included.
    """
    return _read(spark, out, True)


def _read(spark: SparkSession, out: str, digests: bool) -> DataFrame:
    prepare(spark)
    table = spark.read.schema("rank int, id int, n long").parquet(f"{out}/ranks").select("rank", "id").toPandas()
    id_of = np.zeros(max(len(table), 1), "<u4")
    id_of[table["rank"]] = table["id"]
    ids_of = spark.sparkContext.broadcast(id_of)
    stored = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    # a row per block: what stands before each block, by its shard's blocks and the shards before
    sizes = stored.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "base")
    before = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = sizes.withColumn("within", before).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("at"))

    names = "ids_crc32" if digests else "ids"

    def run(batches):
        ids_of_rank = ids_of.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, n_tokens, doc_ids, doc_tokens, control, data = (batch.column(k)[i] for k in range(7))
                ids = ids_of_rank[unpack(control.as_buffer(), data.as_buffer(), n_tokens.as_py())]
                n = np.asarray(doc_tokens.values).astype(np.int64)
                ends = np.cumsum(n)
                if digests:
                    raw = memoryview(ids).cast("B")
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                k = len(n)
                place = [pa.array(np.full(k, x.as_py(), np.int32)) for x in (shard, block)]
                yield pa.RecordBatch.from_arrays([*place, doc_ids.values, pa.array(ends - n), pa.array(n), last], ["shard", "block", "doc_id", "start", "n_tokens", names])

    found = stored.select("shard", "block", "n_tokens", "doc_ids", "doc_tokens", "control", "data")
    # documents are given their place in the block first, so that only (shard, block) has to be joined
    by_doc = found.mapInArrow(run, f"shard int, block int, doc_id long, start long, n_tokens long, {names} {'long' if digests else 'array<int>'}")
    return by_doc.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", names)
