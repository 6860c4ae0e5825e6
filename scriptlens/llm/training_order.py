"""Op 7, training-order materialisation into token-id shards.

Texts are tokenised, closed with an end id and laid end to end within their scan
partition; every ``stride`` ids are one sequence (a partition's last one is
filled up with the pad id and says its true length). Sequences are written once
and numbered by file and row, so their numbers need no shuffle and stay the same
when a task is repeated. A keyed Feistel permutation with cycle-walking turns a
number into its global slot: a bijection of [0, N) that any reader can compute
for any slot, without a table. Slots are cut into ranges of ``shard_rows``; one
shuffle brings each range together and its task writes the shard as fixed-stride
records in slot order, so slot s is at byte (s mod shard_rows) * record size of
shard s // shard_rows: a reader resumes at any slot by seeking.

Record: the true length as little-endian unsigned 32-bit, then ``stride``
little-endian unsigned 16-bit ids. A shard is written under a temporary name and
renamed, so a repeated task replaces it with the same bytes.

Defined results: null text is the end id alone; repeated rows are each written;
an empty table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import stored
from scriptlens.llm.tokens import shared_encoder, tokenizer_path
from scriptlens.session import new_table_path

STRIDE = 2048
SHARD_ROWS = 4096           # 16 MB a shard; raise it with the corpus
KEY = 0x5EED_F00D
ROUNDS = 4
PAD = 0


# --- keyed permutation ---------------------------------------------------------

def round_value(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F491 + r * 0x9E3779B9) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def once(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (round_value(left, key, r) & mask), left
        else:
            left, right = right, left ^ (round_value(right, key, r) & mask)
    return (left << np.uint64(bits)) | right


def walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    """Apply the permutation until every value is below ``n`` again."""
    bits = half_bits(n)
    out = once(np.asarray(x, dtype=np.uint64), bits, key, back)
    while (high := out >= n).any():
        out[high] = once(out[high], bits, key, back)
    return out.astype(np.int64)


def slot_of(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    return walk(number, n, key, False)


def number_of(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    return walk(slot, n, key, True)


# --- sequences ------------------------------------------------------------------

def sequences(docs: DataFrame, path: str | None = None, stride: int = STRIDE, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``length, ids`` (compressed) and the documents in the sequence, in order,
    written once; ``first_start`` is the first document's ids before it."""
    path = path or tokenizer_path()
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, press = shared_encoder(path), zstandard.ZstdCompressor(level=3)
        rest = np.zeros(0, np.uint16)
        open_docs: list = []        # documents with ids in ``rest``: (id, ids before)
        kind = None

        def rows(flat: np.ndarray, marks: list, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray, list]:
            """Cut whole sequences; marks: (offset in flat, id, ids before)."""
            whole = len(flat) // stride if not last else -(-len(flat) // stride)
            ids, docs_in, first, lengths, k = [], [], [], [], 0
            for s in range(whole):
                a, z = s * stride, min((s + 1) * stride, len(flat))
                while k + 1 < len(marks) and marks[k + 1][0] <= a:
                    k += 1
                j = k
                while j + 1 < len(marks) and marks[j + 1][0] < z:
                    j += 1
                docs_in.append([m[1] for m in marks[k:j + 1]])
                first.append(marks[k][2] + a - marks[k][0])
                lengths.append(z - a)
                ids.append(press.compress(flat[a:z].tobytes()))
            cut = min(whole * stride, len(flat))
            left = flat[cut:]
            while len(marks) > 1 and marks[1][0] <= cut:
                marks = marks[1:]
            marks = [(max(0, m[0] - cut), m[1], m[2] + max(0, cut - m[0])) for m in marks] if len(left) else []
            if not ids:
                return None, left, marks
            return pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array(ids, pa.binary()), pa.array(docs_in, pa.list_(kind)),
                 pa.array(first, pa.int64())], names=["length", "ids", "docs", "first_start"]), left, marks

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                flat, ends = encoder.encode(part.column(1).to_pylist())
                starts = np.concatenate([[0], ends[:-1]]) + len(rest)
                if len(flat) and flat.max() > 0xFFFF:
                    raise ValueError("the records hold 16-bit ids; this tokenizer has larger ones")
                marks = open_docs + [(int(a), i, 0) for a, i in zip(starts, part.column(0).to_pylist())]
                found, rest, open_docs = rows(np.concatenate([rest, flat.astype(np.uint16)]), marks, False)
                if found:
                    yield found
        if len(rest):
            yield rows(rest, open_docs, True)[0]

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return stored(picked.mapInArrow(
        run, f"length int, ids binary, docs array<{id_type.simpleString()}>, first_start bigint"), "sequences")


def numbered_slots(table: DataFrame, n: int, key: int = KEY) -> DataFrame:
    """``number`` (by file and row of the written table) and ``slot``."""
    placed = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = {r["file"]: r["n"] for r in placed.groupBy("file").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for f in sorted(sizes):         # one entry per written file
        starts.append((f, before))
        before += sizes[f]
    # one short row per written file, held by the tasks: no shuffle of sequences
    shared = table.sparkSession.sparkContext.broadcast(dict(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([shared.value[f] for f in batch.column("file").to_pylist()], dtype=np.int64)
            number = start + batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in table_columns], pa.array(number), pa.array(slot_of(number, n, key))],
                names=[*table_columns, "number", "slot"])

    table_columns = table.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return placed.mapInArrow(run, fields + ", number bigint, slot bigint")


def materialise(docs: DataFrame, path: str | None = None, stride: int = STRIDE, shard_rows: int = SHARD_ROWS,
                key: int = KEY, out_dir: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write the shards; one row per sequence with its place and checksum."""
    spark = docs.sparkSession
    table = sequences(docs, path, stride, id_col, text_col)
    n = table.count()
    if n > 2**62:
        raise ValueError("too many sequences")
    out_dir = out_dir or new_table_path(spark, "token-shards")
    slots = numbered_slots(table, n, key).withColumn("shard", F.floor(F.col("slot") / shard_rows))
    record = 4 + 2 * stride
    schema = ("slot bigint, number bigint, shard bigint, byte_offset bigint, length int, ids_crc32 bigint, "
              f"first_start bigint, docs array<{docs.schema[id_col].dataType.simpleString()}>")

    def write(block: pa.Table) -> pa.Table:
        import zstandard
        from pyarrow import fs

        block = block.sort_by("slot")
        unpress = zstandard.ZstdDecompressor()
        shard = block.column("shard")[0].as_py()
        where, root = fs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:")
                                             else f"file://{out_dir}")
        where.create_dir(root, recursive=True)
        draft, final = f"{root}/_draft-{shard:08d}-{uuid.uuid4().hex}", f"{root}/shard-{shard:08d}.bin"
        sums = []
        with where.open_output_stream(draft) as sink:
            for length, packed in zip(block.column("length").to_pylist(), block.column("ids").to_pylist()):
                raw = unpress.decompress(packed)
                sums.append(zlib.crc32(raw))
                sink.write(length.to_bytes(4, "little") + raw + b"\0" * (2 * stride - len(raw)))
        where.move(draft, final)
        slot = block.column("slot").to_numpy()
        return pa.table({
            "slot": block.column("slot"), "number": block.column("number"), "shard": block.column("shard"),
            "byte_offset": pa.array((slot - shard * shard_rows) * record), "length": block.column("length"),
            "ids_crc32": pa.array(sums, pa.int64()), "first_start": block.column("first_start"),
            "docs": block.column("docs")})

    return slots.groupBy("shard").applyInArrow(write, schema)


def read_slots(out_dir: str, first: int, count: int, stride: int = STRIDE,
               shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """Ids of ``count`` consecutive slots from ``first`` on: a resumed reader."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:")
                                         else f"file://{out_dir}")
    record = 4 + 2 * stride
    slot = first
    while slot < first + count:
        shard, row = divmod(slot, shard_rows)
        take = min(shard_rows - row, first + count - slot)
        with where.open_input_file(f"{root}/shard-{shard:08d}.bin") as source:
            source.seek(row * record)
            for _ in range(take):
                raw = source.read(record)
                if len(raw) < record:
                    return
                yield np.frombuffer(raw, dtype="<u2", offset=4)[:int.from_bytes(raw[:4], "little")]
        slot += take
