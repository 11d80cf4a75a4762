"""Training-order files: every sequence gets a slot of a keyed permutation.

A sequence is a fixed number of token ids of a document; the last one of a document ends with
the end id and is filled with the padding id. Sequences are numbered 0 to N - 1 in one
order: one light pass counts them per partition of the input, and a second, over the same
partitions, numbers each row from the partition's offset. A keyed Feistel network over the
next power of four permutes the numbers; results of N or more are walked on until they fall
below N, which makes the whole a permutation of 0 to N - 1 without any table or sort of keys.

Slots are cut into ranges of ``shard_records``. Each range is one partition and one file of
records with a fixed stride, in slot order: record k of file f is slot f * shard_records + k
at byte k * stride. A reader at slot s seeks to one offset and reads on. Files are committed
by Spark's own writer, so a lost executor or a repeated task leaves no half file. On their
way to the partitions the records travel in compressed blocks, one per task, batch and range.

The numbers rely on the input's partitions being the same in all passes. How files are split
depends on the cores at planning time, so the input is planned once (``pinned``) and every pass
runs over that plan's partitions; pass ``settled(df)`` for an input that a shuffle orders. Each
pass checks that its partitions hold the counted sequences, and each range that it has every
slot once; a job that finds otherwise fails.

Ids are those of a public vocabulary, in two bytes if they fit, else four, little-endian, or the
bytes of the text themselves; the end and the padding id follow the last id. A text is encoded once,
into a table of the shared folder that all passes read. ``_manifest.json`` beside the files says how
records are stored, how many there are and under which key, so ``read_order`` needs the folder only.

Null and empty texts are one sequence with only the end id. Repeated rows and rows with NULL
ids each have their sequences. An empty table gives no records and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import ship, work_path
from shelfwise.llm.tokens import encoder, ranked_encoder, slices, splits_on_space, version_digest

#: The byte vocabulary: ids 0 to 253 are the bytes that UTF-8 can hold, then these two.
END, PADDING = 0xFE, 0xFF
RECORD_IDS = 512
SHARD_BYTES = 8 << 20
ROUNDS = 8


def _round_keys(key: bytes, rounds: int) -> list[int]:
    """One 64-bit key a round."""
    return [
        struct.unpack("<Q", hashlib.sha256(key + bytes([r])).digest()[:8])[0] for r in range(rounds)
    ]


def feistel(numbers: np.ndarray, total: int, key: bytes, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of these numbers under the key's permutation of 0 to total - 1."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in _round_keys(key, rounds)]

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(half), values & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        slots = once(np.asarray(numbers, np.uint64))
        while (walking := slots >= np.uint64(total)).any():
            slots[walking] = once(slots[walking])
    return slots.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Ids a record, bytes an id, the end and the padding id."""

    ids: int = RECORD_IDS
    width: int = 1
    end: int = END
    padding: int = PADDING

    @property
    def stride(self) -> int:
        """Bytes a record."""
        return self.ids * self.width

    def records(self, body: bytes) -> bytes:
        """The ids given as bytes and the end id, padded to whole records."""
        body += self.end.to_bytes(self.width, "little")
        missing = -len(body) % self.stride // self.width
        return body + self.padding.to_bytes(self.width, "little") * missing


def byte_records(text: bytes, ids: int = RECORD_IDS) -> bytes:
    """The text's byte ids and the end id, padded to whole records."""
    return Layout(ids).records(text)


def vocabulary_layout(vocabulary: str, ids: int = RECORD_IDS) -> Layout:
    """The layout of a vocabulary's ids; the end and padding ids are the next two."""
    size = len(encoder(vocabulary).names)
    return Layout(ids, 2 if size + 2 <= 1 << 16 else 4, size, size + 1)


def token_bodies(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, width: int) -> DataFrame:
    """(id, body): every text's ids as bytes, as a table of the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = not splits_on_space(vocabulary)
        coder = encoder(vocabulary) if whole else ranked_encoder(vocabulary)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("body").cast(pa.binary())]
            bodies = []
            for low, high in slices(texts):
                if whole:
                    ids = [coder.library.encode(t.decode(), add_special_tokens=False).ids for t in texts[low:high]]
                    bodies += [np.array(x, f"<u{width}").tobytes() for x in ids]
                    continue
                split = [t.split() for t in texts[low:high]]
                ids_of = coder.table(set().union(*split)).__getitem__
                joined = (b"".join(map(ids_of, words)) for words in split)
                bodies += [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in joined]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(bodies, pa.binary())], names=["id", "body"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    made = rows.mapInArrow(encoded, f"id {kind}, body binary")
    path = work_path(spark, "token_ids")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """The frame with its physical plan and partitions fixed now, for every later action."""
    session = df.sparkSession
    fixed = df._jdf.queryExecution().toRdd()
    fixed.getNumPartitions()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(fixed, df._jdf.schema(), False), session)


def _begin(offsets: dict[int, int], total: int) -> tuple[int, int]:
    """The first sequence number of this task's partition and of the next one; equal if it has no rows."""
    part = TaskContext.get().partitionId()
    if part not in offsets:
        return 0, 0
    return offsets[part], min((x for x in offsets.values() if x > offsets[part]), default=total)


def _check_end(number: int, end: int) -> None:
    if number != end:
        raise RuntimeError(f"the input changed between passes: at sequence {number}, counted to {end}")


def _blocks(
    batches: Iterator[pa.RecordBatch],
    offsets: dict[int, int],
    total: int,
    per_shard: int,
    key: bytes,
    layout: Layout,
) -> Iterator[pa.RecordBatch]:
    """(shard, slots, packed): a batch's records of each range, compressed together."""
    import zstandard

    pack = zstandard.ZstdCompressor(6)
    number, end = _begin(offsets, total)
    for batch in batches:
        records = b"".join(layout.records(x.as_py() or b"") for x in batch.column("body").cast(pa.binary()))
        rows = np.frombuffer(records, np.uint8).reshape(-1, layout.stride)
        slots = feistel(np.arange(number, number + len(rows)), total, key)
        number += len(rows)
        order = np.argsort(slots)
        slots, rows = slots[order], rows[order]
        shards = slots // per_shard
        cuts = np.flatnonzero(np.r_[True, np.diff(shards) > 0, True]) if len(shards) else [0]
        out = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            out[0].append(int(shards[a]))
            out[1].append((slots[a:b] % per_shard).astype("<u4").tobytes())
            out[2].append(pack.compress(rows[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
            names=["shard", "slots", "packed"],
        )
    _check_end(number, end)


def _ordered(
    batches: Iterator[pa.RecordBatch], stride: int, total: int, per_shard: int
) -> Iterator[pa.RecordBatch]:
    """The whole range of one partition as one value, records in slot order."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    slots, rows = [], []
    for batch in batches:
        for place, packed in zip(batch.column("slots"), batch.column("packed")):
            slots.append(np.frombuffer(place.as_py(), "<u4"))
            rows.append(np.frombuffer(unpack.decompress(packed.as_py()), np.uint8).reshape(-1, stride))
    expected = min(per_shard, total - TaskContext.get().partitionId() * per_shard)
    at = np.concatenate(slots) if slots else np.zeros(0, np.uint32)
    if len(at) != expected or (np.bincount(at, minlength=expected) != 1).any():
        raise RuntimeError(f"a range of {expected} slots holds {len(at)} records or one slot twice")
    if slots:
        whole = np.empty((len(at), stride), np.uint8)
        whole[at] = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["value"])


def number_sequences(
    docs: DataFrame, text_col: str = "text", record_bytes: int = RECORD_IDS
) -> tuple[dict[int, int], int]:
    """(the first sequence number of each partition, number of sequences).

    Collects one row a partition.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    counted = docs.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(F.floor(size / record_bytes) + 1).alias("n")
    )
    offsets, total = {}, 0
    for row in sorted(counted.collect()):
        offsets[row["part"]] = total
        total += row["n"]
    return offsets, total


def write_training_order(
    docs: DataFrame,
    path: str,
    numbering: tuple[dict[int, int], int],
    key: bytes = b"epoch-0",
    text_col: str = "text",
    record_ids: int = RECORD_IDS,
    shard_bytes: int = SHARD_BYTES,
    layout: Layout | None = None,
) -> int:
    """Writes the files under ``path``; returns how many records a file has.

    ``layout`` is that of the ids in the text column, else they are bytes, ``record_ids`` a record.

    ``numbering`` is what ``number_sequences`` gave for these rows; both need the same ``pinned``
    frame, unless its partitions cannot change. Each file is one range:
    its records, then one line feed as the end mark.
    """
    ship(docs.sparkSession)
    body = docs.select(F.col(text_col).alias("body"))
    offsets, total = numbering
    layout = layout or Layout(record_ids)
    stride = layout.stride
    per_shard = max(1, shard_bytes // stride)
    if not total:
        return per_shard
    blocks = body.mapInArrow(
        lambda batches: _blocks(batches, offsets, total, per_shard, key, layout),
        "shard int, slots binary, packed binary",
    )
    dealt = blocks.repartitionById(-(-total // per_shard), "shard").select("slots", "packed")
    whole = dealt.mapInArrow(lambda batches: _ordered(batches, stride, total, per_shard), "value binary")
    whole.select(F.col("value").cast("string")).write.mode("overwrite").text(path)
    return per_shard


def read_records(
    spark: SparkSession, path: str, per_shard: int, record_bytes: int = RECORD_IDS, first_slot: int = 0
) -> DataFrame:
    """(slot, ids) of every record from a slot on; only the files from its file on are read."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"part-(\d+)-", 1).cast("int")
    later = files.select(name.alias("shard"), "path", "content").where(
        F.col("shard") >= first_slot // per_shard
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard"), batch.column("content")):
                base, content = shard.as_py() * per_shard, content.as_py()
                n = len(content) // record_bytes
                for low in range(0, n, 4096):
                    at = range(low, min(low + 4096, n))
                    got = [content[k * record_bytes : (k + 1) * record_bytes] for k in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + k for k in at], pa.int64()), pa.array(got, pa.binary())],
                        names=["slot", "ids"],
                    )

    found = later.select("shard", "content").mapInArrow(records, "slot bigint, ids binary")
    return found.where(F.col("slot") >= first_slot)


def _manifest(spark: SparkSession, path: str):
    """The manifest's place and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_manifest.json")
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_manifest(spark: SparkSession, path: str, **facts: object) -> None:
    """Says beside the files how they are to be read."""
    place, files = _manifest(spark, path)
    out = files.create(place, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    place, files = _manifest(spark, path)
    stream = files.open(place)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def read_order(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """(slot, ids) of every record from a slot on, ids as bytes, by the folder's manifest."""
    facts = read_manifest(spark, path)
    if not facts["sequences"]:
        return spark.createDataFrame([], "slot bigint, ids binary")
    return read_records(spark, path, facts["records_a_file"], facts["record_ids"] * facts["id_bytes"], first_slot)


def sequence_slots(
    docs: DataFrame,
    path: str | None = None,
    key: bytes = b"epoch-0",
    id_col: str = "doc_id",
    text_col: str = "text",
    record_ids: int = RECORD_IDS,
    shard_bytes: int = SHARD_BYTES,
    vocabulary: str | None = None,
) -> DataFrame:
    """Writes the files and returns (id, piece, slot, shard, byte_offset, n_ids) a sequence.

    Ids are those of the public vocabulary, or bytes without one.

    The rows follow from the input by the same numbering as the files' records.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "training_order")
    if vocabulary is None:
        layout = Layout(record_ids)
        free = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    else:
        layout = vocabulary_layout(vocabulary, record_ids)
        free = token_bodies(docs, id_col, text_col, vocabulary, layout.width)
    stride, width = layout.stride, layout.width
    body = pinned(free)
    offsets, total = numbering = number_sequences(body, "body", stride)
    # The whole input, counted apart from how the pinned plan splits it.
    counted = number_sequences(free, "body", stride)[1]
    if counted != total:
        raise RuntimeError(f"the pinned input has {total} sequences, the input {counted}")
    per_shard = write_training_order(body, path, numbering, key, "body", record_ids, shard_bytes, layout)
    write_manifest(
        spark, path, record_ids=layout.ids, id_bytes=width, end_id=layout.end, padding_id=layout.padding,
        records_a_file=per_shard, sequences=total, key=key.hex(), rounds=ROUNDS, vocabulary=vocabulary,
        vocabulary_sha256=version_digest(vocabulary) if vocabulary else None,
    )
    kind = dict(docs.dtypes)[id_col]
    sized = body.select("id", F.floor(F.coalesce(F.octet_length("body"), F.lit(0)) / width).alias("size"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, end = _begin(offsets, total)
        for batch in batches:
            sizes = np.asarray(batch.column("size"), np.int64)
            counts = sizes // record_ids + 1
            doc = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            slots = feistel(np.arange(number, number + len(doc)), total, key)
            number += len(doc)
            held = np.minimum(sizes[doc] + 1 - piece * record_ids, record_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(doc)),
                    *map(pa.array, (piece, slots, slots // per_shard)),
                    *map(pa.array, (slots % per_shard * stride, held)),
                ],
                names=["id", "piece", "slot", "shard", "byte_offset", "n_ids"],
            )
        _check_end(number, end)

    rows = sized.mapInArrow(
        numbered,
        f"id {kind}, piece bigint, slot bigint, shard bigint, byte_offset bigint, n_ids bigint",
    )
    return rows.withColumnRenamed("id", id_col)
