"""Packing documents into fixed-length sequences by shortest-pack-first over their lengths.

Three passes, none of which holds rows together:

1. Every document becomes token ids, closed by ``END``, and is cut at multiples of the capacity.
   Its pieces (place, length, checksum, no ids) go to a table in the shared folder with the
   number of the task that wrote them and their rank among that task's pieces of equal length. The
   table pins both, so a lost executor cannot renumber anything.
2. The pieces are counted by length and task. The histogram, one row a length, is planned by
   ``pack_plan`` on the driver; the counts of earlier tasks turn a rank within a task
   into the rank among all pieces of that length.
3. The plan, under 400,000 entries for 2,048 tokens however many documents there are, is broadcast. Each
   piece finds its pack by its length and rank. A length that a third of all rows share is dealt
   over tasks like any other.

Pieces of a full capacity fill a pack of their own. A text that is NULL is empty: its piece is
``END`` alone. Repeated rows and rows without an id are documents of their own; which of several
equal lengths goes where follows the task numbers, hence the files. An empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import exact_columns, ship, work_path
from shelfwise.llm.pack_plan import Group, shortest_pack_first
from shelfwise.llm.tokens import vocabulary_path

CAPACITY = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

#: What the rank file's library is not asked for: letters outside Latin, where the two libraries may
#: hold other Unicode tables, special strings, and runs so long that merging them is quadratic.
_ODD = re.compile(r"[^\x00-ɏ‐-‧€]|<\||[^\t-\r ]{400}|[\t-\r ]{400}")


class ByteEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for ``VOCABULARY``.

    The same vocabulary as ranks is four times faster, and takes the texts that both libraries
    split alike; all others go to ``tokenizers`` itself.
    """

    def __init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(VOCABULARY))
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary_path(RANKS), "rb") as file:
            pairs = (line.split() for line in file)
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, unsigned 32-bit."""
        if _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text), "<u4")


@lru_cache(maxsize=1)
def byte_encoder() -> ByteEncoder:
    """This process's encoder."""
    return ByteEncoder()


def _pieces(capacity: int):
    """A mapper from (doc_id, text) to the pieces of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = byte_encoder(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([END], "<u4")
        for batch in batches:
            rows, pieces = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([coder.ids(text.as_py() or ""), end])
                raw = memoryview(ids.tobytes())
                for low in range(0, len(ids), capacity):
                    size = min(capacity, len(ids) - low)
                    crc = zlib.crc32(raw[4 * low : 4 * (low + size)])
                    rows.append(i)
                    pieces.append((low, size, crc, len(ids), seen[size]))
                    seen[size] += 1
            if rows:
                start, length, crc, total, nth = np.array(pieces, np.int64).T
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(rows)),
                    "start": start,
                    "length": length.astype(np.int32),
                    "ids_crc32": crc,
                    "doc_tokens": total,
                    "task": np.full(len(rows), task, np.int32),
                    "nth": nth,
                }
                yield pa.RecordBatch.from_pydict(columns)

    return cut


class PackPlan:
    """For each length its slots in order: (rank of the first copy, sequence, copies, offset)."""

    def __init__(self, groups: list[Group]):
        entries: dict[int, list[tuple[int, int, int]]] = {}
        begins: dict[int, int] = {}
        slots: dict[int, list[int]] = {}
        first_sequence = 0
        for group in groups:
            offset = 0
            for length, copies in group.items:
                entries.setdefault(length, []).append((first_sequence, copies, offset))
                slots.setdefault(length, []).append(begins.get(length, 0))
                begins[length] = begins.get(length, 0) + copies * group.count
                offset += length * copies
            first_sequence += group.count
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}
        self.entries = {k: np.array(v, np.int64) for k, v in entries.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of a length with these ranks."""
        at = np.searchsorted(self.slots[length], ranks, "right") - 1
        first, copies, offset = self.entries[length][at].T
        inner = ranks - self.slots[length][at]
        return first + inner // copies, offset + inner % copies * length


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece."""
    spark = docs.sparkSession
    ship(spark)
    texts = exact_columns(docs, "doc_id", "text")
    kind = dict(texts.dtypes)["doc_id"]
    piece = f"doc_id {kind}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint"
    path = work_path(spark, "pieces")
    cut = texts.mapInArrow(_pieces(capacity), f"{piece}, task int, nth bigint")
    cut.write.parquet(path)
    pieces = spark.read.parquet(path)

    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(PackPlan(shortest_pack_first(histogram, capacity)))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = plan.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            order = np.argsort(lengths, kind="stable")
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(at):
                    sequence[at], offset[at] = packs.place(int(lengths[at[0]]), ranks[at])
            columns = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": sequence, "offset": offset})

    out = ranked.select(*names, "rank").mapInArrow(placed, f"{piece}, sequence_id bigint, offset bigint")
    return out.withColumn("length", F.col("length").cast("bigint"))
