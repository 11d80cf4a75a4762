"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the bytes sets the cuts, so equal passages get equal chunks wherever they
stand. A chunk that occurs more than once in the corpus is encoded for its first occurrence
only and handed to the others; a chunk that occurs once is encoded in its document's task.
Cuts may fall inside a word, so each joint is repaired: the words around the cut are encoded
again, in a window that widens until the ids of its outermost words agree with the chunks' own
on both sides. From there on outwards the ids are the library's, because no token of these
vocabularies spans white space.

Plan: the chunks' digests are counted without the texts; then the compressed texts are dealt
by row in one exchange, which both joins by row read. Shuffled besides are the ids of shared
chunks. Cuts follow from a text, so they are set anew where they are needed. A passage in a
third of all documents is one digest: its count is combined map-side, and the join that hands
out its ids is on the side that Spark can split.

Null texts count as empty and have no tokens; repeated rows each get their result; extra
columns are ignored. A text without a cut, however long, is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import same_row, settled, ship
from shelfwise.llm.tokens import WordEncoder, encoder, slices, splits_on_space

WINDOW = 32
#: One position in so many ends a chunk.
CHUNK_BYTES = 1024
SPACES = b" \t\n\r\x0b\x0c"
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


#: A fixed 32-bit value for each byte.
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)


def cut_points(text: bytes, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Offsets at which chunks end, the text's end last; they depend on nearby bytes only.

    The hash at a byte is the sum of the values of the ``WINDOW`` bytes up to it, each shifted
    by its distance, modulo 2^32; the window doubles in five steps over the whole text. A
    chunk ends where the hash is below 2^32 / ``chunk_bytes``. Offsets within a character
    move to its end.
    """
    n = len(text)
    if n <= WINDOW:
        return np.array([n] if n else [], np.int64)
    raw = np.frombuffer(text, np.uint8)
    rolled = _GEAR[raw]
    for reach in (1, 2, 4, 8, 16):
        rolled[reach:] += rolled[:-reach] << np.uint32(reach)
    hits = np.flatnonzero(rolled[WINDOW - 1 :] < np.uint32(2**32 // chunk_bytes)) + WINDOW
    inside = np.append((raw & 0xC0) == 0x80, False)
    while len(hits) and inside[hits].any():
        hits = np.where(inside[hits], hits + 1, hits)
    hits = np.unique(hits)
    return np.append(hits[hits < n], n)


def chunk_ids(chunk: bytes, table: dict[bytes, bytes]) -> tuple[bytes, np.ndarray]:
    """A chunk's ids (32-bit, as bytes) and the number of ids of each of its words."""
    parts = [table[w] for w in chunk.split()]
    return b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2


def repaired(
    text: bytes, cuts: np.ndarray, coded: list[tuple[bytes, np.ndarray]], own: WordEncoder
) -> bytes:
    """The ids of the whole text from the ids of its chunks.

    A cut with white space on a side needs no repair. Otherwise the word that it splits, which
    may span whole chunks, is encoded with its neighbour words on both sides.
    """
    starts = np.concatenate(([0], cuts[:-1])).astype(np.int64)
    split = [
        i + 1 < len(cuts)
        and not _SPACE[text[cuts[i] - 1]]
        and not _SPACE[text[cuts[i]]]
        for i in range(len(cuts))
    ]
    out, i = [], 0
    skip = 0  # words at the front of chunk i that the last repair has already given
    while i < len(cuts):
        ids, counts = coded[i]
        words = len(counts)
        if not split[i]:
            out.append(ids[4 * int(counts[:skip].sum()) :])
            skip, i = 0, i + 1
            continue
        last = i + 1  # the chunk in which the split word ends
        while split[last] and len(coded[last][1]) == 1:
            last += 1
        reach = 1
        while True:
            left = max(skip, words - 1 - reach)
            right = min(len(coded[last][1]), 1 + reach)
            if split[last]:  # its last word is split itself, so it is no witness
                right = min(right, len(coded[last][1]) - 1)
            before = text[starts[i] : cuts[i]].split()[left:]
            after = text[starts[last] : cuts[last]].split()[: max(right, 1)]
            middle = text[cuts[i] : starts[last]]
            window = b" ".join(before) + middle + b" ".join(after)
            got = own.library.encode(window.decode(), add_special_tokens=False).ids
            got = np.array(got, "<u4").tobytes()
            head = ids[4 * int(counts[:left].sum()) : 4 * int(counts[: words - 1].sum())]
            tail_ids, tail_counts = coded[last]
            tail = tail_ids[4 * int(tail_counts[0]) : 4 * int(tail_counts[: max(right, 1)].sum())]
            if got.startswith(head) and got.endswith(tail) and len(got) >= len(head) + len(tail):
                break
            if left == skip and right >= len(tail_counts) - split[last]:
                break
            reach *= 2
        out.append(ids[4 * int(counts[:skip].sum()) : 4 * int(counts[:left].sum())])
        out.append(got)
        skip, i = max(right, 1), last
    return b"".join(out)


def _begins(cuts: np.ndarray) -> list[int]:
    return [0, *cuts[:-1].tolist()]


def _digests(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """(row_id, row_hash, digests): the digest of each chunk of a text."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        found = []
        for text in batch.column("body").cast(pa.binary()):
            text = text.as_py() or b""
            cuts = cut_points(text, chunk_bytes)
            found.append([digest(text[a:b]) for a, b in zip(_begins(cuts), cuts.tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("row_hash"), pa.array(found, pa.list_(pa.binary()))],
            names=["row_id", "row_hash", "digests"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with compressed texts."""
    import zstandard

    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        texts = batch.column("body").cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_id"),
                batch.column("row_hash"),
                pa.array([pack.compress(t.as_py() or b"") for t in texts], pa.binary()),
            ],
            names=["row_id", "row_hash", "packed"],
        )


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x.as_py()) for x in batch.column("packed")]


def _encode_shared(
    batches: Iterator[pa.RecordBatch], vocabulary: str, chunk_bytes: int
) -> Iterator[pa.RecordBatch]:
    """(digest, ids, counts) of the chunks at the positions named."""
    import xxhash

    own = encoder(vocabulary)
    for batch in batches:
        out = [], [], []
        batch = batch.filter(batch.column("at").is_valid())
        for text, at in zip(_texts(batch), batch.column("at").to_pylist()):
            cuts = cut_points(text, chunk_bytes)
            begins = _begins(cuts)
            chunks = [text[begins[i] : cuts[i]] for i in at]
            table = own.table({w for chunk in chunks for w in chunk.split()})
            for chunk in chunks:
                ids, counts = chunk_ids(chunk, table)
                out[0].append(xxhash.xxh3_128_digest(chunk))
                out[1].append(np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                out[2].append(counts.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.binary()) for x in out], names=["digest", "ids", "counts"]
        )


def _assemble(
    batches: Iterator[pa.RecordBatch], vocabulary: str, full: bool, chunk_bytes: int
) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, ids, decoded): the chunks given and the others, joined and repaired."""
    own = encoder(vocabulary)
    for batch in batches:
        texts = _texts(batch)
        cuts = [cut_points(t, chunk_bytes) for t in texts]
        given = batch.column("given").to_pylist()
        rows = []
        for a, b in slices(texts):
            fresh: list[dict[int, bytes]] = []
            for text, ends, got in zip(texts[a:b], cuts[a:b], given[a:b]):
                have = {x["pos"] for x in got or ()}
                fresh.append(
                    {
                        i: text[a:b]
                        for i, (a, b) in enumerate(zip(_begins(ends), ends.tolist()))
                        if i not in have
                    }
                )
            table = own.table({w for x in fresh for chunk in x.values() for w in chunk.split()})
            for text, ends, got, new in zip(texts[a:b], cuts[a:b], given[a:b], fresh):
                coded: list = [None] * len(ends)
                for x in got or ():
                    ids = np.frombuffer(x["ids"], "<u2").astype("<u4").tobytes()
                    coded[x["pos"]] = ids, np.frombuffer(x["counts"], "<u2").astype(np.int64)
                for i, chunk in new.items():
                    coded[i] = chunk_ids(chunk, table)
                rows.append(repaired(text, ends, coded, own))
        decoded = [own.decoded(np.frombuffer(x, "<u4")) for x in rows]
        if full:
            values = [pa.array(rows, pa.binary()), pa.array(decoded, pa.string())]
        else:
            sha = lambda x: hashlib.sha256(x).hexdigest()
            values = [pa.array(map(sha, rows), pa.string()), pa.array(map(sha, decoded), pa.string())]
        counts = pa.array([len(x) >> 2 for x in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), counts, *values], names=["id", "n_tokens", "ids", "decoded"]
        )


def encode_documents(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    digests_only: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, n_tokens, ids, decoded) per row.

    ``ids`` are little-endian unsigned 32-bit integers as BINARY and ``decoded`` is the text of
    the library's decode with special tokens. With ``digests_only`` both are their SHA-256 in
    lowercase hex, which spares moving them.
    """
    if not splits_on_space(vocabulary):
        raise ValueError(f"tokens of {vocabulary} may span white space")
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    body = docs.select(
        F.col(id_col).alias("row_id"),
        F.xxhash64(F.col(text_col)).alias("row_hash"),
        F.col(text_col).alias("body"),
    )
    key = f"row_id {kind}, row_hash bigint"
    found = body.mapInArrow(
        lambda batches: _digests(batches, chunk_bytes), f"{key}, digests array<binary>"
    ).select("row_id", "row_hash", F.posexplode("digests").alias("pos", "digest"))
    shared = (
        found.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "row_hash", "pos")).alias("first"))
        .where(F.col("n") > 1)
    )
    shared = settled(shared.select("digest", "first.*"))
    at = shared.groupBy("row_id", "row_hash").agg(F.collect_set("pos").alias("at"))
    packed = body.mapInArrow(_packed, f"{key}, packed binary")
    # Both joins are left joins, so that they read the texts through the same exchange.
    coded = (
        packed.join(at, same_row(packed, at), "left")
        .select("packed", "at")
        .mapInArrow(
            lambda batches: _encode_shared(batches, vocabulary, chunk_bytes),
            "digest binary, ids binary, counts binary",
        )
        .dropDuplicates(["digest"])
    )
    given = (
        found.join(shared.select("digest"), "digest", "left_semi")
        .distinct()
        .join(coded, "digest")
        .groupBy("row_id", "row_hash")
        .agg(F.collect_list(F.struct("pos", "ids", "counts")).alias("given"))
    )
    kinds = "ids string, decoded string" if digests_only else "ids binary, decoded string"
    out = (
        packed.join(given, same_row(packed, given), "left")
        .select(packed["row_id"], packed["packed"], "given")
        .mapInArrow(
            lambda batches: _assemble(batches, vocabulary, not digests_only, chunk_bytes),
            f"id {kind}, n_tokens bigint, {kinds}",
        )
    )
    return out.withColumnRenamed("id", id_col)
