"""Exact substring dedup over sliding runs of sentences.

A text is cut into sentences: after a full stop, exclamation or question mark with white
space behind it, after a line break, and before a word that begins with a capital letter
(pasted passages often start inside a sentence). A sentence of more than ``WHOLE`` (15) words is
cut further, before every word whose hash is the least of some ``WINDOW`` (8) consecutive words:
such cuts depend on the words around them only, and leave pieces of eight words at most. All
pieces are called sentences below.

From every sentence on, the shortest run of several consecutive sentences with ``min_words``
words or more is hashed, and so is the shortest such run up to every sentence; one sentence of
``long_words`` words is a run alone, where a caller asks for fewer than the cuts leave. Equal
whole sentences thus have equal runs wherever they stand. A passage of more than 50 words, glued
at both ends, loses 15 words at most at either end to a sentence or piece that other words
share; the 21 or more between are whole sentences in every copy and hold a run of 20.

Runs are compared by 128-bit hashes of their lower-cased words over the whole corpus. The
first occurrence (least id, then text hash, then place) stays; sentences that any other
occurrence covers are removed. Shuffled are hashes and places, once, and the compressed texts
by row. Tasks settle equal runs among some 200,000 neighbours before the shuffle, so a passage in a third
of all documents brings one row for thousands of them; the rest is ranked in a sorted stream.

A null text stays null, and an empty one empty, with no sentences. Rows equal in id and text
count as one document and all keep what the first keeps. A NULL id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import exact_columns, row_key, same_row, ship

MIN_WORDS = 20
LONG_WORDS = 30
WHOLE, WINDOW = 15, 8
#: Runs compared with each other in a task before they are dealt by their hash.
AT_ONCE = 200_000
_END = regex.compile(r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|[\x20\x09-\x0D]+(?=\p{Lu})")
#: What word hashes are made of: a number for each byte (letters A to Z as a to z) and place.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_POWER = np.random.default_rng(8).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def _inner_cuts(text: str, ends: list[int]) -> list[int]:
    """Where the sentences of more than WHOLE words are cut, given where sentences end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if len(starts) <= WHOLE:
        return []
    # The place of each word's first letter in the text, and the sentence it is in.
    if len(raw) == len(text):
        at = starts
    else:
        at = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), starts)
    of = np.searchsorted(np.array(ends, np.int64), at, side="right")
    long = np.bincount(of) > WHOLE
    if not long.any():
        return []
    begun = np.zeros(len(raw), np.int64)
    begun[starts] = starts
    letters = np.arange(len(raw)) - np.maximum.accumulate(begun)
    mixed = np.where(solid, _LETTER[raw] * _POWER[letters & 63], np.uint64(0))
    hashes = np.add.reduceat(mixed, starts)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    # Of equal words the last one counts.
    last = WINDOW - 1 - windows[:, ::-1].argmin(axis=1) + np.arange(len(windows))
    chosen = np.zeros(len(starts), bool)
    chosen[last[(of[: len(last)] == of[WINDOW - 1 :]) & long[of[: len(last)]]]] = True
    chosen[0] = False
    chosen[1:] &= of[1:] == of[:-1]  # a sentence's first word is no cut of its own
    return at[chosen].tolist()


def sentences(text: str) -> list[str]:
    """The sentences with the white space behind them; joined they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    cuts = sorted({0, *ends, len(text), *_inner_cuts(text, ends)})
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def runs(parts: list[str], min_words: int = MIN_WORDS, long_words: int = LONG_WORDS):
    """(16-byte hash, first sentence, last sentence) of each run, without repeats of a place."""
    import xxhash

    words = [p.lower().encode().split() for p in parts]
    joined = [b" ".join(w) + b" " if w else b"" for w in words]
    kept = [i for i, w in enumerate(words) if w]  # sentences of white space only count for nothing
    counts = [len(words[i]) for i in kept]
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    n = len(kept)
    # The last sentence of the shortest run from i, and the first of the shortest run up to j.
    ahead = np.searchsorted(total, total[:-1] + min_words).tolist()
    behind = (np.searchsorted(total, total[1:] - min_words, side="right") - 1).tolist()
    places = {(i, j - 1) for i, j in enumerate(ahead) if j <= n and j - 1 > i}
    places |= {(i, i + 1) for i, j in enumerate(ahead) if j - 1 == i and i + 1 < n}
    places |= {(i, j) for j, i in enumerate(behind) if 0 <= i < j}
    places |= {(j - 1, j) for j, i in enumerate(behind) if i == j > 0}
    places |= {(i, i) for i, c in enumerate(counts) if c >= long_words}
    digest = xxhash.xxh3_128_digest
    whole = b"".join(joined)
    at = [0, *np.cumsum([len(joined[k]) for k in kept]).tolist()]
    for i, j in sorted(places):
        yield digest(whole[at[i] : at[j + 1]]), kept[i], kept[j]


def _row_order(ids: list, hashes: list) -> np.ndarray:
    """The rank of each row by id (None first) and hash; equal rows share one."""
    keys = [(i is not None, 0 if i is None else i, h) for i, h in zip(ids, hashes)]
    rank = {key: n for n, key in enumerate(sorted(set(keys)))}
    return np.array([rank[key] for key in keys], np.int64)


def _settled_here(pair: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs that may be a first occurrence, runs that are not), by the runs at hand alone.

    Only the least of equal runs can be the first of all; what ties with it has its fate.
    """
    n = len(pair)
    order = np.argsort(pair[:, 0], kind="stable")
    equal = np.diff(pair[order, 0]) == 0
    near = order[np.append(equal, False) | np.append(False, equal)]
    near = near[np.lexsort((first[near], rank[near], pair[near, 1], pair[near, 0]))]
    begins = np.append(True, (np.diff(pair[near], axis=0) != 0).any(axis=1))[: len(near)]
    least = near[np.maximum.accumulate(np.where(begins, np.arange(len(near)), 0))]
    apart = (rank[near] != rank[least]) | (first[near] != first[least])
    open_runs = np.ones(n, bool)
    open_runs[near[~begins]] = False
    return np.flatnonzero(open_runs), near[apart]


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last) with overlapping and neighbouring spans of a row joined."""
    out: list[list[int]] = []
    order = np.lexsort((first, row))
    for r, a, z in zip(row[order].tolist(), first[order].tolist(), last[order].tolist()):
        if out and out[-1][0] == r and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([r, a, z])
    return out


def _run_rows(batches: Iterator[pa.RecordBatch], min_words: int, long_words: int, at_once: int):
    """(row_id, row_hash, h1, h2, first, last, later) of the runs of every text.

    Of runs that are equal among some ``at_once`` neighbours only the least goes on by its hash. The
    others are later occurrences for sure, whatever comes: their spans are joined and
    dealt by their row, so a passage that a third of all texts hold brings few rows of one hash.
    """
    for batch in batches:
        ids, hashes = batch.column("row_id"), batch.column("row_hash")
        rank, known = None, hashes.to_numpy()
        at, digests, places = [], [], []

        def ready():
            nonlocal rank
            if rank is None:
                rank = _row_order(ids.to_pylist(), known.tolist())
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            span = np.array(places, np.int32).reshape(-1, 2)
            row = np.array(at, np.int64)
            some, gone = _settled_here(pair, rank[row], span[:, 0])
            merged = _merged(row[gone], span[gone, 0], span[gone, 1])
            more = np.array(merged, np.int64).reshape(-1, 3)
            rows = np.append(row[some], more[:, 0])
            columns = [ids.take(pa.array(rows)), pa.array(known[rows])]
            columns.append(pa.array(np.append(pair[some, 0], known[more[:, 0]])))
            columns += [pa.array(np.append(pair[some, 1], more[:, 1]))]
            columns += [pa.array(np.append(span[some, i], more[:, 1 + i].astype(np.int32))) for i in (0, 1)]
            columns.append(pa.array(np.arange(len(rows)) >= len(some)))
            return pa.RecordBatch.from_arrays(
                columns, names=["row_id", "row_hash", "h1", "h2", "first", "last", "later"]
            )

        for row, text in enumerate(batch.column("body")):
            for digest, first, last in runs(sentences(text.as_py() or ""), min_words, long_words):
                at.append(row)
                digests.append(digest)
                places.append((first, last))
            if len(at) > at_once:
                yield ready()
                at, digests, places = [], [], []
        if at:
            yield ready()


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """(text left, sentences, removed sentences, removed words)."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for first, last in covered:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    left = "".join(p for p, g in zip(parts, gone) if not g)
    words = sum(len(p.encode().split()) for p, g in zip(parts, gone) if g)
    return left.rstrip() if gone.any() else left, len(parts), int(gone.sum()), words


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with compressed texts, null where the text is."""
    import zstandard

    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        texts = batch.column("body").cast(pa.binary()).to_pylist()
        packed = [None if t is None else pack.compress(t) for t in texts]
        others = ["row_id", "row_hash", "carried"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, others), pa.array(packed, pa.binary())], names=[*others, "packed"]
        )


def _cleaned(batches: Iterator[pa.RecordBatch]):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    names = ["body", "n_sentences", "n_removed", "removed_words"]
    for batch in batches:
        rows = []
        firsts, lasts = (batch.column(c).to_pylist() for c in ("firsts", "lasts"))
        for packed, first, last in zip(batch.column("packed"), firsts, lasts):
            packed = packed.as_py()
            if packed is None:
                rows.append((None, 0, 0, 0))
            else:
                text = unpack.decompress(packed).decode()
                rows.append(without(text, list(zip(first or (), last or ()))))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        values = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        others = [batch.column(i) for i in range(batch.num_columns - 3)]
        yield pa.RecordBatch.from_arrays(
            [*others, *values], names=[*batch.schema.names[:-3], *names]
        )


def dedup_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    long_words: int = LONG_WORDS,
    carry: tuple[str, ...] = (),
    at_once: int = AT_ONCE,
) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed_words) per row, texts without repeats.

    Columns named in ``carry`` stay with their row and come last.
    """
    ship(docs.sparkSession)
    docs = exact_columns(docs, *dict.fromkeys((id_col, text_col, *carry)))
    kind = dict(docs.dtypes)[id_col]
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    body = docs.select(
        *row_key(docs, id_col, text_col), carried.alias("carried"), F.col(text_col).alias("body")
    )
    more = dict(body.dtypes)["carried"]
    found = body.drop("carried").mapInArrow(
        lambda batches: _run_rows(batches, min_words, long_words, at_once),
        f"row_id {kind}, row_hash bigint, h1 bigint, h2 bigint, first int, last int, later boolean",
    )
    # Repeated rows tie with the first place and keep what it keeps.
    order = ["later", "row_id", "row_hash", "first"]
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy(*order))
    later = found.withColumn("place", F.when(F.col("later"), 2).otherwise(place)).where("place > 1")
    covered = later.groupBy("row_id", "row_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )
    packed = body.mapInArrow(_packed, f"row_id {kind}, row_hash bigint, carried {more}, packed binary")
    joined = packed.join(covered, same_row(packed, covered), "left").select(
        packed["row_id"].alias("id"),
        packed["carried"],
        packed["packed"],
        F.col("spans.first").alias("firsts"),
        F.col("spans.last").alias("lasts"),
    )
    out = joined.mapInArrow(
        _cleaned,
        f"id {kind}, carried {more}, body string, n_sentences bigint, n_removed bigint, removed_words bigint",
    )
    return out.select(
        F.col("id").alias(id_col),
        F.col("body").alias(text_col),
        "n_sentences",
        "n_removed",
        "removed_words",
        *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)],
    )
