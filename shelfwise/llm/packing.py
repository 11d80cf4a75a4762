"""Best-fit packing of token sequences into bins of several permitted lengths.

Every document goes to one bin; one longer than the longest bin is cut, its full pieces fill
bins of their own and its rest is packed. The rows are dealt over shards by a hash of id and
row, so a hot source or a group of copies spreads evenly, and each shard is packed in one
task that holds lengths only, ``shard_rows`` of them on average.

In a shard the items are taken by falling length. An item goes to the open bin, of whatever
size, that leaves the least room (best fit); if none has room a new bin of the least cost is
opened. Which sizes may be opened is settled jointly: for each permitted size as the least
one to open, the whole shard is packed, and the packing with the least total cost wins. At
the end each bin is downsized to the shortest permitted length that holds its contents.

The cost of a bin of length c is c + c * c / ``attention``: its tokens and what attention
over them takes. Items of length zero or NULL get no bin (NULL columns). Ties go to the
lower id. Repeated rows are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship

SIZES = (512, 1024, 2048, 4096, 8192)
ATTENTION = 65_536.0
SHARD_ROWS = 50_000


def bin_cost(size: int, attention: float = ATTENTION) -> float:
    """What one bin of this length costs."""
    return size + size * size / attention


def pack_items(lengths: list[int], sizes: tuple[int, ...], least: int, attention: float):
    """(bin of each item, opened size of each bin) for lengths in falling order.

    ``least`` is the shortest size that may be opened. Open bins are kept by their room; bit r
    of ``rooms`` is set if some bin has room r, so the best fit is the lowest set bit.
    """
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    rooms, where, opened = 0, [], []
    allowed = [s for s in sizes if s >= least]
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            chosen = len(opened)
            room = min((s for s in allowed if s >= length), key=lambda s: (bin_cost(s, attention), s))
            opened.append(room)
        where.append(chosen)
        room -= length
        if room:
            by_room[room].append(chosen)
            rooms |= 1 << room
    return where, opened


def best_packing(lengths: np.ndarray, sizes: tuple[int, ...], attention: float = ATTENTION):
    """(bin of each item, final size of each bin) of the cheapest of the joint plans."""
    falling = lengths.tolist()
    best = None
    for least in sizes:
        where, opened = pack_items(falling, sizes, least, attention)
        filled = np.bincount(where, lengths, len(opened)).astype(np.int64)
        final = np.array(sizes)[np.searchsorted(sizes, filled)]
        total = sum(bin_cost(int(s), attention) for s in final)
        if best is None or total < best[0]:
            best = total, np.array(where, np.int64), final
    return best[1], best[2]


def pack(
    docs: DataFrame,
    length_col: str = "n_tokens",
    id_col: str = "doc_id",
    sizes: tuple[int, ...] = SIZES,
    attention: float = ATTENTION,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, part, start, length, bin_id, bin_size, bin_start), one row a piece.

    ``start`` is the piece's first token in its document, ``bin_start`` its place in the bin.
    ``bin_id`` is unique in the result: shard * 2^40 + number.
    """
    ship(docs.sparkSession)
    sizes = tuple(sorted(sizes))
    longest = sizes[-1]
    items = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("length"),
    )
    shards = max(1, math.ceil(docs.count() / shard_rows))
    dealt = items.withColumn(
        "shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards))
    )
    kind = dict(items.dtypes)["id"]

    def one_shard(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.sort_values(["id", "length"], na_position="first", ignore_index=True)
        length = rows["length"].to_numpy(np.int64)
        full, rest = length // longest, length % longest
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        pieces = []
        if len(order):
            where, final = best_packing(rest[order], sizes, attention)
            by_bin = np.argsort(where, kind="stable")
            ends = np.cumsum(rest[order][by_bin])
            begins = ends - rest[order][by_bin]
            firsts = np.r_[True, np.diff(where[by_bin]) > 0]
            begins -= np.repeat(begins[firsts], np.diff(np.r_[np.flatnonzero(firsts), len(by_bin)]))
            at = order[by_bin]
            pieces.append((at, full[at], rest[at], where[by_bin], final[where[by_bin]], begins))
            used = len(final)
        else:
            used = 0
        whole = np.repeat(np.arange(len(rows)), full)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        size = np.full(len(whole), longest)
        pieces.append((whole, number, size, used + np.arange(len(whole)), size, 0 * size))
        none = np.flatnonzero(length <= 0)
        pieces.append((none, 0 * none, 0 * none, 0 * none - 1, 0 * none, 0 * none))
        at, part, size, bins, room, begin = (np.concatenate(x) for x in zip(*pieces))
        out = pd.DataFrame(
            {
                "id": rows["id"].iloc[at].array,
                "part": part,
                "start": part * longest,
                "length": size,
                "bin_id": pd.array(shard * 2**40 + bins, "Int64"),
                "bin_size": pd.array(room, "Int64"),
                "bin_start": pd.array(begin, "Int64"),
            }
        )
        out.loc[bins < 0, ["bin_id", "bin_size", "bin_start"]] = pd.NA
        return out

    packed = dealt.groupBy("shard").applyInPandas(
        one_shard,
        f"id {kind}, part bigint, start bigint, length bigint, "
        "bin_id bigint, bin_size bigint, bin_start bigint",
    )
    return packed.withColumnRenamed("id", id_col)
