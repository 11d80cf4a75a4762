"""SimHash near-duplicates: fingerprints, BK-trees over shards, components of links.

Every fingerprint of 64 bits is cut into ``radius + 1`` bands. Two fingerprints that differ
in at most ``radius`` bits agree in one band at least, so the fingerprints that share a band
value form a shard that holds all partners of its members. Each shard is one BK-tree: a
child hangs below its parent under the integer Hamming distance to it, and a search with
radius r at a node of distance d follows only the edges d - r to d + r. A tree goes to the
task that searches it together with that shard's probes. The trees of all shards together
grow with the data, so they are dealt by shard and not copied to every executor.

A shard above ``tree_size`` fingerprints is split: the bits outside its band are cut into
bands again, by the same argument, until the shard is small enough or ``levels`` is reached.
At radius 2 five levels fix 54 of the 64 bits, which bounds any tree at 2^10 distinct
fingerprints, whatever the data. Nothing is capped: copies of one text share one
fingerprint, and each level keeps every link.

Null or wordless texts have fingerprint 0 and are linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import settled, ship
from shelfwise.llm.graph import components

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, with repeats."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    step = 65_536
    for low in range(0, len(starts), step):
        spans = zip(starts[low : low + step], stops[low : low + step])
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed BIGINT."""
    ship(docs.sparkSession)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").cast(pa.binary())
            fps = np.fromiter(
                (fingerprint(t.as_py(), shingle, seed) for t in texts), "u8", len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(fps.view("i8"))], names=["id", "fp"]
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(per_batch, f"id {kind}, fp bigint")


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, smaller root value) that join the values of one shard by BK-tree.

    Searches the tree for each value before adding it, and keeps one link a value: to the
    root of the set it joins. The links have the same components as all pairs in radius.
    """
    values = sorted(set(values))
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    children: list[dict[int, int]] = [{} for _ in values]
    for new in range(1, len(values)):
        value, mine, stack = values[new], new, [0]
        while stack:
            node = stack.pop()
            distance = (value ^ values[node]).bit_count()
            if distance <= radius:
                other = root(node)
                low, high = (mine, other) if mine < other else (other, mine)
                parent[high], mine = low, low
            for edge, child in children[node].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)
        node = 0
        while True:
            distance = (value ^ values[node]).bit_count()
            if distance not in children[node]:
                children[node][distance] = new
                break
            node = children[node][distance]
    roots = (root(i) for i in range(len(values)))
    return [(values[i], values[r]) for i, r in enumerate(roots) if r != i]


def _bands(free: list[int], parts: int) -> list[list[int]]:
    """The free bit positions, cut into so many bands of nearly equal width."""
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def links(nodes: DataFrame, radius: int = 2, tree_size: int = 2048, levels: int = 5) -> DataFrame:
    """(src, dst) with src > dst as unsigned: spanning links among the distinct ``fp`` of nodes.

    Every band of a level becomes one ``bands`` path and mask; a shard is (path, value).
    """
    ship(nodes.sparkSession)

    def per_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for shard in batch.column("fps"):
                values = [int(v) & (2**64 - 1) for v in shard.values.to_pylist()]
                for a, b in tree_links(values, radius):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, "u8").view("i8")) for x in (src, dst)], names=["src", "dst"]
            )

    found: DataFrame | None = None
    parts = radius + 1
    paths = {(): []}
    rows = nodes.select("fp", F.lit(0).alias("path"))
    for level in range(1, levels + 1):
        # Each old path number becomes `parts` new ones: path * parts + band.
        masks, wider = [], {}
        for path, used in paths.items():
            free = [b for b in range(BITS) if b not in set(used)]
            for i, band in enumerate(_bands(free, parts)):
                wider[(*path, i)] = used + band
        masks = [F.lit(_mask(used)).cast("bigint") for used in wider.values()]
        paths = wider
        table = F.array(*masks)
        below = F.sequence(F.col("path") * parts, F.col("path") * parts + parts - 1)
        exploded = rows.select("fp", F.explode(below).alias("path"))
        routed = exploded.select(
            "fp", "path", F.col("fp").bitwiseAND(F.get(table, F.col("path"))).alias("value")
        )
        if level == levels:
            cold, hot = routed, None
        else:
            crowded = (
                routed.groupBy("path", "value").count().where(F.col("count") > tree_size)
            ).select("path", "value")
            crowded = settled(crowded)
            hot = None
            cold = routed
            if not crowded.isEmpty():
                hot = routed.join(crowded, ["path", "value"], "left_semi").select("fp", "path")
                cold = routed.join(crowded, ["path", "value"], "left_anti")
        shards = (
            cold.groupBy("path", "value")
            .agg(F.collect_set("fp").alias("fps"))
            .where(F.size("fps") > 1)
            .select("fps")
        )
        part = shards.mapInArrow(per_shard, "src bigint, dst bigint")
        found = part if found is None else found.unionByName(part)
        if hot is None:
            break
        rows = settled(hot)
    return found.distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    shingle: int = 3,
    seed: int = 42,
    tree_size: int = 2048,
) -> DataFrame:
    """(id, fingerprint, component_id) for each row, rows with a NULL id included.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id reachable over
    links of ``radius`` bits or fewer, NULL only if no row of the component has an id.
    Repeated rows keep their number; rows that share an id and differ in text are linked
    only by their fingerprints. An empty table gives an empty result.
    """
    fps = settled(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    labels = components(links(nodes, radius, tree_size))
    grouped = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    grouped = settled(grouped)
    roots = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
