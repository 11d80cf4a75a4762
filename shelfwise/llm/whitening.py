"""Whitening of embeddings by an incremental eigendecomposition, refined over all rows.

1. Each task reads its vectors once and keeps count, sums, mean and the eigendecomposition of their
   scatter (``spectrum``): one centred rank-one update a vector, equal vectors of a batch
   together. What it holds is one matrix of the vectors' length squared.
2. The tasks' spectra are combined in groups of ``FAN``, round after round: each eigenpair of one is a
   rank-one update of the other, the distance of their means one more. They are checkpointed
   before, so a lost executor repeats no update.
3. The basis found is refined (Rayleigh-Ritz): all rows, centred with the exact mean, are projected on it,
   the small matrix of their second moments is added up, and its eigenvectors turn the basis. So
   what rounding the updates gathered does not reach the result.
4. One more pass measures the covariance of the whitened rows; the last one returns them.

An entry c becomes floor(64 * c) + 1,000,000, kept within 2^53; counts, sums and deviations are whole
numbers. Rows whose vector is NULL, empty, or holds NULL, NaN or infinite entries are left
out, and so are those of another length than most vectors have (of equally frequent lengths the greatest).
Components without variance (below 1e-12 of the greatest) cannot be whitened and are not returned,
so equal vectors only, one vector or an empty table give no row. A deviation beyond 64
bits is NULL. Ids may be NULL or repeated; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import exact_columns, settled, ship
from shelfwise.llm.spectrum import Spectrum

COMPONENTS = 32
FAN = 16
NO_VARIANCE = 1e-12
SCALE, SHIFT, WIDEST = 64, 1_000_000, 2.0**53


def whole_numbers(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(SCALE * flat), -WIDEST, WIDEST).astype(np.int64).reshape(-1, size) + SHIFT


def usable(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows with a vector of finite entries and the usual length, and that length."""
    finite = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    full = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    sizes = full.groupBy(F.size("vector").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return full, None
    return full.where(F.size("vector") == usual["size"]), usual["size"]


def combined(parts: DataFrame, merge: Callable[[list], object]):
    """All objects of the column ``state`` merged, at most FAN at a time in one task."""
    while parts.count() > FAN:

        def some(rows: pd.DataFrame) -> pd.DataFrame:
            made = merge([pickle.loads(x) for x in rows.sort_values("id")["state"]])
            return pd.DataFrame({"id": rows["id"].iloc[:1] // FAN, "state": [pickle.dumps(made)]})

        by_group = parts.groupBy(F.expr(f"id div {FAN}").alias("in_group"))
        parts = settled(by_group.applyInPandas(some, "id bigint, state binary"))
    states = [pickle.loads(r["state"]) for r in parts.orderBy("id").collect()]
    return merge(states) if states else None


def per_task(rows: DataFrame, states: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> DataFrame:
    """(id, state) of what each task with rows makes of them; the id is the task's number."""

    def pickled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in states(batches):
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]})

    made = rows.mapInArrow(pickled, "state binary")
    return settled(made.select(F.spark_partition_id().cast("bigint").alias("id"), "state"))


def spectrum_of(rows: DataFrame, size: int) -> Spectrum | None:
    """Count, sums and eigendecomposition of all vectors."""

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[Spectrum]:
        seen = Spectrum(size)
        for batch in batches:
            vectors, copies = np.unique(whole_numbers(batch.column("vector"), size), axis=0, return_counts=True)
            for x, n in zip(vectors, copies):
                seen.add(x, int(n))
        if seen.n:
            yield seen

    def merge(found: list[Spectrum]) -> Spectrum:
        total = found[0]
        for other in found[1:]:
            total.absorb(other)
        return total

    return combined(per_task(rows, one_task), merge)


class Centre:
    """The exact mean, and exact distances from it times the number of rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: 64-bit numbers where all fit, else whole numbers of any size."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) * self.n
        if most + max(map(abs, self.sums)) < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)^2 of each row; NULL beyond 64 bits."""
        apart = self.scaled(x)
        widest = max((abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0)))))
        if widest**2 * max(1, x.shape[1]) < 2**63:
            return pa.array((apart.astype(np.int64) ** 2).sum(1))
        exact = (apart.astype(object) ** 2).sum(1)
        return pa.array([v if v < 2**63 else None for v in exact.tolist()], pa.int64())


def second_moments(rows: DataFrame, size: int, centre: Centre, basis: np.ndarray) -> tuple:
    """(mean, covariance) of the centred rows times the basis."""

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        moment, total, any_rows = 0.0, 0.0, False
        for batch in batches:
            y = centre.centred(whole_numbers(batch.column("vector"), size)) @ basis
            moment, total, any_rows = moment + y.T @ y, total + y.sum(0), True
        if any_rows:
            yield total, moment

    def merge(found: list[tuple]) -> tuple:
        return tuple(sum(parts[1:], parts[0]) for parts in zip(*found))

    total, moment = combined(per_task(rows, one_task), merge)
    mean = total / centre.n
    return mean, moment / centre.n - np.outer(mean, mean)


def whiten(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row a vector and component."""
    ship(embeddings.sparkSession)
    rows = exact_columns(embeddings, id_col, vector_col).toDF("id", "vector")
    kind = dict(rows.dtypes)["id"]
    schema = (
        f"id {kind}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    rows, size = usable(rows)
    found = spectrum_of(rows, size) if size else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centre = Centre(found.n, found.sums)

    basis = np.linalg.qr(found.vectors)[0]
    _, ritz = second_moments(rows, size, centre, basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    k = min(components, int((values > NO_VARIANCE * max(values[0], 0)).sum()))
    projection = vectors[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / values.sum()
    error = 0.0
    if k:
        _, after = second_moments(rows, size, centre, projection)
        error = float(np.abs(after - np.eye(k)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column("vector"), size)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(pa.array(each)),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(each), centre.n),
                    "deviation": centre.deviations(x).take(pa.array(each)),
                    "whitened": (centre.centred(x) @ projection).ravel(),
                    "explained": np.tile(explained, len(x)),
                    "identity_error": np.full(len(each), error),
                }
            )

    return rows.mapInArrow(projected, schema).withColumnRenamed("id", id_col)
