"""What several operators share: shipping code, shared folders, row keys, columns by name."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_shelfwise_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / "shelfwise_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(os.path.realpath(archive))
    context._shelfwise_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, local sessions get one in /tmp.

    Also tells the context, so that ``checkpoint()`` writes there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of a frame that is read more than once; cuts its lineage."""
    shared_folder(df.sparkSession)
    ship(df.sparkSession)
    return df.checkpoint(eager=True)


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, by case where several names differ by case only."""
    lower = [c.lower() for c in df.columns]
    at = [df.columns.index(c) if c in df.columns else lower.index(c.lower()) for c in names]
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"c{i}").alias(name) for i, name in zip(at, names)])


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.regexp_extract_all(text, F.lit(f"{WORD_CLASS}+"), F.lit(0))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(row_id, row_hash): an id that may be NULL or repeated, told apart by its text.

    The hash has 64 bits, since all rows without an id are told apart by it alone.
    """
    return [F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_hash")]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """The join condition on row_id (which may be NULL) and row_hash."""
    return (left["row_hash"] == right["row_hash"]) & left["row_id"].eqNullSafe(right["row_id"])
