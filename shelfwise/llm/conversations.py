"""Damaging conversations by a rule, counting their faults and repairing them at the least cost.

A row's faults are found by Spark: a row is a duplicate if its conversation holds an equal role and text
at an earlier turn, so equal rows are counted together first and each text (as its digest) is joined to the
first turn it has. A message that a third of all rows repeat is then one row a turn, and what the
join still finds uneven is split by adaptive execution.

Two passes stream over rows sorted by conversation and turn. The first sees no texts: it writes one byte a row
and hands a finished conversation to ``repair_search``, whose letters are one byte an edit. The result holds
these letters in one value, so a conversation that can be returned at all fits the task. The second pass
meets the letters ahead of the rows they belong to and feeds the repaired rows to a running SHA-256;
no text is kept, however long its conversation.

Rows of one turn are ordered by role and digest; equal rows are adjacent. A NULL role or text is one space,
as is a NULL part of the key that settles the damage. NULL turns come first; rows without a conversation are
one conversation, of the id NULL. ``gaps`` beyond 64 bits is NULL. Other columns are not read; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD_CLASS, exact_columns, ship
from shelfwise.llm.repair_search import CUT, MUST_GO, NAMES, NEXT, NONE, KEEP, cheapest_repair, kind_of

SPACES = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, damage: Column) -> DataFrame:
    """Rows after damage by number: 0 dropped (no copies), 1 emptied, 2 without ends, 3 twice, 4 a user's."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(damage == 1, "")
        .when(damage == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def key_damage() -> Column:
    """What befalls a row, from the CRC-32 of its conversation and turn."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with ``blank``, ``cut`` and ``repeated`` (all copies, or all but one)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    equal = rows.groupBy(
        "conv_id",
        "turn",
        "role",
        "digest",
        (~F.col("text").rlike(WORD_CLASS)).alias("blank"),
        (~last.isin(*".!?")).alias("cut"),
    ).agg(F.sum("copies").alias("copies"))
    said = rows.where("copies > 0").groupBy("conv_id", "role", "digest")
    firsts = said.agg(F.min("turn").alias("first_turn"), F.max(F.isnull("turn")).alias("untimed")).select(
        F.col("conv_id").alias("first_conv"),
        F.col("role").alias("first_role"),
        F.col("digest").alias("first_digest"),
        F.when(~F.col("untimed"), F.col("first_turn")).alias("first_turn"),
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("first_conv"))
        & (F.col("role") == F.col("first_role"))
        & (F.col("digest") == F.col("first_digest"))
    )
    told = equal.join(firsts, same, "left")
    repeated = ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return told.select("conv_id", "turn", "role", "digest", "blank", "cut", "copies", repeated.alias("repeated"))


class Conversation:
    """Counts and codes of one conversation, row by row in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None
        self.codes = bytearray()

    def take(self, turn, role: str, blank: bool, cut: bool, repeated: bool, copies: int) -> None:
        """So many equal rows."""
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.illegal += (copies - 1) * (2 * initial not in LEGAL)
        self.before = initial
        kind = kind_of(role)
        again = 0 if blank else copies - (not repeated)
        self.blank += copies if blank else 0
        self.duplicate += again
        if not blank and not repeated:
            self.truncated += cut
            self.codes.append(kind | (CUT if cut else 0))
        self.codes.extend(bytes([kind | MUST_GO]) * (copies if blank else again))

    def row(self) -> tuple:
        """What the result has of it but for the hash."""
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, letters = cheapest_repair(bytes(self.codes))
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.conv_id, gaps if gaps < 2**63 else None, *counts, letters)


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(name).to_pylist() for name in names))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sorted rows."""

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(COUNTS), pa.string()]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit"])

    now, kind = None, None
    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        for conv_id, *rest in _columns(batch, "conv_id", "turn", "role", "blank", "cut", "repeated", "copies"):
            if now is None or conv_id != now.conv_id:
                done += [now.row()] if now else []
                now = Conversation(conv_id)
            now.take(*rest)
        if done:
            yield made(done, kind)
    if now:
        yield made([now.row()], kind)


class Repair:
    """The running hash of a conversation's repaired rows."""

    def __init__(self, letters: str):
        self.letters, self.at = letters, 0
        self.state = NONE
        self.sha = hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        start = "\n" if self.state != NONE else ""
        self.sha.update(f"{start}{role}:{text}".encode())

    def _insert(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            after = NEXT[self.state]
            self._write(NAMES[after], "")
            self.state, self.at = after, self.at + 1

    def take(self, role: str, text: str) -> None:
        """The next row, with what is inserted ahead of it."""
        self._insert()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "D":
            return
        after = KEEP[self.state][kind_of(role)] if letter == "K" else NEXT[self.state]
        self._write(role if letter == "K" else NAMES[after], text)
        self.state = after

    def digest(self) -> str:
        """The hash after the last row."""
        self._insert()
        return self.sha.hexdigest()


def _hashed(names: tuple[str, ...]):
    """A mapper from sorted rows, each conversation's letters first, to the result's rows."""

    def finished(done: list[tuple[tuple, Repair]], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*[head for head, _ in done]), types)]
        columns.append(pa.array([repair.digest() for _, repair in done]))
        return pa.RecordBatch.from_arrays(columns, [*names, "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, types = None, [], None
        for batch in batches:
            types = [batch.column(name).type for name in names]
            heads = list(_columns(batch, *names))
            for head, (role, text, copies) in zip(heads, _columns(batch, "role", "text", "copies")):
                if role is None:
                    done += [now] if now else []
                    now = head, Repair(head[-1])
                else:
                    for _ in range(copies):
                        now[1].take(role, text)
            if done:
                yield finished(done, types)
                done = []
        if now:
            yield finished([now], types)

    return run


def repair(conversations: DataFrame, damage: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each id.

    ``damage`` numbers what is done to a row first (see ``damaged``); ``key_damage()`` if not given,
    F.lit(5) for none.
    """
    ship(conversations.sparkSession)
    known = exact_columns(conversations, "conv_id", "turn", "role", "text")
    kind = dict(known.dtypes)["conv_id"]
    rows = damaged(known, key_damage() if damage is None else damage)

    order = ["conv_id", "turn", "role", "digest"]
    marks = faults(rows).repartition("conv_id").sortWithinPartitions(*order)
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    schema = f"conv_id {kind}, {counts}, audit string"
    repaired = marks.mapInArrow(_searched, schema)

    texts = rows.where("copies > 0").select(*order, "text", "copies")
    both = repaired.unionByName(texts, allowMissingColumns=True)
    # A conversation's own row has no role and comes first.
    first = F.col("role").isNotNull()
    streamed = both.repartition("conv_id").sortWithinPartitions("conv_id", first, "turn", "role", "digest")
    names = ("conv_id", *COUNTS, "audit")
    return streamed.mapInArrow(_hashed(names), f"{schema}, repaired_sha256 string")

