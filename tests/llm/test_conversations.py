"""The repair search against all repairs, and repaired conversations against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import conversations, queries
from shelfwise.llm.repair_search import CUT, KINDS, MUST_GO, cheapest_repair, estimates
from tests.llm.conftest import SF

#: state -> {role initial that may follow: next state}
FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_repairs(rows):
    """The least (cost, letters) from every row and state on; rows are (initial, must_go, cut)."""
    best = {}
    for i in range(len(rows), -1, -1):
        base = {}
        for state, follows in FOLLOWS.items():
            options = [(0, "")] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                initial, must_go, cut = rows[i]
                cost, letters = best[i + 1, state]
                options.append((3 + cost, "D" + letters))
                if not must_go and initial in follows:
                    cost, letters = best[i + 1, follows[initial]]
                    options.append((cut + cost, "K" + letters))
                for role in set("ua") & set(follows) if not must_go else ():
                    cost, letters = best[i + 1, follows[role]]
                    options.append((2 + cut + cost, "R" + letters))
            base[state] = min(options, default=(10**9, ""))
        found = dict(base)
        for _ in range(4):
            for state, follows in FOLLOWS.items():
                inserted = [found[follows[role]] for role in set("ua") & set(follows)]
                found[state] = min([base[state], *((2 + c, "I" + x) for c, x in inserted)])
        best |= {(i, state): found[state] for state in FOLLOWS}
    return best


def coded(rows):
    return bytes(KINDS.index(k) | (MUST_GO if gone else 0) | (CUT if cut else 0) for k, gone, cut in rows)


@pytest.mark.parametrize("kinds", ["ua", "suax", "uax", "sx", "uuaas"])
def test_search_finds_the_cheapest_and_least_repair(kinds):
    rng = random.Random(kinds)
    for _ in range(1500):
        gone, cut = rng.choice([0, 0.1, 0.4]), rng.choice([0, 0.2, 0.7])
        rows = []
        for _ in range(rng.randint(0, 12)):
            must_go = rng.random() < gone
            rows.append((rng.choice(kinds), must_go, not must_go and rng.random() < cut))
        best = plain_repairs(rows)
        assert cheapest_repair(coded(rows)) == best[0, ""]
        for state, ahead in zip(("", "s", "u", "a"), estimates(coded(rows))):
            assert all(ahead[i] <= best[i, state][0] for i in range(len(rows) + 1))


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(1)
    rows = [(rng.choice("uax"), rng.random() < 0.1, False) for _ in range(20_000)]
    cost, letters = cheapest_repair(coded(rows))
    assert letters.count("D") + letters.count("K") + letters.count("R") == len(rows)
    assert cost <= 3 * len(rows)


def plain_result(rows, damage=None):
    """{conv_id: result} of (conv_id, turn, role, text), by the words of the contract."""
    kept = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20 if damage is None else damage
        text = "" if what == 1 else re.sub(r"[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        kept[conv_id] += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = {}
    for conv_id, found in kept.items():
        digest = lambda text: hashlib.sha256(text.encode()).digest()
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        codes, seen = [], set()
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = (
                "blank" if not bare
                else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?"
                else None
            )
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, letters = plain_repairs(codes)[0, ""]
        repaired, state, at = [], "", 0
        for letter in letters:
            if letter == "D":
                at += 1
                continue
            role = codes[at][0] if letter == "K" else next(x for x in FOLLOWS[state] if x in "ua")
            state = FOLLOWS[state][role]
            name = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                repaired.append(f"{name}:")
            else:
                repaired.append(f"{found[at][1] if letter == 'K' else name}:{found[at][2]}")
                at += 1
        assert at == len(found)
        turns = {turn for turn, _, _ in found if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv_id] = (gaps, *counts.values(), illegal, cost, letters, sha)
    return out


def results(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_query_matches_the_plain_version(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert results(queries.op12_conversation_repair(spark, SF)) == plain_result(rows)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t\n", None, "What?", "Ends with a space. \n", "x" * 60_000 + "!", "\u0085", "é."]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "System"]
    rows = [
        (rng.choice([*range(40), None]), rng.choice([*range(9), None, -3]), rng.choice(roles), rng.choice(texts))
        for _ in range(700)
    ]
    rows += [(100, None, "user", "a b."), (100, None, "user", "a b."), (101, 5, None, None), (102, 0, "system", "s.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert results(conversations.repair(frame)) == plain_result(rows)
    clash = frame.select("*", F.lit(1).alias("Role"), F.lit("x").alias("digest"), F.lit(2).alias("copies"))
    assert results(conversations.repair(clash)) == plain_result(rows)
    assert results(conversations.repair(frame, F.lit(5))) == plain_result(rows, 5)
    dropped = results(conversations.repair(frame, F.lit(0)))
    nothing = hashlib.sha256(b"").hexdigest()
    assert set(dropped.values()) == {(0, 0, 0, 0, 0, 0, "", nothing)}
    assert set(dropped) == {r[0] for r in rows}


def test_one_conversation_over_many_batches(spark):
    rows = [(1, i, ("user", "assistant")[i % 7 % 2], f"Turn {i % 900}.") for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert results(conversations.repair(frame)) == plain_result(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_turns_and_empty_table(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert results(conversations.repair(frame, F.lit(5)))[1][0] is None
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
