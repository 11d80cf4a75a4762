"""Shortest-pack-first against packing one by one; packed documents against the tokenizer."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import histogram_packing, queries
from shelfwise.llm.pack_plan import shortest_pack_first
from tests.llm.conftest import SF


def one_by_one(histogram, capacity):
    """Rooms of the packs after putting each copy into the pack with the most room."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if rooms and max(rooms) >= length:
                rooms[rooms.index(max(rooms))] -= length
            else:
                rooms.append(capacity - length)
    return collections.Counter(rooms)


@pytest.mark.parametrize("seed", range(300))
def test_plan_matches_packing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 8, 16, 30])
    lengths = rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 10)))
    histogram = {length: rng.randint(1, 9) for length in lengths}
    groups = shortest_pack_first(histogram, capacity)
    held, rooms = collections.Counter(), collections.Counter()
    for group in groups:
        rooms[group.room] += group.count
        assert group.room + sum(length * n for length, n in group.items) == capacity
        for length, n in group.items:
            held[length] += n * group.count
    assert held == histogram
    assert rooms == one_by_one(histogram, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    small = {length: rng.randint(1, 40) for length in range(1, 2049)}
    large = {length: n * 10**7 for length, n in small.items()}
    entries = [sum(len(g.items) for g in shortest_pack_first(h, 2048)) for h in (small, large)]
    assert max(entries) < 400_000


@pytest.fixture(scope="module")
def library():
    return histogram_packing.ByteEncoder()


def library_ids(library, text):
    return library.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from(" \n\t'’“—€  日😀"))))
def test_ids_are_those_of_the_library(text):
    coder = histogram_packing.byte_encoder()
    assert coder.ids(text).tolist() == library_ids(coder, text)


def test_odd_texts_have_the_ids_of_the_library(library):
    for text in ("a <|endoftext|> b", "x" * 30_000, " " * 5000 + "a", "日本語 İ ß", "I'll we've 12³ \x1c\x85", ""):
        assert library.ids(text).tolist() == library_ids(library, text)


def check_packed(rows, texts, library, capacity):
    """Whole documents in gapless sequences; the padding's share of all tokens."""
    whole = [np.array([*library_ids(library, text or ""), 1], "<u4") for _, text in texts]
    expected = collections.Counter()
    for (doc_id, _), ids in zip(texts, whole):
        for low in range(0, len(ids), capacity):
            some = ids[low : low + capacity]
            expected[doc_id, low, len(some), zlib.crc32(some.tobytes()), len(ids)] += 1
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == expected
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
        padding += capacity - end if end & (end - 1) else 0
    return padding / sum(len(ids) for ids in whole)


def test_query_packs_every_document(spark, texts, library):
    rows = queries.op13_packing(spark, SF).collect()
    assert check_packed(rows, [(i, t) for i, t, _ in texts], library, 2048) < 0.02


def test_odd_rows(spark, odd_docs, library):
    texts = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    clash = odd_docs.withColumnsRenamed({"fp": "TEXT", "length": "task"})
    spark.conf.set("spark.sql.caseSensitive", "false")
    for docs in (odd_docs, clash, odd_docs.repartition(5)):
        rows = histogram_packing.pack_documents(docs, capacity=64).collect()
        check_packed(rows, texts, library, 64)


def test_empty_table(spark, no_docs):
    out = histogram_packing.pack_documents(no_docs)
    assert out.count() == 0
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
