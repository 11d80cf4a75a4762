"""Packing, extraction, search, training order and the pipeline against plain versions."""

import collections
import html as html_module
import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import bm25, materialise, packing, queries, simhash, wrapper
from tests.llm.conftest import SF

# Extraction of pages that differ little


def extracted(spark, sources, host="h.org"):
    rows = [(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    return {r["page_id"]: r["text"] for r in wrapper.extract(frame).collect()}


def test_copies_keep_their_text(spark):
    marked = "<body><article><p>one story</p><p>its end</p></article></body>"
    assert set(extracted(spark, [marked] * 30).values()) == {"one story\n\nits end"}
    stories = [f"<div>site menu</div><div><p>story {i} begins</p><p>and ends {i}</p></div>" for i in range(10)]
    mirrored = stories + [s.replace("<body>", "") + f"<div>mirror {i}</div>" for i, s in enumerate(stories)]
    for i, text in extracted(spark, mirrored).items():
        assert f"story {i % 10} begins\n\nand ends {i % 10}" in text and "site menu" not in text


def test_nothing_is_lost_below_many_elements(spark):
    nest = "<div>" * 250 + "deep <nav>menu</nav><p>inner</p> rest" + "</div>" * 250
    page = f"<div><article><p>first</p>{nest}<p>after one</p></article><div>outside</div></div>"
    text = extracted(spark, [page])[0]
    assert text.split("\n\n") == ["first", "deep", "inner", "rest", "after one"]
    unmarked = f"<div><p>first</p>{'<div>' * 300}<article>story</article>{'</div>' * 300}<p>last</p></div>"
    assert extracted(spark, [unmarked])[0].split("\n\n") == ["first", "story", "last"]


def test_an_odd_page_is_no_wrapper(spark):
    pages = [
        f"<div class='top'>Buy our lamp now</div><h1>Title {i}</h1><div class='body'><p>Text {i} a</p><p>More {i}</p></div>"
        for i in range(29)
    ]
    for odd in ("", "<p>x", "<html></html>", None):
        got = extracted(spark, [*pages, odd])
        assert all("lamp" not in got[i] and f"Text {i} a" in got[i] for i in range(29))


def test_class_words_count_alone_or_together(spark):
    kept = ["share-price", "related-work", "notice-of-award", "search-results", "social-history", "modal-verbs", "ad-hoc"]
    gone = ["ad", "cookie-notice", "x comments", "social_share"]
    page = "<article>" + "".join(f"<p class='{c}'>{c} text</p>" for c in kept + gone) + "</article>"
    assert extracted(spark, [page])[0].split("\n\n") == [f"{c} text" for c in kept]


def test_each_layout_of_a_host_has_its_wrapper(spark):
    first = [
        f"<div class='top'>Buy our lamp now</div><h1>Title {i}</h1><div class='body'><p>Text {i} a</p><h2>Part {i}</h2></div>"
        for i in range(40)
    ]
    second = [
        f"<section class='wide'><ul><li>Sale ends soon</ul><blockquote>Quote {i}</blockquote><pre>Lines {i}</pre></section>"
        for i in range(12)
    ]
    third = [f"<table><tr><td>Win a trip<td>Cell {i}</table>" for i in range(8)]
    got = extracted(spark, first + second + third + ["<p>alone"])
    for i in range(40):
        assert got[i] == f"Title {i}\n\nText {i} a\n\nPart {i}"
    for i in range(12):
        assert got[40 + i] == f"Quote {i}\n\nLines {i}"
    assert [got[52 + i] for i in range(8)] == [f"Cell {i}" for i in range(8)]
    assert got[60] == "alone"


def test_layouts_beyond_the_last_lose_no_text(spark):
    kinds = ["section", "article-like", "x-a", "x-b", "x-c", "x-d", "x-e"]
    pages = [f"<{k} class='{k}'><div class='{k}-in'><p>{k} text {i}</p></div></{k}>" for k in kinds for i in range(6)]
    got = extracted(spark, pages)
    assert [got[n] for n in range(len(pages))] == [f"{k} text {i}" for k in kinds for i in range(6)]


def test_very_deep_and_very_wide_pages(spark):
    deep = "<div>" * 20_000 + "<p>end</p>" + "</div>" * 20_000 + "<p>after</p>"
    wide = [
        "<div>same top</div><ul>" + "".join(f"<li>{i} {j}{'<b>x</b>' * ((i * j) % 7)}" for j in range(1500)) + "</ul>"
        for i in range(1, 7)
    ]
    got = extracted(spark, [deep, "<p>x</i></b>" * 20_000], "deep.org")
    assert got[0] == "end\n\nafter" and got[1].count("x") == 20_000
    for i, text in extracted(spark, wide, "wide.org").items():
        blocks = text.split("\n\n")
        assert len(blocks) == 1500 and blocks[2].split("x")[0] == f"{i + 1} 2"


def plain_alignment(weights, m, n):
    """Alignment by the whole table of sums; of equal ones, the same choice on the way back."""
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weights[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("m, n", [(0, 3), (1, 1), (5, 7), (40, 3), (3, 40), (90, 70), (33, 33)])
def test_alignment_matches_the_whole_table(m, n):
    rng = np.random.default_rng(m * 100 + n)
    for _ in range(20):
        weights = (rng.integers(0, 6, (m, n)) * rng.integers(0, 2, (m, n))).tolist()
        assert wrapper.aligned(m, n, weights.__getitem__) == plain_alignment(weights, m, n)


def plain_score(a, b):
    """Simple tree matching of nested [label, children] as it is written down."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_score(x, y))
    return best[-1][-1] + 1


def test_matching_finds_as_many_nodes_as_possible():
    rng = np.random.default_rng(8)

    def grown(depth):
        kids = [grown(depth - 1) for _ in range(rng.integers(0, 5))] if depth else []
        return [str(rng.choice(["div", "section", "b"])), kids]

    def written(tree):
        return f"<{tree[0]}>{''.join(map(written, tree[1]))}</{tree[0]}>"

    for _ in range(150):
        one, other = (["html", [grown(4), grown(3)]] for _ in range(2))
        first, second = (wrapper.Page("".join(map(written, t[1]))) for t in (one, other))
        own = wrapper.Wrapper(json.dumps(wrapper.shape(first)), frozenset())
        found = wrapper.match(own, second)
        assert len(found) == len(set(found.values())) == plain_score(one, other)
        assert all(own.labels[a] == second.labels[b] for a, b in found.items())


# Packing


def plain_packing(lengths, sizes, least, attention):
    """Best fit by looking at every open bin; of equal rooms the one used last."""
    bins, where, used_at = [], [], {}
    for time, length in enumerate(lengths):
        open_bins = [i for i, (size, used) in enumerate(bins) if size - used >= length]
        if open_bins:
            room = min(bins[i][0] - bins[i][1] for i in open_bins)
            chosen = max((i for i in open_bins if bins[i][0] - bins[i][1] == room), key=used_at.get)
        else:
            allowed = [s for s in sizes if s >= max(least, length)]
            bins.append([min(allowed, key=lambda s: (packing.bin_cost(s, attention), s)), 0])
            chosen = len(bins) - 1
        bins[chosen][1] += length
        used_at[chosen] = time
        where.append(chosen)
    final = [min(s for s in sizes if s >= used) for _, used in bins]
    return where, final, sum(packing.bin_cost(s, attention) for s in final)


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(1)
    sizes = (8, 16, 32)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 33, 60))[::-1]
        plans = [plain_packing(lengths, sizes, s, 40.0) for s in sizes]
        _, final = packing.best_packing(lengths, sizes, 40.0)
        assert sum(packing.bin_cost(int(s), 40.0) for s in final) == min(p[2] for p in plans)
        for least, plan in zip(sizes, plans):
            used = [0] * len(plan[1])
            where, opened = packing.pack_items(lengths.tolist(), sizes, least, 40.0)
            for w, n in zip(where, lengths):
                used[w] += n
            expected = [0] * len(plan[1])
            for w, n in zip(plan[0], lengths):
                expected[w] += n
            assert sorted(used) == sorted(expected) and all(u <= o for u, o in zip(used, opened))


def check_packing(rows, lengths, sizes):
    pieces = {}
    bins = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_start"], r["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), held in bins.items():
        at = 0
        for begin, length in sorted(held):
            assert begin == at and length > 0
            at += length
        assert size == min(s for s in sizes if s >= at)
    for doc, total in lengths.items():
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == total


@pytest.mark.parametrize("shard_rows", [40, 50_000])
def test_every_document_is_packed_once(spark, texts, shard_rows):
    lengths = {i: len((t or "").encode().split()) for i, t, _ in texts}
    lengths[10**6] = 3 * 8192 + 5
    docs = spark.createDataFrame(list(lengths.items()), "doc_id bigint, n_tokens bigint")
    rows = packing.pack(docs, shard_rows=shard_rows).collect()
    check_packing(rows, lengths, packing.SIZES)


def test_packing_of_odd_rows(spark, no_docs):
    docs = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (2, None, "z"), (None, 0, "z"), (None, 7, "z")],
                                 "doc_id int, n_tokens int, bin_id string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 5 and sum(r["bin_id"] is None for r in rows) == 2
    assert sum(r["length"] for r in rows) == 17
    assert packing.pack(no_docs.withColumn("n_tokens", F.lit(1))).count() == 0


def test_packing_query_covers_the_table(spark, texts):
    lengths = {i: len((t or "").encode().split()) for i, t, _ in texts}
    check_packing(queries.op1_best_fit_packing(spark, SF).collect(), lengths, packing.SIZES)


# Extraction


def plain_article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"<p>|<h1>", inner)
    blocks = [re.sub(r"</?b>|</h1>|</p>", "", b.replace("<br>", " ")) for b in blocks]
    blocks = [" ".join(html_module.unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_main_text_of_the_pages(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in queries.op3_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for page, source in pages:
        assert got[page]["text"] == plain_article(source)
        assert got[page]["n_chars"] == len(got[page]["text"])


def test_constant_nodes_become_template(spark):
    """Pages without any landmark: what they share goes, what varies stays."""
    page = (
        "<html><body><div>Welcome to our site</div><div class='x'><p>Story {0} begins.<p>It ends {0}.</div>"
        "<div>Imprint &amp; terms</div></body></html>"
    )
    rows = [(i, f"https://a.example/{i}", page.format(f"n{i}")) for i in range(30)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    for r in got:
        assert r["text"] == f"Story n{r['page_id']} begins.\n\nIt ends n{r['page_id']}."


def test_tree_matching_aligns_lists():
    made = lambda s: wrapper.Page(s)
    own = wrapper.Wrapper(json.dumps(wrapper.shape(made("<div><p>a<h2>b</h2><p>c<ul><li>d</ul></div>"))), frozenset())
    page = made("<div><p>1<p>2<h2>3</h2><ul><li>4<li>5</ul></div>")
    found = wrapper.match(own, page)
    pairs = {(own.labels[a], page.text(b)) for a, b in found.items() if own.labels[a] in ("h2", "ul")}
    assert pairs == {("h2", "3"), ("ul", "4 5")}


def test_pages_of_odd_form(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (2, "https://x.example/", "plain &lt;text&gt; &eacute;"),
        (None, "ftp", "<p>a<script>if (a<b) {}</script><p class=comments>no<p>b  c<br>d"),
        (4, "https://x.example/", "<div>" * 5000 + "deep"),
        (5, "https://x.example/", "<article><header><h1>T</h1></header><p>x</p><form>f</form></article><p>y"),
        (6, "https://x.example/", "<p>unclosed <a href='x>y"),
    ]
    docs = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("old"))
    got = {(r["page_id"], r["url"]): r["text"] for r in wrapper.extract(docs).collect()}
    assert len(got) == len(rows)
    assert got[1, None] == "" and got[2, ""] == ""
    assert got[2, "https://x.example/"] == "plain <text> é"
    assert got[None, "ftp"] == "a\n\nb c d"
    assert got[4, "https://x.example/"] == "deep"
    assert got[5, "https://x.example/"] == "T\n\nx"
    assert wrapper.extract(docs.limit(0)).count() == 0


# Search


def test_search_matches_its_twin(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = duckdb.sql(bm25.TWIN)
    rows = queries.op6_bm25_search(spark, SF).select(*twin.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(twin.fetchall())


def plain_search(docs, k):
    """BM25 of every query against every document."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    average = sum(map(len, words.values())) / len(words)
    held = {}
    for own in words.values():
        for w in set(own):
            held[w] = held.get(w, 0) + 1
    out = {}
    for q, asked in words.items():
        scores = []
        for d, own in words.items():
            total = 0.0
            for w in set(asked) & set(own):
                idf = np.log(1 + (len(words) - held[w] + 0.5) / (held[w] + 0.5))
                n = own.count(w)
                total += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / average))
            if total:
                scores.append((-round(total, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def test_pruned_search_over_shards_is_exact(spark, monkeypatch, texts):
    docs = [(i, " ".join(t.split()[:120])) for i, t, _ in texts[:150]] + [(900, None), (901, ""), (902, "...")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = frame.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    monkeypatch.setattr(bm25, "SHARD_DOCS", 40)
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 60)
    got = {}
    for r in bm25.search(frame, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for query, expected in plain_search(docs, 3).items():
        assert [d for d, _ in got.get(query, [])] == [d for d, _ in expected]
        assert np.allclose([s for _, s in got.get(query, [])], [s for _, s in expected], atol=2e-6)


def test_very_long_queries_are_exact(spark, monkeypatch):
    """Near copies of 20,000 words as queries: scores far above those of common queries."""
    draw = np.random.default_rng(5)
    vocabulary = np.array([f"w{n}" for n in range(9_000)])
    long = draw.choice(vocabulary, 20_000)
    docs = []
    for i in range(90):
        words = long.copy()
        words[draw.integers(0, len(words), 3 + i % 4)] = draw.choice(vocabulary, 3 + i % 4)
        docs.append((i, " ".join(words if i % 3 else draw.choice(vocabulary, 40))))
    counted = {i: collections.Counter(t.split()) for i, t in docs}
    lengths = {i: sum(c.values()) for i, c in counted.items()}
    average = sum(lengths.values()) / len(docs)
    held = collections.Counter(w for c in counted.values() for w in c)
    idf = {w: np.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in held.items()}
    monkeypatch.setattr(bm25, "SHARD_DOCS", 50)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = frame.where("doc_id < 8").selectExpr("doc_id AS query_id", "text AS query_text")
    got = {}
    for r in bm25.search(frame, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for query in range(8):
        scores = []
        for i, own in counted.items():
            norm = 1.2 * (0.25 + 0.75 * lengths[i] / average)
            total = sum(idf[w] * own[w] * 2.2 / (own[w] + norm) for w in sorted(counted[query]) if w in own)
            if total:
                scores.append((-round(total, 6), i))
        expected = sorted(scores)[:10]
        assert [d for d, _ in got[query]] == [d for _, d in expected]
        assert np.allclose([s for _, s in got[query]], [-s for s, _ in expected], atol=2e-6)


def test_near_scores_keep_their_margin():
    """Many rows of one shard: the near totals against double precision."""
    draw = np.random.default_rng(6)
    size, terms = 64, 5_000
    held = draw.random((terms, size)) < 0.5
    starts = np.concatenate(([0], np.cumsum(held.sum(1))))
    docs = np.concatenate([np.flatnonzero(row) for row in held])
    counts = draw.integers(1, 400, len(docs))
    lengths = np.bincount(docs, counts, size).astype("<i4")
    row = {
        "ids": np.arange(size).astype("<i8"), "lengths": lengths, "terms": np.arange(terms).astype("<i8"),
        "starts": starts.astype("<i8"), "docs": docs.astype("<u2"), "counts": counts.astype("<i4"),
    }
    shard = bm25.Shard({name: array.tobytes() for name, array in row.items()}, float(lengths.mean()))
    weights = draw.random(terms) * 9
    near = bm25.Searcher(shard)._add(np.zeros(size), np.arange(terms), weights)
    exact = counts / (counts + shard.norm[docs]) * (bm25.K1 + 1) * np.repeat(weights, np.diff(starts))
    exact = np.bincount(docs, exact, size)
    assert exact.max() > 1_000
    assert (np.abs(near - exact) <= bm25.NEAR * exact).all()


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    asked = odd_docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    rows = bm25.search(odd_docs, asked, 5).collect()
    assert all(r["doc_id"] is not None and r["query_id"] not in (None, 2, 3, 4) for r in rows)
    assert bm25.search(no_docs, asked, 5).count() == 0
    assert bm25.search(odd_docs, asked.limit(0), 5).count() == 0


# Training order


@pytest.mark.parametrize("total", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(total):
    numbers = np.arange(total)
    slots = materialise.feistel(numbers, total, b"k")
    assert sorted(slots.tolist()) == numbers.tolist()
    if total > 60:
        assert slots.tolist() != materialise.feistel(numbers, total, b"l").tolist()


def test_files_hold_every_sequence_at_its_slot(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "order")
    index = materialise.sequence_slots(docs, path, record_ids=64, shard_bytes=64 * 50).collect()
    total = len(index)
    assert sorted(r["slot"] for r in index) == list(range(total))
    read = materialise.read_records(spark, path, 50, 64).collect()
    records = {r["slot"]: bytes(r["ids"]) for r in read}
    assert sorted(records) == list(range(total))
    whole = dict((i, t) for i, t, _ in texts)
    for r in index:
        record = materialise.byte_records((whole[r["doc_id"]] or "").encode(), 64)
        assert records[r["slot"]] == record[r["piece"] * 64 : (r["piece"] + 1) * 64]
        assert r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 64
        assert r["n_ids"] == len(records[r["slot"]].rstrip(b"\xff"))
    later = materialise.read_records(spark, path, 50, 64, first_slot=120).collect()
    assert sorted(r["slot"] for r in later) == list(range(120, total))
    files = sorted((tmp_path / "order").glob("part-*"))
    sizes = [f.stat().st_size for f in files]
    assert len(files) == -(-total // 50) and set(sizes[:-1]) == {64 * 50 + 1}


def test_training_order_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = materialise.sequence_slots(odd_docs, str(tmp_path / "a")).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["n_ids"] for r in rows) == sum(
        len((r["text"] or "").encode()) + 1 for r in odd_docs.collect()
    )
    assert materialise.sequence_slots(no_docs, str(tmp_path / "b")).count() == 0


def test_slots_hold_when_files_are_split_anew(spark, texts, tmp_path):
    """Splits change with the cores at hand; here by the session's least number of splits."""
    source, path = str(tmp_path / "docs"), str(tmp_path / "order")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(9).write.parquet(source)
    splits, cost = "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"
    old_cost = spark.conf.get(cost)
    try:
        spark.conf.set(splits, "2")
        spark.conf.set(cost, "1k")
        index = materialise.sequence_slots(spark.read.parquet(source), path, record_ids=64, shard_bytes=64 * 50)
        spark.conf.set(splits, "9")
        rows = index.collect()
    finally:
        spark.conf.unset(splits)
        spark.conf.set(cost, old_cost)
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    records = {r["slot"]: bytes(r["ids"]) for r in materialise.read_records(spark, path, 50, 64).collect()}
    whole = {i: (t or "").encode() for i, t, _ in texts}
    for r in rows:
        begin = r["piece"] * 64
        assert records[r["slot"]] == materialise.byte_records(whole[r["doc_id"]], 64)[begin : begin + 64]


def test_files_of_token_ids_read_back_by_their_manifest(spark, odd_docs, no_docs, tmp_path):
    import tokenizers

    from shelfwise.llm.tokens import vocabulary_path

    for name, docs, width in (
        ("word_bpe_49k.json", spark.read.parquet(f"{SF}/documents.parquet"), 2),
        ("word_bpe_49k.json", odd_docs, 2),
        ("byte_bpe_50k.json", odd_docs, 2),
    ):
        library = tokenizers.Tokenizer.from_file(vocabulary_path(name))
        library.no_truncation()
        library.no_padding()
        path = str(tmp_path / f"{name}-{docs.count()}")
        index = materialise.sequence_slots(
            docs, path, record_ids=64, shard_bytes=64 * 2 * 50, vocabulary=name, key=b"k"
        ).collect()
        facts = materialise.read_manifest(spark, path)
        assert (facts["sequences"], facts["id_bytes"], facts["records_a_file"]) == (len(index), width, 50)
        assert facts["end_id"] >= library.get_vocab_size() and facts["key"] == b"k".hex()
        records = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in materialise.read_order(spark, path).collect()}
        assert sorted(records) == list(range(len(index)))
        got = []
        for r in sorted(index, key=lambda r: (str(r["doc_id"]), r["piece"])):
            assert r["byte_offset"] == r["slot"] % 50 * 128 and r["shard"] == r["slot"] // 50
            assert (records[r["slot"]][r["n_ids"] :] == facts["padding_id"]).all()
            got.append((str(r["doc_id"]), r["piece"], records[r["slot"]][: r["n_ids"]].tolist()))
        expected = []
        for r in docs.select("doc_id", "text").collect():
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, facts["end_id"]]
            expected += [(str(r["doc_id"]), n // 64, ids[n : n + 64]) for n in range(0, len(ids), 64)]
        assert sorted(got) == sorted(expected)
        later = materialise.read_order(spark, path, first_slot=7).collect()
        assert sorted(r["slot"] for r in later) == list(range(7, len(index)))
    empty = str(tmp_path / "empty")
    assert materialise.sequence_slots(no_docs, empty, vocabulary="word_bpe_49k.json").count() == 0
    assert materialise.read_order(spark, empty).count() == 0


def test_a_missing_slot_fails(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    offsets, total = materialise.number_sequences(docs)
    with pytest.raises(Exception, match="counted to"):
        materialise.write_training_order(docs, str(tmp_path / "x"), (offsets, total + 1))


# Pipeline


def test_stages_match_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    sizes = [kept.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    rows = corpus_pipeline.run(spark, SF).collect()
    lengths = {r["doc_id"]: len(r["text"].encode().split()) for r in kept.collect()}
    check_packing(rows, lengths, packing.SIZES)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    ids = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    long = {r["doc_id"] for r in docs.collect() if len((r["text"] or "").split()) >= 20}
    assert all(i in ids for i, q in labels if q == 1 and i in long)


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for rows in (odd_docs, no_docs):
        kept = rows
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, kept, SF)
            kept = spark.createDataFrame(done.collect(), done.schema)
    # Two texts of one id are two documents; a repeated row is one.
    twice = odd_docs.where("doc_id = 1").unionByName(odd_docs.where("doc_id = 1"))
    assert corpus_pipeline.near_duplicates(spark, twice, SF).count() == 2


def test_one_of_each_group_of_near_copies_stays(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t, _ in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t, _ in texts}
    expected = {}
    for i in sorted(prints):  # a text's group is the one of any earlier text within two bits
        near = {expected[j] for j in expected if (prints[i] ^ prints[j]).bit_count() <= 2}
        group = min(near, default=i)
        expected = {j: group if g in near else g for j, g in expected.items()} | {i: group}
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got) == sorted(set(expected.values()))
    assert len(got) < len(rows)


def test_texts_without_an_id_each_stay(spark):
    rng = np.random.default_rng(5)
    made = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(5)]
    rows = [(None, made[0]), (None, made[1]), (None, made[1]), (None, made[2]), (7, made[3]), (None, made[3]), (8, made[4])]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    expected = sorted([(None, made[0]), (None, made[1]), (None, made[2]), (7, made[3]), (8, made[4])], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == expected
    done = corpus_pipeline.substrings(spark, kept, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in done.collect()), key=str) == expected
    sources = {r["text"]: r["source"] for r in done.collect()}
    assert sources[made[0]] == "s0" and sources[made[2]] == "s3" and sources[made[3]] == "s4"
