"""Quality rules with adaptive thresholds, in column functions only.

Each document gets counts of its words, symbols, repeated lines and repeated word windows. Two
fixed rules hold for all (too few words, too many repeated ones). The others have no fixed
cutoff: per language and source a quantile sketch of each measure is kept, and a document
fails that lies beyond its group's fence, which is the upper quartile plus ``SPREAD`` times
the distance of the quartiles (the lower quartile minus it for the lower fence), a least
distance for groups without spread included.

The sketch is a histogram over bins of integers that keep the first seven bits of a value, so
a quantile is exact below 128 and within 1/64 above. Sketches merge by adding counts: groups
of fewer than ``GROUP_ROWS`` rows use the merged sketch of their language, and those of the whole
table if that is small as well. Counting is combined map-side, so a source that holds a third
of all rows costs a row per bin and task; sketches have a bounded number of bins a group.

Null and empty texts have no words and fail. NULL languages and sources are groups of their
own. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import settled, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
SPREAD = 3
GROUP_ROWS = 100
#: measure, least distance of the upper fence, least distance of the lower one (None: no fence)
MEASURES = (("symbols", 50, None), ("word_length", 150, 150), ("dup_lines", 400, None))
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _paired(hashes: Column, apart: int) -> Column:
    """Hashes of the pairs of elements so far apart."""
    size = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(
        F.slice(hashes, 1, size), F.slice(hashes, apart + 1, size), lambda a, b: F.xxhash64(a, b)
    )


def _with_repeated_words(rows: DataFrame) -> DataFrame:
    """Replaces the window hashes ``_h`` by n_repeat_words.

    Each step is a column of its own, since an array inside a lambda is computed anew for
    every element. Texts without a repeated window have empty arrays from the first step on.
    """
    rest = [c for c in rows.columns if c != "_h"]
    ranked = F.array_sort(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.select(*rest, F.when(repeats, ranked).alias("_ranked"))
    near = lambda x, i: F.get("_ranked", i)["h"] == x["h"]
    twice = F.transform(
        "_ranked", lambda x, i: F.when(near(x, i - 1) | near(x, i + 1), x["p"])
    )
    rows = rows.select(*rest, F.array_sort(F.array_compact(twice)).alias("_places"))
    steps = F.transform(
        "_places",
        lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW))),
    )
    total = F.aggregate(steps, F.lit(0), lambda sum_, x: sum_ + x)
    count = F.coalesce(total, F.lit(0)).cast("bigint")
    # The condition always holds; as it is not deterministic, filters on the verdict stay above
    # and do not multiply these nested arrays by inlining them.
    here = F.monotonically_increasing_id() >= 0
    return rows.select(*rest, F.when(here, count).alias("n_repeat_words"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in docs.columns if c not in OWN]
    base = docs.select(
        *kept, words_of(text).alias("_words"), lines.alias("_lines"), text.alias("_text")
    )
    counted = base.select(
        *kept,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", "")))
        .cast("bigint")
        .alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    for apart in (1, 2, 4):
        rest = [c for c in counted.columns if c != "_h"]
        counted = counted.select(*rest, _paired(F.col("_h"), apart).alias("_h"))
    return _with_repeated_words(counted)


def _measure(name: str) -> Column:
    """A measure as an integer; 0 for a text without words or lines."""
    words = F.greatest("n_words", F.lit(1))
    by = {
        "symbols": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(_n_lines, 1)"),
    }
    return F.coalesce(by[name], words * 0)


def _bin(value: Column) -> Column:
    """The least value whose first seven bits are those of this one."""
    width = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2), width).cast("bigint")
    return value - value % unit


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bin, n): the mergeable quantile sketch of each group and measure."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), _bin(F.col(f"_m_{name}")).alias("bin"))
            for name, _, _ in MEASURES
        ]
    )
    cells = rows.select(*keys, F.explode(pairs).alias("cell"))
    return cells.groupBy(*keys, "cell.measure", "cell.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, low_<measure>, high_<measure>): each group's fences from its sketch."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumn("up_to", F.sum("n").over(group.orderBy("bin")))
    ranked = ranked.withColumn("total", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * q, F.col("bin")))
    per = ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    distance = (F.col("q3") - F.col("q1")) * SPREAD
    columns = []
    for name, above, below in MEASURES:
        own = F.col("measure") == name
        high = F.col("q3") + F.greatest(distance, F.lit(above))
        columns.append(F.max(F.when(own, high)).alias(f"high_{name}"))
        if below is not None:
            low = F.col("q1") - F.greatest(distance, F.lit(below))
            columns.append(F.max(F.when(own, low)).alias(f"low_{name}"))
    return per.groupBy(*keys).agg(F.max("total").alias("total"), *columns)


def _merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Fences of every (language, source), from the narrowest group with enough rows.

    The sketches are checkpointed, and the fences of the whole table, one row, are read to
    become literals.
    """
    measures = [f"_m_{name}" for name, _, _ in MEASURES]
    groups = rows.select(
        F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), *measures
    )
    own = settled(sketches(groups, ["_lang", "_source"]))
    narrow = fences(own, ["_lang", "_source"])
    middle = fences(_merged(own, ["_lang"]), ["_lang"])
    whole = fences(_merged(own, []), []).first()
    names = [c for c in narrow.columns if c.startswith(("low_", "high_"))]
    middle = middle.select(
        F.col("_lang").alias("_l"),
        F.col("total").alias("_mt"),
        *[F.col(c).alias(f"_m_{c}") for c in names],
    )
    joined = narrow.join(middle, F.col("_lang").eqNullSafe(F.col("_l")))
    chosen = [
        F.when(F.col("total") >= GROUP_ROWS, F.col(c))
        .when(F.col("_mt") >= GROUP_ROWS, F.col(f"_m_{c}"))
        .otherwise(F.lit(whole[c] if whole else None).cast("bigint"))
        .alias(f"_{c}")
        for c in names
    ]
    return joined.select(F.col("_lang").alias("_tl"), F.col("_source").alias("_ts"), *chosen)


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """All columns of the rows, the counts, base_failed and kept (columns of those names go, in any case)."""
    # Columns by place, since their names may differ from each other or from ours by case only.
    names, own = docs.columns, {c.lower() for c in OWN}
    text_col, lang_col, source_col = (f"c{names.index(c)}" for c in (text_col, lang_col, source_col))
    rows = measured(docs.toDF(*[f"c{i}" for i in range(len(names))]), text_col)
    rows = rows.select("*", *[_measure(name).alias(f"_m_{name}") for name, _, _ in MEASURES])
    limits = thresholds(rows, lang_col, source_col)
    joined = rows.join(
        limits,
        F.col(lang_col).eqNullSafe(F.col("_tl")) & F.col(source_col).eqNullSafe(F.col("_ts")),
        "left",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED
    )
    within = F.lit(True)
    for name, _, below in MEASURES:
        within &= F.col(f"_m_{name}") <= F.col(f"_high_{name}")
        if below is not None:
            within &= F.col(f"_m_{name}") >= F.col(f"_low_{name}")
    kept = [i for i, c in enumerate(names) if c.lower() not in own]
    out = joined.select(
        *[f"c{i}" for i in kept],
        *OWN[:5],
        failed.alias("base_failed"),
        (~failed & F.coalesce(within, F.lit(True))).alias("kept"),
    )
    return out.toDF(*[names[i] for i in kept], *OWN)


#: The same rows in DuckDB; it counts repeated windows by joining positions.
TWIN = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 6),
         lambda i: {'p': i, 's': array_to_string(w[i:i + 7], ' ')}), recursive := true) FROM d WHERE len(w) >= 8),
twice AS (
  SELECT doc_id, p FROM wins
  QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
reps AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN reps USING (doc_id)),
x AS (
  SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols,
         word_chars * 100 // greatest(n_words, 1) AS word_length,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines FROM m),
cells AS (
  SELECT lang, source, measure, v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bin
  FROM (SELECT lang, source, unnest(['symbols', 'word_length', 'dup_lines']) AS measure,
               unnest([symbols, word_length, dup_lines]) AS v FROM x)),
levels AS (
  SELECT 2 AS level, lang, source, measure, bin FROM cells
  UNION ALL SELECT 1, lang, NULL, measure, bin FROM cells
  UNION ALL SELECT 0, NULL, NULL, measure, bin FROM cells),
q AS (
  SELECT level, lang, source, measure, count(*) AS total,
         quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3
  FROM levels GROUP BY ALL),
f AS (
  SELECT g.lang, g.source, g.measure,
         CASE WHEN g.total >= 100 THEN g.q1 WHEN a.total >= 100 THEN a.q1 ELSE z.q1 END AS q1,
         CASE WHEN g.total >= 100 THEN g.q3 WHEN a.total >= 100 THEN a.q3 ELSE z.q3 END AS q3
  FROM (FROM q WHERE level = 2) g
  JOIN (FROM q WHERE level = 1) a ON a.measure = g.measure AND a.lang IS NOT DISTINCT FROM g.lang
  JOIN (FROM q WHERE level = 0) z ON z.measure = g.measure),
s AS (
  SELECT doc_id, bool_and(CASE f.measure
           WHEN 'symbols' THEN symbols <= q3 + greatest(3 * (q3 - q1), 50)
           WHEN 'dup_lines' THEN dup_lines <= q3 + greatest(3 * (q3 - q1), 400)
           ELSE word_length BETWEEN q1 - greatest(3 * (q3 - q1), 150)
                AND q3 + greatest(3 * (q3 - q1), 150) END) AS fine
  FROM x JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source
  GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND fine AS kept
FROM x JOIN s USING (doc_id)
"""
