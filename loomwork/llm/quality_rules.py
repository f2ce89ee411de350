"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document gets counts over its whole text.  Each rule's rate is an integer
(per mille or hundredths) and falls into a log-linear bin: the sketch of a
group is its count for each bin, so sketches merge by addition and a quantile
is off by 1/128 of its value at most.  Sketches are kept per (language, source),
merged into one per language and one for all, and each group takes its fences
from the finest of the three that has ``min_group`` documents:

    high = max(q75 + reach * (q75 - q25), upper tail quantile of the rule)
    low  = min(q25 - reach * (q75 - q25), lower tail quantile of the rule)

So fences come from the sketches alone.  A rule's tail quantile decides where
most of a group has nothing to count and the quartiles are equal: no more than
that share of the group can then be rejected by it.  Counting needs no shuffle;
the sketches shuffle a few rows for each group.

Defined results: a null text counts as empty and fails the base rule; a null
language or source is its own group (the empty string); rows with a null id and
repeated rows are judged like any other, and rows at a fence (ties) are kept;
very long texts are counted whole; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``judge`` and kept by
``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm._shared import SPACE, documents, materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rule: (numerator, denominator, scale, lower tail or None, upper tail; tails in per mille of a group).
RULES = {
    "word_len": ("word_chars", "n_words", 100, 50, 950),
    "symbols": ("n_symbols", "n_words", 1000, None, 920),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, None, 990),
    "repeats": ("n_repeat_words", "n_words", 1000, None, 990),
}
MIN_GROUP, REACH = 50, 3


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of five that the text has twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(let(pairs, places), total))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def count(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the counts and ``base_failed``, their names after ``prefix``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    counted = let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(x["w"]).alias("n_repeat_words"),
        ),
    )
    own = f"{prefix}_counted"
    out = df.withColumn(own, counted).withColumns(
        {
            f"{prefix}word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            f"{prefix}n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns({f"{prefix}{n}": F.col(own)[n] for n in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words")}).drop(own)
    n = F.col(f"{prefix}n_words")
    return out.withColumn(f"{prefix}base_failed", (n < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * n))


def rate(rule: str, prefix: str = "") -> Column:
    top, bottom, scale, _, _ = RULES[rule]
    return F.call_function("div", F.col(prefix + top) * scale, F.greatest(F.col(prefix + bottom), F.lit(1)))


def bin_floor(x: Column) -> Column:
    """The least value of the bin of x: its 8 leading bits."""
    cut = F.greatest(F.lit(0), F.length(F.bin(x)) - 8)
    return F.call_function("shiftleft", F.call_function("shiftright", x, cut), cut)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: the mergeable sketch of every group."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), bin_floor(rate(r)).alias("bin")) for r in RULES])
    rows = counted.filter(~F.col("base_failed")).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """One row for each (lang, source): <rule>_low and <rule>_high of every rule."""
    none = F.lit("")
    levels = F.array(
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("a"), F.col("source").alias("b")),
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("a"), none.alias("b")),
        F.struct(F.lit(3).alias("level"), none.alias("a"), none.alias("b")),
    )
    merged = sketch.select("rule", "bin", "n", F.inline(levels)).groupBy("level", "a", "b", "rule", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "a", "b", "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    tail = lambda k: F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[k])])[F.col("rule")]
    at = lambda p: F.min(F.when(1000 * F.col("upto") >= p * F.col("all"), F.col("bin")))
    quantiles = ranked.groupBy("level", "a", "b", "rule").agg(
        at(250).alias("q25"), at(750).alias("q75"), at(F.coalesce(tail(3), F.lit(0))).alias("q_low"), at(tail(4)).alias("q_high"), F.max("all").alias("all")
    )
    spread = reach * (F.col("q75") - F.col("q25"))
    fences = quantiles.select(
        "level", "a", "b", "rule", "all",
        F.least(F.col("q25") - spread, F.col("q_low")).alias("low"),
        F.greatest(F.col("q75") + spread, F.col("q_high")).alias("high"),
    )
    groups = sketch.select("lang", "source").distinct()
    choice = groups.select("lang", "source", F.inline(levels)).join(fences, ["level", "a", "b"])
    fit = (F.col("level") == 3) | (F.col("all") >= min_group)
    best = choice.filter(fit).groupBy("lang", "source", "rule").agg(F.min_by(F.struct("low", "high"), "level").alias("f"))
    pick = lambda r, side: F.max(F.when(F.col("rule") == r, F.col("f")[side])).alias(f"{r}_{side}")
    return best.groupBy("lang", "source").agg(*[pick(r, side) for r in RULES for side in ("low", "high")])


def verdict(prefix: str = "") -> Column:
    """Whether a counted row that has its group's fences is kept."""
    ok = ~F.col(f"{prefix}base_failed")
    for r, (_, _, _, low, _) in RULES.items():
        x = bin_floor(rate(r, prefix))
        ok &= F.coalesce(x <= F.col(f"{prefix}{r}_high"), F.lit(True))
        if low is not None:
            ok &= F.coalesce(x >= F.col(f"{prefix}{r}_low"), F.lit(True))
    return ok


def _group(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, the group's fences and kept."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _group(lang_col).alias("lang"), _group(source_col).alias("source"))
    counted = materialise(count(rows).drop("text"), "quality-counts")
    return counted.join(thresholds(sketches(counted)), ["lang", "source"], "left").withColumn("kept", verdict())


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns.

    Rows are written with their counts, so that texts are counted once and not
    shuffled; the fences, a row for each group, are written too, so that their
    size is known when they are joined.
    """
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    marked = materialise(count(df, text_col, prefix).withColumns({f"{prefix}lang": _group(lang_col), f"{prefix}source": _group(source_col)}), "quality-counts")
    names = ["lang", "source", "base_failed", *{n for v in RULES.values() for n in v[:2]}]
    fences = materialise(thresholds(sketches(marked.select([F.col(prefix + n).alias(n) for n in names]))), "quality-fences")
    joined = marked.join(fences.select([F.col(c).alias(prefix + c) for c in fences.columns]), [f"{prefix}lang", f"{prefix}source"], "left")
    return joined.filter(verdict(prefix)).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rowid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
each AS (SELECT rowid AS r, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
win AS (
  SELECT r, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o] AS g, lead(x, 4) OVER o AS x5
  FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE x5 IS NOT NULL),
rep AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice WHERE c > 1) GROUP BY r),
c AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.r = rowid),
m AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         (word_chars * 100) // greatest(n_words, 1) AS x1, (n_symbols * 1000) // greatest(n_words, 1) AS x2,
         (n_dup_lines * 1000) // greatest(n_lines, 1) AS x3, (n_repeat_words * 1000) // greatest(n_words, 1) AS x4
  FROM c),
b AS (
  SELECT doc_id, lang, source, base_failed, unnest([1, 2, 3, 4]) AS rule, unnest([x1, x2, x3, x4]) AS x,
         unnest([50, 0, 0, 0]) AS lower, unnest([950, 920, 990, 990]) AS upper, id
  FROM (SELECT *, row_number() OVER () AS id FROM m)),
v AS (SELECT *, (x >> greatest(0, length(bin(x)) - 8)) << greatest(0, length(bin(x)) - 8) AS bin FROM b),
lev AS (
  SELECT 1 AS level, lang AS a, source AS b, rule, bin, lower, upper FROM v WHERE NOT base_failed
  UNION ALL SELECT 2, lang, '', rule, bin, lower, upper FROM v WHERE NOT base_failed
  UNION ALL SELECT 3, '', '', rule, bin, lower, upper FROM v WHERE NOT base_failed),
cnt AS (SELECT level, a, b, rule, bin, lower, upper, count(*) AS n FROM lev GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, a, b, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, a, b, rule) AS total FROM cnt),
q AS (
  SELECT level, a, b, rule, max(total) AS total, min(CASE WHEN 100 * upto >= 25 * total THEN bin END) AS q25,
         min(CASE WHEN 100 * upto >= 75 * total THEN bin END) AS q75, min(CASE WHEN 1000 * upto >= lower * total THEN bin END) AS q_low,
         min(CASE WHEN 1000 * upto >= upper * total THEN bin END) AS q_high FROM cum GROUP BY level, a, b, rule),
f AS (SELECT *, least(q25 - 3 * (q75 - q25), q_low) AS low, greatest(q75 + 3 * (q75 - q25), q_high) AS high FROM q),
j AS (
  SELECT v.id, v.rule, bin, arg_min(low, level) AS low, arg_min(high, level) AS high
  FROM v JOIN f ON f.rule = v.rule AND (level = 3 OR (total >= 50 AND a = lang AND (level = 2 OR b = source)))
  GROUP BY ALL),
bad AS (SELECT id FROM j WHERE bin > high OR (rule = 1 AND bin < low) GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND bad.id IS NULL) AS kept
FROM (SELECT *, row_number() OVER () AS id FROM m) x LEFT JOIN bad ON bad.id = x.id
"""
