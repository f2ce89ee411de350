"""Cleaning of archive cells: splitting, normalising, recoding, deduplicating."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that mean an empty cell, and labels that name no topic.
EMPTY = ("", "nan", "none", "<na>")
EXCLUDED = ("", "ALL", "OTHER")


def split_cell(c: Column, delimiter: str) -> Column:
    """Trimmed non-empty tokens of a delimited cell; a null or wholly empty cell has none."""
    parts = F.filter(F.transform(F.split(c, F.lit(f"\\Q{delimiter}\\E")), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*EMPTY), F.array().cast("array<string>")).otherwise(parts)


def split_list(c: Column) -> Column:
    """Trimmed tokens of a list cell without those that mean empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*EMPTY))


def topic_label(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("envirom"), F.lit("environ"))


def is_excluded(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(*EXCLUDED)


def clean_topics(c: Column, delimiter: str = "\t") -> Column:
    """The topics of a cell, normalised and without the excluded ones."""
    return F.filter(F.transform(split_cell(c, delimiter), topic_label), lambda x: ~is_excluded(x))


def clean_cell(c: Column, delimiter: str = "\t") -> Column:
    """The cell rebuilt from its clean topics; null if none is left."""
    return F.nullif(F.array_join(clean_topics(c, delimiter), delimiter), F.lit(""))


def canonical_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, underscores and runs of spaces as one space."""
    return df.toDF(*[" ".join(c.lower().replace("_", " ").split()) for c in df.columns])


def with_aliases(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Where one name of a pair is missing it becomes a copy of the other."""
    for a, b in pairs:
        if a in df.columns and b not in df.columns:
            df = df.withColumn(b, F.col(f"`{a}`"))
        elif b in df.columns and a not in df.columns:
            df = df.withColumn(a, F.col(f"`{b}`"))
    return df


def recode(c: Column, labels: Mapping[str, str]) -> Column:
    """The label's new name, or itself."""
    if not labels:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[c], c)


def as_int(df: DataFrame, column: str) -> DataFrame:
    """The column as an integer; rows where it is none go."""
    return df.withColumn(column, F.col(column).try_cast("double").cast("int")).dropna(subset=[column])


def node_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def _bare_letters() -> tuple[str, str]:
    """Every character whose compatibility decomposition is one ASCII character and marks, and that character; and the rest of its kind."""
    from sys import maxunicode
    from unicodedata import combining, normalize

    plain = {}
    for code in range(128, maxunicode + 1):
        c = chr(code)
        parts = [x for x in normalize("NFKD", c) if not combining(x)]
        if len(parts) == 1 and parts[0] < "\x80":
            plain[c] = parts[0]
    return "".join(plain), "".join(plain.values())


def ascii_letters(c: Column) -> Column:
    """NFKD without what is not ASCII: letters lose their marks, wide and stylised forms become plain ones, all else beyond ASCII goes.

    Characters that decompose into several (ligatures, fractions) go too, but
    for the ligatures of f and the digraphs listed.
    """
    for long, short in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ĳ": "ij", "Ĳ": "IJ", "…": "...", "™": "TM", "№": "No"}.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.regexp_replace(F.translate(c, *_bare_letters()), r"[^\x00-\x7F]", "")


def plain_name(c: Column) -> Column:
    """A name for matching: no accents, ``&`` as and, no quotes, brackets or signs."""
    flat = F.lower(ascii_letters(c))
    flat = F.regexp_replace(F.regexp_replace(F.replace(flat, F.lit("&"), F.lit(" and ")), r"\([^)]*\)", " "), r"['’`\"]", "")
    return F.trim(F.regexp_replace(flat, r"[^a-z0-9]+", " "))


def wrapped(c: Column, width: int, lines: int) -> Column:
    """The words in lines of at most ``width`` characters (a longer word has its own), joined by newlines; words beyond ``lines`` lines become an ellipsis.

    The last line then ends in three dots, and loses its own end if it has no room for them.
    """
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    empty = F.array().cast("array<string>")

    def add(state: Column, w: Column) -> Column:
        last = F.element_at(state, -1)
        joined = F.concat(last, F.lit(" "), w)
        fits = F.length(joined) <= width
        return F.when(F.size(state) == 0, F.array(w)).when(fits, F.concat(F.slice(state, 1, F.size(state) - 1), F.array(joined))).otherwise(F.concat(state, F.array(w)))

    folded = F.aggregate(words, empty, add)
    last = folded[lines - 1]
    cut = F.when(F.length(last) >= width - 1, F.rtrim(F.substring(last, 1, max(1, width - 2)))).otherwise(last)
    short = F.concat(F.slice(folded, 1, lines - 1), F.array(F.concat(F.regexp_replace(cut, r"\.+$", ""), F.lit("..."))))
    return F.array_join(F.when(F.size(folded) <= lines, folded).otherwise(short), "\n")


def short_label(c: Column, words: Mapping[str, str], width: int) -> Column:
    """Words replaced by shorter ones in order, then cut to ``width`` characters with an ellipsis."""
    for long, short in words.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.when(F.length(c) > width, F.concat(F.rtrim(F.substring(c, 1, width - 1)), F.lit("…"))).otherwise(c)


def canonical_code(*labels: Column, separator: str = "-") -> Column:
    """The labels sorted and joined: the same for any order."""
    return F.array_join(F.array_sort(F.array(*labels)), separator)


def explode_activity(df: DataFrame, doc: str, actors: Column, topics: Column, keep: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Distinct (doc, keep, actor, topic): every actor of a document with every topic of it.

    ``once``: no two rows have the same doc and keep.  The lists are then made
    distinct row by row, and the pairs, many more than the rows, are not grouped.
    """
    listed = F.array_distinct if once else lambda c: c
    rows = df.select(doc, *keep, F.explode(listed(topics)).alias("topic"), listed(actors).alias("_actors"))
    pairs = rows.select(doc, *keep, F.explode("_actors").alias("actor"), "topic")
    return pairs if once else pairs.distinct()


def drop_duplicate_documents(df: DataFrame, identity: Sequence[str], fallback: Sequence[str] = (), enabled: bool = True) -> DataFrame:
    """One row for each document.

    The identity columns present decide, or the fallback ones if none of the
    first is there; lists count by their sorted elements and nulls are equal.
    Not ``enabled``, every row stays.
    """
    names = [c for c in identity if c in df.columns] or [c for c in fallback if c in df.columns]
    if not enabled or not names:
        return df
    kinds = dict(df.dtypes)
    keys = {f"_key{k}": F.array_join(F.array_sort(F.col(f"`{c}`")), "\x1f") if kinds[c].startswith("array") else F.col(f"`{c}`") for k, c in enumerate(names)}
    return df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)


def recode_to_groups(df: DataFrame, members: Column, groups: DataFrame, doc: str, member: str = "actor", group: str = "community") -> DataFrame:
    """doc and the sorted distinct groups of its members."""
    rows = df.select(doc, F.explode(members).alias(member)).join(groups, member)
    return rows.groupBy(doc).agg(F.array_sort(F.collect_set(group)).alias("groups"))
