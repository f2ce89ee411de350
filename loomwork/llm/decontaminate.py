"""Benchmark decontamination by spaced-seed hashing.

Words are compared without case and punctuation.  Each mask of ``MASKS`` is
laid over every position of every benchmark item and of every text, the words
under its ones are hashed and those under its zeros ignored.  Test and training
hashes are joined; a text sends only the hashes that pass a bitmap of the
test hashes, whose size is fixed (``FILTER_WORDS`` longs at most), so that a
larger benchmark lets more through and nothing is lost.  Test hashes that the
same items hold at the same distances are one passage, and a text's hits on it
one row.  A hit gives a diagonal (text position less item position).  The texts
that have any are joined with their passages' items, and along each diagonal the
whole item is compared: the best run of matches and substitutions is kept.  The masks find every run of
13 words with two substitutions, of 15 with three and of 8 with none.  A run counts if it has
``LEAST`` matches, or four fifths of a shorter item, and at least ``IDENTITY``
of its positions match.

Defined results: null or empty texts match nothing; items of fewer than
``LEAST_ITEM`` words (the span of the shortest mask) are not searched for, as
texts share such phrases by chance; an item of fewer words than a mask is
searched by the shorter masks; of equally good runs (ties) the one on the least
diagonal counts; very long texts and items are read whole; a null id is passed
through; repeated rows match alike; an empty table, of texts or of items,
matches nothing; other columns, whatever their names, are ignored by
``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, id_text, map_batches, materialise, same_text, unlike
from loomwork.llm.bpe import small_batches

MASKS = ("11010010101", "11101011", "1110100011", "111001101")
LEAST, IDENTITY, LEAST_ITEM = 13, 0.75, min(map(len, MASKS))
FILTER_WORDS = 1 << 20
_CACHED = 1_000_000
_PLAIN = re.compile(r"[\W_]+")


class Words:
    """Hashes of a text's words; 0 for what has neither letter nor digit."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words, cache = text.lower().split(), self.cache
        if len(cache) > _CACHED:
            cache.clear()
        for w in set(words).difference(cache):
            plain = _PLAIN.sub("", w)
            cache[w] = (xxhash.xxh64_intdigest(plain.encode()) | 1) if plain else 0
        out = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        return out[out != 0]


_TIMES = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at each position: a linear form of the uniform word hashes."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, np.uint64(int(mask, 2) << 32), dtype=np.uint64)
    for j, k in enumerate(k for k, c in enumerate(mask) if c == "1"):
        out += words[k : k + n] * _TIMES[j]
    return out


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, stop) of the run with the most matches less twice its substitutions."""
    steps = np.cumsum(np.where(equal, 1, -2))
    before = np.concatenate([[0], steps[:-1]])
    least = np.minimum.accumulate(before)
    stop = int(np.argmax(steps - least))
    start = int(np.argmin(before[: stop + 1]))
    return int(equal[start : stop + 1].sum()), start, stop + 1


def _seed_rows(items: DataFrame) -> DataFrame:
    """seed, item_hash, place for every mask at every position of the items (text, item_hash)."""

    def run(batches):
        hashed = Words()
        for b in batches:
            for text, name in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = hashed(text)
                if len(w) < LEAST_ITEM:
                    continue
                for m in MASKS:
                    s = _seeds(w, m)
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32())], ["seed", "item_hash", "place"])

    return map_batches(items, run, "seed long, item_hash long, place int")


def _passages(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, p, q, origin) and (p, q, item_hash, delta, leads).

    Seeds that the same items hold at the same distances are one passage,
    named by two hashes of its (item, distance) pairs, so that a text meets the
    items of a passage once and not once for each of its seeds.  The item with
    the least hash leads; ``origin`` is the seed's place in it.
    """
    least = seeds.groupBy("seed").agg(F.min(F.struct("item_hash", "place")).alias("least"))
    far = seeds.join(least, "seed").withColumn("delta", F.col("place") - F.col("least.place"))
    named = far.groupBy("seed").agg(*[F.bit_xor(F.xxhash64(F.lit(n), "item_hash", "delta")).alias(n) for n in "pq"], F.min("least.place").alias("origin"))
    named = materialise(named, "seed-passages")
    leads = ((F.col("delta") == 0) & (F.col("item_hash") == F.col("least.item_hash"))).alias("leads")
    members = far.join(named, "seed").select("p", "q", "item_hash", "delta", leads).distinct()
    return named, materialise(members, "passage-items")


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds' leading bits, as 64-bit words, and the shift that finds a seed's bit.

    At least 32 bits for each seed, up to FILTER_WORDS words in all.
    """
    count = seeds.count()
    bits = min(max(12, (32 * max(1, count) - 1).bit_length()), (64 * FILTER_WORDS - 1).bit_length())
    place = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out, 64 - bits


def passes(seeds: np.ndarray, bitmap: np.ndarray, shift: int) -> np.ndarray:
    """The positions of the seeds that the bitmap lets through."""
    place = seeds >> np.uint64(shift)
    return np.flatnonzero((bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))


def _text_hits(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """_doc_id, _text_hash, seed, at of the texts' hashes that pass the bitmap of the test hashes."""
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def run(batches):
        hashed = Words()
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in small_batches(texts, 1 << 20):
                words = [hashed(t) for t in texts[part]]
                starts = np.cumsum([0, *map(len, words)])
                whole, found, where, which = np.concatenate(words), [], [], []
                for m in MASKS:
                    s = _seeds(whole, m)
                    at = passes(s, *bitmap.value)
                    text = np.searchsorted(starts, at, side="right") - 1
                    inside = at + len(m) <= starts[text + 1]
                    found.append(s[at[inside]])
                    where.append(at[inside] - starts[text[inside]])
                    which.append(text[inside] + part.start)
                take = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(where).astype(np.int32))], ["_doc_id", "_text_hash", "seed", "at"])

    named = rows.filter("text <> ''").select("doc_id", "text", F.xxhash64("text").alias("h"))
    return map_batches(named, run, "_doc_id long, _text_hash long, seed long, at int")


def verified(words: np.ndarray, own: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int, int] | None:
    """(matches, compared, item length, start in the text, start in the item) of the best run on the diagonals, if it counts."""
    best = None
    for d in sorted(diagonals):
        start, stop = max(0, -d), min(len(own), len(words) - d)
        n, a, b = best_run(own[start:stop] == words[start + d : stop + d])
        need = min(LEAST, -(-4 * len(own) // 5))
        if n >= need and n >= IDENTITY * (b - a) and (best is None or n > best[0]):
            best = (n, b - a, len(own), start + a + d, start + a)
    return best


class Hits:
    """What the texts of ``rows`` share with ``items`` (doc_id, text), before it is verified.

    ``shared``: _doc_id, _text_hash, p, q and how far the passage lies from its
    origin; ``members``: the passages' items; ``texts``: the texts with a hit and
    ``times``, the rows that repeat both id and text.
    """

    def __init__(self, rows: DataFrame, items: DataFrame):
        items = items.filter("text <> ''").withColumn("item_hash", F.xxhash64("text"))
        self.ids = items.select(F.col("doc_id").alias("item_id"), "item_hash").distinct()
        self.own = items.groupBy(F.col("item_hash").alias("ih")).agg(F.first("text").alias("item"))
        seeds = materialise(_seed_rows(items.dropDuplicates(["item_hash"]).select("text", "item_hash")), "seeds")
        named, self.members = _passages(seeds)
        hits = _text_hits(rows, named).join(named, "seed")
        self.shared = materialise(hits.select("_doc_id", "_text_hash", "p", "q", (F.col("at") - F.col("origin")).alias("off")).distinct(), "seed-hits")
        texts = rows.join(self.shared.select("_doc_id", "_text_hash").distinct(), same_text("doc_id", "text"), "left_semi")
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        self.texts = materialise(texts, "hit-texts")

    def verified(self, shared: DataFrame, members: DataFrame) -> DataFrame:
        """_doc_id, _text_hash, times, item_hash and the best run of each text and item of the passages that count."""
        each = shared.join(members, ["p", "q"]).groupBy("_doc_id", "_text_hash", "item_hash").agg(F.collect_set(F.col("off") - F.col("delta")).alias("diagonals"))
        names = ["n_matched", "n_compared", "item_words", "doc_start", "item_start"]

        def run(batches):
            hashed, known, words = Words(), None, None
            for b in batches:
                found = []
                for i, (text, item, diagonals) in enumerate(zip(*[b.column(k).to_pylist() for k in (4, 5, 6)], strict=True)):
                    if text != known:
                        known, words = text, hashed(text)
                    if (best := verified(words, hashed(item), diagonals)) is not None:
                        found.append((i, *best))
                cols = list(zip(*found, strict=True)) or [()] * 6
                take = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(4)], *[pa.array(c, pa.int32()) for c in cols[1:]]], [*b.schema.names[:4], *names])

        full = each.join(self.texts, F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_hash") == F.col("h")))
        full = full.join(self.own, F.col("item_hash") == F.col("ih"))
        schema = "_doc_id long, _text_hash long, times long, item_hash long, " + ", ".join(f"{n} int" for n in names)
        return map_batches(full.select("_doc_id", "_text_hash", "times", "item_hash", "text", "item", "diagonals"), run, schema)


def overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each text and item that overlap: doc_id, item_id, n_matched, n_compared, item_words, doc_start, item_start."""
    hits = Hits(id_text(df, id_col, text_col), id_text(benchmark, item_col, item_text_col))
    found = hits.verified(hits.shared, hits.members).join(hits.ids, "item_hash")
    each = found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(F.col("_doc_id").alias("doc_id"), "item_id", "n_matched", "n_compared", "item_words", "doc_start", "item_start")


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text overlaps no item, with all their columns.

    A text is first compared with the leading item of each passage that it
    shares; only what overlaps none of these meets the passages' other items.
    """
    hits = Hits(id_text(df, id_col, text_col), id_text(benchmark, item_col, item_text_col))
    gone = materialise(hits.verified(hits.shared, hits.members.filter("leads")).select("_doc_id", "_text_hash").distinct(), "overlaps")
    left = hits.shared.alias("s").join(gone.alias("g"), F.col("s._doc_id").eqNullSafe(F.col("g._doc_id")) & (F.col("s._text_hash") == F.col("g._text_hash")), "left_anti")
    more = materialise(hits.verified(left, hits.members.filter("not leads")).select("_doc_id", "_text_hash").distinct(), "overlaps")
    key, text_hash = unlike(df, "_doc_id"), unlike(df, "_text_hash")
    gone = gone.union(more).select(F.col("_doc_id").alias(key), F.col("_text_hash").alias(text_hash))
    return df.join(gone, same_text(id_col, text_col, key, text_hash), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
