"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1.  Every row gets a key of its own, and its text becomes the set of its
    distinct word shingles, as 64-bit hashes: a 128-bit fingerprint of the set,
    its size and a signature of ``HASHES`` minima.  Rows with equal sets form a
    class; one row of each class goes on.
2.  Bands of the signature put classes into buckets.  The bands are as many
    rows high as keeps the chance to miss a pair at the threshold below
    ``MISS``.  The sets of the classes that share a bucket are written once.
3.  A candidate pair's signatures are compared in batches of ``BATCH``; after
    each, the pair goes if the posterior probability (uniform prior) that its
    similarity reaches the threshold is below ``PRUNE``.  Survivors are
    verified on their full sets.
4.  First every class is compared with the centre of each of its buckets, the
    class that meets most others in all its buckets.  Links give components.
5.  The buckets that still hold several components go, with sets and
    signatures, to workers that compare every pair of different components in
    them (batches first, then full sets) and join components as they go, so
    that a pair within a component is never looked at and no more links leave
    than there are classes.  Buckets of over ``TILE`` classes or
    ``TILE_SHINGLES`` shingles are cut into tiles and compared tile by tile.

So no table of pairs is ever made beyond one pair for each class and bucket,
and a pair that shares a bucket is compared or already joined: what is missed,
bands and pruning miss.

Defined results: a text without words has no shingles, is linked with nothing
and is its own component; a text of fewer words than a shingle has its whole
sequence as one shingle; very long texts are read whole; rows with a null id
take part like others, and a component's id is its least known one (null if it
has none); rows that repeat an id are told apart by their text, rows that
repeat both are copies; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, id_text, map_batches, materialise, same_text, unlike
from loomwork.llm.components import connected_components

HASHES, BATCH, MISS, PRUNE = 100, 20, 2e-5, 1e-5
TILE, TILE_SHINGLES = 1024, 2_000_000
_CACHED = 1_000_000


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def _spread(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        cache = self.cache
        if len(cache) > _CACHED:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _spread(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(out)


@lru_cache
def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607 + count)
    return r.integers(0, 2**63, (count, 1), dtype=np.uint64), r.integers(0, 2**63, (count, 1), dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The minima of ``count`` hash functions over the set."""
    xor, times = _seeds(count)
    least = np.full(count, np.uint64(2**64 - 1), dtype=np.uint64)
    step = max(1, 102_400 // count)
    for i in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[i : i + step] ^ xor) * times).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def band_keys(signs: np.ndarray, rows: int) -> np.ndarray:
    """Hashes [documents, bands] of bands of ``rows`` minima."""
    count = signs.shape[1] // rows
    signs = signs[:, : count * rows].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(signs), count)).copy()
    for k in range(rows):
        key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, k::rows])
    return key.view(np.int64)


def band_rows(threshold: float, miss: float = MISS) -> int:
    """The highest bands of HASHES minima that miss a pair at the threshold with at most this chance."""
    ok = [r for r in range(1, 9) if (1 - threshold**r) ** (HASHES // r) <= miss]
    return max(ok, default=1)


def least_matches(threshold: float, prune: float = PRUNE) -> list[tuple[int, int]]:
    """(compared, least matches) after each batch: below it the posterior P(similarity >= threshold) is under ``prune``.

    With a uniform prior, m matches of n make it P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < prune:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(df: DataFrame, size: int) -> DataFrame:
    """For rows (doc_id, text): doc_id, text_hash, n_shingles, f0, f1 (fingerprint of the set), signature."""

    def run(batches):
        hashed = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                sizes, prints, signs = [], [], []
                for text in part.column(2).to_pylist():
                    h = shingle_hashes(hashed(words_of(text or "")), size)
                    sizes.append(len(h))
                    prints.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    signs.append(signature(h).tobytes() if len(h) else None)
                two = np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(signs, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "f0", "f1", "signature"],
                )

    keyed = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(keyed, run, "doc_id long, text_hash long, n_shingles long, f0 long, f1 long, signature binary")


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    """bucket, cls for every band of every class."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                key = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u4").reshape(b.num_rows, HASHES), rows)
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids, pa.int64())], ["bucket", "cls"])

    return map_batches(classes.select("cls", "signature"), run, "bucket long, cls long")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, signature, hashes (the sorted shingles) of the wanted classes (cls, doc_id, text_hash, signature)."""

    def run(batches):
        hashed, seen = WordHashes(), set()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                new = [i for i, c in enumerate(part.column(0).to_pylist()) if not (c in seen or seen.add(c))]  # rows may repeat id and text
                part = part.take(pa.array(new, pa.int64()))
                sets = [shingle_hashes(hashed(words_of(t)), size).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["cls", "signature", "hashes"])

    named = wanted.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    texts = rows.filter(F.col("text").isNotNull()).join(named, same_text("doc_id", "text"))
    return map_batches(texts.select("cls", "signature", "text"), run, "cls long, signature binary, hashes binary")


def _survivors(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures does not prune."""
    bounds = least_matches(threshold)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u4").reshape(-1, HASHES) for k in (2, 3))
            left, matches = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for n, least in bounds:
                matches[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(axis=1)
                left = left[matches[left] >= least]
            take = pa.array(left)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["a", "b"])

    own = classes.select("cls", "signature")
    joined = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return map_batches(joined, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["a", "b"])

    own = sets.select("cls", "hashes")
    rows = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return map_batches(rows, run, "a long, b long")


def cell_links(comps: np.ndarray, tiles: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all components which similar sets of one cell join.

    Compares every pair of different components (and of different tiles, if
    there are two): sizes, then batches of minima, then the full sets.
    """
    n, bounds, links = len(comps), least_matches(percent / 100), []
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    _, label = np.unique(comps, return_inverse=True)
    across = tiles.min() != tiles.max()
    codes, marked = None, None
    for start in range(0, n, 64):
        stop = min(n, start + 64)
        open_pairs = label[start:stop, None] != label[None, start:]
        open_pairs &= np.arange(start, n)[None, :] > np.arange(start, stop)[:, None]
        if across:
            open_pairs &= tiles[start:stop, None] != tiles[None, start:]
        least = np.minimum(sizes[start:stop, None], sizes[None, start:])
        open_pairs &= 100 * least >= percent * np.maximum(sizes[start:stop, None], sizes[None, start:])
        x, y = (z + start for z in np.nonzero(open_pairs))
        matches = np.zeros(len(x), dtype=np.int64)
        for k, need in bounds:
            if not len(x):
                break
            matches += (signs[x, k - BATCH : k] == signs[y, k - BATCH : k]).sum(axis=1)
            left = matches >= need
            x, y, matches = x[left], y[left], matches[left]
        if not len(x):
            continue
        if codes is None:
            distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            codes, marked = np.split(inverse, np.cumsum(sizes)[:-1]), np.zeros(len(distinct), dtype=bool)
        edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        for low, high in pairwise(edges.tolist()):
            i, others = int(x[low]), y[low:high]
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            marked[codes[i]] = True
            found = marked[np.concatenate([codes[j] for j in others])]
            both = np.add.reduceat(found, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            marked[codes[i]] = False
            for j in others[(both > 0) & (100 * both >= percent * (sizes[i] + sizes[others] - both))].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    links.append((i, j))
    return links


def _mixed(members: DataFrame, components: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, i, j, tile, cls, comp of the buckets that hold several components: their cells, one for each pair of tiles."""
    placed = members.join(components.withColumnRenamed("node", "cls"), "cls", "left").join(classes.select("cls", "n_shingles"), "cls")
    placed = placed.select("bucket", "cls", F.coalesce("component", "cls").alias("comp"), "n_shingles")
    counted = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    needed = F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.sum("s") / TILE_SHINGLES)).cast("int")
    several = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), needed.alias("tiles")).filter("comps > 1").drop("comps")
    tiled = placed.join(several, "bucket").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    return tiled.select("bucket", F.inline(cells), "tile", "cls", "comp")


def _cell_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between different components that share a cell."""

    def flush(rows: list) -> pa.RecordBatch:
        tiles, cls, comps = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        signs = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4").reshape(-1, HASHES)
        found = cell_links(comps, tiles, signs, [np.frombuffer(r[4], dtype=np.uint64) for r in rows], percent)
        return pa.RecordBatch.from_arrays([pa.array([max(cls[i], cls[j]) for i, j in found], pa.int64()), pa.array([min(cls[i], cls[j]) for i, j in found], pa.int64())], ["a", "b"])

    def run(batches):
        cell, rows = None, []
        for b in batches:
            for *key, tile, cls, comp, sign, hashes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != cell:
                    if len(rows) > 1:
                        yield flush(rows)
                    cell, rows = key, []
                rows.append((tile, cls, comp, sign, hashes))
        if len(rows) > 1:
            yield flush(rows)

    dealt = cells.join(sets, "cls").select("bucket", "i", "j", "tile", "cls", "comp", "signature", "hashes").repartition("bucket", "i", "j")
    return map_batches(dealt.sortWithinPartitions("bucket", "i", "j"), run, "a long, b long")


def _judged(df: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text_hash, n_shingles, class_key, component (the least class key), class_id and component_id of every row."""
    rows, threshold = id_text(df, id_col, text_col), percent / 100
    signed = materialise(signatures(rows, size).withColumn("key", F.monotonically_increasing_id()), "near-signatures")
    first_row = F.min(F.struct("key", "doc_id", "text_hash", "n_shingles")).alias("r")
    equal = signed.filter("n_shingles > 0").groupBy("f0", "f1").agg(first_row, F.min("doc_id").alias("class_id"))
    equal = materialise(equal.select("f0", "f1", "class_id", F.col("r.key").alias("cls"), "r.doc_id", "r.text_hash", "r.n_shingles"), "near-equal")
    classes = materialise(signed.select(F.col("key").alias("cls"), "signature").join(equal.drop("f0", "f1", "class_id"), "cls"), "near-classes")

    bands = _bands(classes, band_rows(threshold))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(bands.join(shared, "bucket"), "near-members")
    met = members.groupBy("cls").agg(F.sum("n").alias("met"))
    wanted = classes.join(met, "cls").select("cls", "doc_id", "text_hash", "signature")
    sets = materialise(_sets(rows, wanted, size), "near-sets")
    # the class that meets most others, as an original among its copies does, stands for each of its buckets
    centre = members.join(met, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("met", -F.col("cls"))).alias("centre"))
    pair = (F.greatest("cls", "centre").alias("a"), F.least("cls", "centre").alias("b"))
    first = members.join(centre, "bucket").filter("cls <> centre").select(*pair).distinct()
    links = materialise(_verified(_survivors(first, classes, threshold), sets, percent), "near-links")
    components = connected_components(links)
    cells = _mixed(members.select("bucket", "cls"), components, classes)
    later = materialise(_cell_links(cells, sets, percent), "near-links")
    components = connected_components(links.union(later))

    joined = equal.select("f0", "f1", "cls", "class_id").join(components.withColumnRenamed("node", "cls"), "cls", "left")
    joined = joined.withColumn("component", F.coalesce("component", "cls"))
    least = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of = materialise(joined.join(least, "component"), "near-components")
    out = signed.drop("signature").join(of, ["f0", "f1"], "left")
    none = F.col("n_shingles") == 0
    return out.select(
        "key", "doc_id", "text_hash", "n_shingles", F.coalesce("component", "key").alias("component"),
        *[F.when(none, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")],
    )


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept (doc_id = component_id) of every row.

    Links are pairs with 100 * intersection >= percent * union of their sets
    of ``size``-word shingles.
    """
    judged = _judged(df, size, percent, id_col, text_col)
    return judged.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component of near-duplicates, with all its columns.

    That with the least id stays (unknown ids come last); of rows that repeat
    both id and text any one; rows without words all stay.
    """
    judged = materialise(_judged(df, size, percent, id_col, text_col).select("key", "doc_id", "text_hash", "component"), "near-judged")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    best = judged.groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.key").alias("key"), F.lit(1).alias("stays"))
    names = judged.join(best, "key", "left").groupBy("doc_id", "text_hash").agg(F.count("stays").alias("stay"), F.count(F.lit(1)).alias("all"))
    key, text_hash = unlike(df, "_doc_id"), unlike(df, "_text_hash")
    odd = materialise(names.filter(F.col("stay") < F.col("all")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), "stay"), "near-odd")
    same = same_text(id_col, text_col, key, text_hash)
    out = df.join(odd, same, "left_anti")
    repeated = odd.filter("stay > 0").drop("stay")
    if repeated.isEmpty():
        return out
    own = [F.col(f"`{c}`") for c in df.columns]
    return out.unionByName(df.join(repeated, same).dropDuplicates([key, text_hash]).select(*own))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair that shares a shingle, and its components by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c, any_value(l.n) AS na, any_value(r.n) AS nb
  FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
reach(a, b) AS (SELECT a, b FROM k UNION SELECT reach.a, k.b FROM reach JOIN k ON reach.b = k.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN low ON low.a = doc_id
"""
