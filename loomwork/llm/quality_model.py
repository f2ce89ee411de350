"""Quality and toxicity scores from weak labels.

Overlapping heuristic labellers vote on every document (yes, no or abstain);
the hand labels that exist are one more labeller.  Expectation-maximisation
over the counts of all vote patterns estimates each labeller's accuracies and
the class prior, and so the probability of the class given the votes.  These
probabilities are the targets of a linear scorer over hashed features (words,
their beginnings, and shares of odd tokens), trained by follow-the-regularised-leader
on at most ``SAMPLE`` documents (different id or text), the ones with the smallest hash of their id.
The scorer then reads the whole text of every document.

The labellers are learnt from at most ``SAMPLE`` labelled documents (different
id or text), again those with the smallest hash.  For quality, each share of odd tokens has a cut
that bad documents reach and good ones hardly do (without labels ``CUTS``).  For
toxicity, each half of the sample gives a lexicon of words and word beginnings
that its toxic documents have and the others do not; on the documents of its
own half a lexicon abstains, as their labels vote already.

Defined results: a null or empty text has quality 0, toxicity 0 and is not
kept; very long texts are read whole; documents without labels get the gold
labeller's abstention; of labels that repeat an id the greatest count; rows that
repeat an id are scored one by one, and those with other texts are learnt from
as documents of their own; null ids are scored like any other; without
any label the lexicons are empty and the heuristics decide alone; scores at a
threshold (ties) are good and toxic; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, id_text, materialise
from loomwork.llm.bpe import small_batches

SAMPLE, BITS, EPOCHS, SHARES = 6000, 18, 4, 64
_CACHED = 700_000
GOOD_FROM, TOXIC_FROM = 0.5, 0.5
_PLAIN = re.compile(r"[\W\d_]+")
_SYMBOLS = frozenset("#*$%&|<>!")
#: Cuts of the shares of symbols, shouted, repeated and letterless tokens where there are no labels: from these on bad; up to these clean.
CUTS = ((0.25, 0.5, 0.3, 0.25), (0.1, 0.1, 0.1, 0.1))
QUALITY = ("symbols", "shouting", "repeats", "no_letters", "short", "clean", "gold")
TOXIC = ("lexicon_0", "several_0", "lexicon_1", "several_1", "gold")
ABSTAIN, SEVERAL, WRONG = 2, 3, 0.001


def _parts(plain: str) -> tuple[str, ...]:
    """A word's features: itself and its beginnings."""
    if len(plain) >= 6:
        return (plain + "$", plain[:4], plain[:5], plain[:6])
    return (plain + "$", *[plain[:k] for k in (4, 5) if len(plain) >= k])


_TIMES = np.random.default_rng(11).integers(0, 2**63, (4, 33), dtype=np.uint64) | np.uint64(1)
_WIDE = 32


def hash_parts(plain: list[str]) -> np.ndarray:
    """Hashes [words, 4] of the whole words and of their beginnings of 4, 5 and 6 letters; 0 where there is none."""
    import xxhash

    n = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    letters = np.array(plain, dtype=f"U{_WIDE}").view(np.uint32).reshape(len(plain), _WIDE).astype(np.uint64) if plain else np.zeros((0, _WIDE), dtype=np.uint64)
    out = np.zeros((len(plain), 4), dtype=np.uint64)
    out[:, 0] = (letters * _TIMES[0, :_WIDE]).sum(axis=1) + n.astype(np.uint64) * _TIMES[0, _WIDE]
    for i in np.flatnonzero(n > _WIDE):
        out[i, 0] = xxhash.xxh64_intdigest(plain[i])
    for k in (4, 5, 6):
        out[:, k - 3] = np.where(n >= k, (letters[:, :k] * _TIMES[k - 3, :k]).sum(axis=1), np.uint64(0))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out[n == 0] = 0
    return out


def hash_lexicon(lexicon: frozenset) -> np.ndarray:
    """The hashes of whole words (that end in $) and of beginnings."""
    parts = sorted(lexicon)
    found = hash_parts([p.removesuffix("$") for p in parts])
    return np.array([h[0 if p[-1] == "$" else len(p) - 3] for p, h in zip(parts, found, strict=True)], dtype=np.uint64)


class Tokens:
    """Attributes of tokens by row, with a bounded cache.

    Columns: symbol, shouted, without letters, in either lexicon; and, where
    asked for, the hashed features (those for which ``useful`` is true, if it
    is given).
    """

    def __init__(self, lexicons: tuple[frozenset, frozenset] = (frozenset(), frozenset()), features: bool = False, useful: np.ndarray | None = None):
        self.lexicons, self.wanted, self.useful = tuple(map(hash_lexicon, lexicons)), features, useful
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.flags, self.features = np.zeros((0, 5), dtype=bool), np.zeros((0, 4), dtype=np.int32)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        lists = [t.split() for t in texts]
        every = set().union(*lists)
        new = every.difference(self.row)
        if len(self.row) + len(new) > _CACHED:
            self.reset()
            new = every
        if new:
            self.learn(new)
        find = self.row.__getitem__
        return [np.fromiter(map(find, words), dtype=np.int64, count=len(words)) for words in lists]

    def learn(self, new: set[str]) -> None:
        plain, bits = [], []
        for w in new:
            if w.isalpha():
                plain.append(w.lower())
                bits.append(2 if len(w) > 1 and w.isupper() else 0)
            else:
                p = _PLAIN.sub("", w.lower())
                plain.append(p)
                bits.append((0 if w.isalnum() or _SYMBOLS.isdisjoint(w) else 1) | (2 if len(w) > 1 and w.isupper() else 0) | (0 if p else 4))
        flags = (np.array(bits, dtype=np.uint8)[:, None] >> np.arange(5, dtype=np.uint8) & 1).astype(bool)
        if self.wanted or any(map(len, self.lexicons)):
            parts = hash_parts(plain)
            for k, lexicon in enumerate(self.lexicons, 3):
                flags[:, k] = np.isin(parts, lexicon).any(axis=1)
            if self.wanted:
                found = np.where(parts == 0, -1, (parts % np.uint64((1 << BITS) - SHARES)).astype(np.int32) + SHARES).astype(np.int32)
                if self.useful is not None:
                    found[~self.useful[found]] = -1
                self.features = np.concatenate([self.features, found])
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.flags = np.concatenate([self.flags, flags])

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Shares of symbols, shouted, repeated and letterless tokens."""
        if not len(rows):
            return np.zeros(4)
        f = self.flags[rows][:, :3].mean(axis=0)
        again = float((rows[1:] == rows[:-1]).mean()) if len(rows) > 1 else 0.0
        return np.array([f[0], f[1], again, f[2]])

    def votes(self, rows: np.ndarray, cuts: tuple) -> tuple[int, ...]:
        """Of QUALITY without gold (1: good), then of TOXIC without gold (1: toxic)."""
        if not len(rows):
            return (0,) * 5 + (ABSTAIN, 0, ABSTAIN, 0, ABSTAIN)
        shares = self.shares(rows)
        odd = [0 if x >= least else ABSTAIN for x, least in zip(shares, cuts[0], strict=True)]
        clean = 1 if len(rows) >= 3 and all(x <= most for x, most in zip(shares, cuts[1], strict=True)) else ABSTAIN
        toxic = []
        for n, lexicon in zip(self.flags[rows][:, 3:].sum(axis=0), self.lexicons, strict=True):
            toxic += [ABSTAIN, ABSTAIN] if not len(lexicon) else [1 if n else 0, 1 if n >= SEVERAL else ABSTAIN]
        return (*odd, 0 if len(rows) < 3 else ABSTAIN, clean, *toxic)

    def hashed(self, rows: np.ndarray) -> np.ndarray:
        """The distinct features of a text."""
        out = self.features[rows]
        level = np.minimum((self.shares(rows) * 8).astype(np.int32), 7)
        return np.concatenate([np.arange(4, dtype=np.int32) * 8 + level, np.unique(out[out >= 0])])


def estimate(patterns: np.ndarray, counts: np.ndarray, sure: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of class 1 for each vote pattern, the labellers' vote probabilities [labeller, class, vote] and the prior.

    ``sure`` is each labeller's accuracy to begin with.
    """
    n = patterns.shape[1]
    theta = np.empty((n, 2, 3))
    for j in range(n):
        for c in range(2):
            theta[j, c] = [(1 - sure[j]) / 2, (1 - sure[j]) / 2, 1 / 3]
            theta[j, c, c] = sure[j]
        theta[j] /= theta[j].sum(axis=1, keepdims=True)
    prior, post = 0.5, np.zeros(len(patterns))
    hot = patterns[:, :, None] == np.arange(3)
    for _ in range(rounds):
        logs = np.einsum("pjv,jcv->pc", hot, np.log(theta)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        for c, w in ((0, (1 - post) * counts), (1, post * counts)):
            theta[:, c] = (np.einsum("p,pjv->jv", w, hot) + 0.5) / (w.sum() + 1.5)
        prior = float(np.clip((post * counts).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
    return post, theta, prior


class Linear:
    """A logistic scorer over sparse binary features, trained by FTRL-proximal steps."""

    def __init__(self, l1: float = 0.5, l2: float = 1.0, alpha: float = 0.3):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.l1, self.l2, self.alpha = l1, l2, alpha

    def weights(self, f: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((1 + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[np.ndarray], target: np.ndarray, epochs: int = EPOCHS) -> Linear:
        for _ in range(epochs):
            for f, y in zip(rows, target, strict=True):
                w = self.weights(f)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                n = self.n[f]
                self.z[f] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[f] = n + g * g
        return self


def _smallest(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` different values of doc_id and ``columns``, those of the ids with the smallest hash; doc_id as _id."""
    rows = df.filter("doc_id is not null").select("doc_id", *columns).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(limit)
    return rows.withColumnRenamed("doc_id", "_id")


def best_cuts(shares: np.ndarray, good: np.ndarray) -> tuple:
    """From which share on a document is bad (infinite where the share tells nothing), and up to which it is clean.

    Of the shares that at most ``WRONG`` of the good documents reach, the one
    that most of the bad ones reach and few good ones (Youden's index), moved
    half way to what nine in ten of those bad ones reach.  Up to a third of
    that is clean.
    """
    if not len(good) or good.all() or not good.any():
        return CUTS
    cuts, clean = [], []
    for x in shares.T:
        values = np.unique(x[x > 0])
        below = np.searchsorted(np.sort(x[~good]), values), np.searchsorted(np.sort(x[good]), values)
        wrong = 1 - below[1] / good.sum()
        index = np.where(wrong <= WRONG, 1 - below[0] / (~good).sum() - wrong, -1.0)
        if len(values) and index.max() > 0.02:
            least = values[index.argmax()]
            cuts.append(float(least + np.quantile(x[~good & (x >= least)], 0.1)) / 2)
        else:
            cuts.append(np.inf)
        clean.append(cuts[-1] / 3)
    return tuple(cuts), tuple(clean)


def labellers(labelled: DataFrame) -> tuple[tuple[frozenset, frozenset], tuple]:
    """Both lexicons and the cuts, from the labelled sample (doc_id, text, half, quality, toxic)."""

    def count(batches):
        for b in batches:
            found = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
            for text, half, toxic in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                plain = {_PLAIN.sub("", w.lower()) for w in (text or "").split()} - {""}
                found[half, toxic].update({p for w in plain for p in _parts(w)})
            for h in (0, 1):
                keys = sorted(found[h, 0].keys() | found[h, 1].keys())
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(keys), pa.int32()), pa.array(keys, pa.string()), *[pa.array([found[h, t][x] for x in keys], pa.int64()) for t in (1, 0)]], ["half", "part", "toxic", "other"])

    told = labelled.filter("toxic in (0, 1)").select("text", "half", "toxic")
    counted = told.mapInArrow(count, "half int, part string, toxic long, other long")
    odd = counted.groupBy("half", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic >= 4 and toxic >= 50 * other").collect()

    def shares(batches):
        tokens = Tokens()
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            rows = [tokens.shares(r) for part in small_batches(texts) for r in tokens.rows(texts[part])]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(c, pa.float64()) for c in np.array(rows).reshape(-1, 4).T]], ["quality", *"abcd"])

    judged = labelled.filter("quality in (0, 1)").select("text", "quality").mapInArrow(shares, "quality int, a double, b double, c double, d double").toArrow()
    cuts = best_cuts(np.stack([judged.column(c).to_numpy() for c in "abcd"], axis=1), judged.column("quality").to_numpy() == 1)
    return tuple(frozenset(r["part"] for r in odd if r["half"] == h) for h in (0, 1)), cuts


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality_score, toxic_score and kept of every row of ``df``; ``labels`` has doc_id, quality, toxic (0, 1 or null)."""
    docs = id_text(df, id_col, text_col)
    sc = df.sparkSession.sparkContext
    gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in ("quality", "toxic")]).filter("doc_id is not null")
    gold = gold.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("quality", "toxic")])
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    taken = materialise(gold.join(_smallest(gold, sample), F.col("doc_id") == F.col("_id")).select("doc_id", half, "quality", "toxic"), "weak-labelled")
    named = docs.withColumn("h", F.xxhash64("text"))
    told = materialise(named.join(taken, "doc_id"), "weak-texts")
    learnt_from = _smallest(told, sample, "h").withColumnRenamed("h", "_h")
    sampled = (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))
    labelled = materialise(told.join(learnt_from, sampled, "left_semi").dropDuplicates(["doc_id", "h"]), "weak-texts")
    learnt = sc.broadcast(labellers(labelled))
    names = [*[f"q_{x}" for x in QUALITY[:-1]], *[f"t_{x}" for x in TOXIC[:-1]]]

    def vote(batches):
        lexicons, cuts = learnt.value
        tokens = Tokens(lexicons)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            votes = [tokens.votes(r, cuts) for part in small_batches(texts) for r in tokens.rows(texts[part])]
            cols = list(zip(*votes, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int32()) for c in cols]], ["doc_id", "h", *names])

    golden = lambda c: F.coalesce(F.when(F.col(c).isin(0, 1), F.col(c)), F.lit(ABSTAIN))
    told = gold.join(taken.select("doc_id", "half"), "doc_id", "left").select("doc_id", "half", golden("quality").alias("q_gold"), golden("toxic").alias("t_gold"))
    voted = named.mapInArrow(vote, "doc_id long, h long, " + ", ".join(f"{n} int" for n in names)).join(told, "doc_id", "left")
    own = lambda n: F.when(F.col("half") == int(n[-1]), F.lit(ABSTAIN)).otherwise(F.col(n)).alias(n)
    voted = voted.select("doc_id", "h", *[own(n) if n[-1] in "01" else n for n in names], *[F.coalesce(c, F.lit(ABSTAIN)).alias(c) for c in ("q_gold", "t_gold")])
    voted = materialise(voted, "weak-votes")

    ids = materialise(_smallest(voted, sample, "h").withColumnRenamed("h", "_h"), "weak-sample")
    targets: list[dict[tuple[int, int], float]] = []
    chosen = voted.join(ids, sampled, "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    for prefix, voters in (("q_", QUALITY), ("t_", TOXIC)):
        cols = [prefix + x for x in voters]
        rows = voted.groupBy(*cols).count().orderBy(*cols).collect()
        patterns = np.array([r[:-1] for r in rows], dtype=np.int64).reshape(-1, len(cols))
        post, _, _ = estimate(patterns, np.array([r[-1] for r in rows], dtype=float), np.array([0.8] * (len(cols) - 1) + [0.95]))
        of = {tuple(p): q for p, q in zip(patterns.tolist(), post.tolist(), strict=True)}
        targets.append({(r["doc_id"], r["h"]): of[tuple(r[c] for c in cols)] for r in chosen})

    def features(batches):
        tokens = Tokens(features=True)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [tokens.hashed(r).astype("<i4").tobytes() for part in small_batches(texts) for r in tokens.rows(texts[part])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["doc_id", "h", "features"])

    rows = named.join(ids, sampled, "left_semi").dropDuplicates(["doc_id", "h"]).mapInArrow(features, "doc_id long, h long, features binary").collect()
    rows.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 2**32, r["doc_id"], r["h"]))
    found = [np.frombuffer(r["features"], dtype="<i4") for r in rows]
    weights = [Linear().fit(found, np.array([t[r["doc_id"], r["h"]] for r in rows])).weights().astype(np.float32) for t in targets]
    model = sc.broadcast(np.stack(weights))

    def apply(batches):
        tokens = Tokens(features=True, useful=model.value.any(axis=0))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lists = [r for part in small_batches(texts) for r in _scored(tokens, texts[part], model.value)]
            both = np.array(lists).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "quality_score", "toxic_score"])

    out = docs.mapInArrow(apply, "doc_id long, quality_score double, toxic_score double")
    return out.withColumn("kept", (F.col("quality_score") >= GOOD_FROM) & (F.col("toxic_score") < TOXIC_FROM))


def _scored(tokens: Tokens, texts: list[str], weights: np.ndarray) -> list[tuple[float, float]]:
    out = []
    for rows in tokens.rows(texts):
        if not len(rows):
            out.append((0.0, 0.0))
            continue
        margin = np.clip(weights[:, tokens.hashed(rows)].sum(axis=1, dtype=np.float64), -35, 35)
        out.append(tuple((1 / (1 + np.exp(-margin))).tolist()))
    return out


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
