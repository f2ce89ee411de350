"""Katz backoff scores: Good-Turing counts and exactly normalised backoff weights.

The corpus is read once into *blocks*: ``BLOCK_TOKENS`` tokens as numbers into the
block's own list of words, written as a table bucketed by block.  Everything
after works on blocks and on hash parts, by request and answer: each block
sends the distinct words (then word pairs) that it has, with its training
counts, to their parts; a part adds the counts up, keeps its slice of the
model, and answers every block in the order of its request.  So what is
shuffled are the distinct words and pairs of whole blocks, sorted, as packed
numbers, and no row for each token exists; messages are never more than the
distinct words or pairs that they carry, so their number grows with the corpus.

The model stands in tables partitioned by kind and hash part: ``katz-unigrams``
(words and counts), ``katz-bigrams`` (pairs and counts) and ``katz-backoff``
(contexts and their backoff weights).  A token is scored from the longest
context down: the pair's discounted probability if it was seen, else the
context's stored weight times the word's.

Model, of order 2.  For a count r up to ``K`` the discount d(r) is Good-Turing's
(Katz's form; one half is taken off instead where the counts of counts do not
give values between 0 and 1), above K it is 1.

    P(w)     = d1(c(w)) c(w) / N;  the mass that is left is that of an unknown word
    P(w | h) = d2(c(hw)) c(hw) / c(h)    if c(hw) > 0
             = alpha(h) P(w)             if not;  alpha(h) = (1 - sum of P(v | h)) / (1 - sum of P(v)) over the seen v
    P(w | h) = P(w)                      after an unknown h

A context none of whose counts is below K + 1 would leave no mass: there one
half is taken off each count.  Contexts with at least a thousandth of all
tokens (so a thousand at most) have their pairs spread over all parts and
their sums added up on the driver.

Defined results: a null or empty text is its end token alone; null ids are
learnt from like the text '' hashes and scored; repeated rows count as often
as they stand there; with no training text every token is unknown and has
probability 1 under the model, as nothing but the unknown is known; very long
texts are scored whole; words of equal counts (ties) are numbered by name,
which changes no score; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, materialise
from loomwork.llm.language_id import held_out

K = 5
BLOCK_TOKENS, PART_WORDS, PART_PAIRS, HOT_SHARE, BUCKET_BYTES = 600_000, 500_000, 1_250_000, 1000, 16 << 20
END = b"\n"
_START, _WIDTH = 2**31 - 2, np.uint64(31)


def pack(x: np.ndarray) -> bytes:
    """Non-negative numbers, byte by byte of their significance, compressed."""
    import zstandard

    wide = "<u8" if len(x) and int(x.max()) >= 2**32 else "<u4"
    planes = x.astype(wide).view(np.uint8).reshape(len(x), int(wide[2])).T.tobytes()
    return wide[2].encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    size = int(data[:1])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64) if len(raw) else np.zeros(0, dtype=np.int64)


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch, one after the other: a block's row is large."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


class Discounts:
    """The discount factor of a count, and what a set of counts loses by it."""

    def __init__(self, of_counts: np.ndarray):
        """``of_counts``: how many items have the count 1, 2 ... K + 1."""
        n = np.asarray(of_counts, dtype=float)
        r = np.arange(1, K + 1)
        d = np.zeros(K)
        if n[:K].min(initial=1) > 0 and n[K] > 0:
            a = (K + 1) * n[K] / n[0]
            if a < 1:
                d = ((r + 1) * n[1:] / (r * n[:K]) - a) / (1 - a)
        self.low = d if d.min() > 0 and d.max() < 1 else (r - 0.5) / r
        #: Without any small count one half is taken off every count.
        self.half = not n[:K].sum()

    def __call__(self, counts: np.ndarray, half: np.ndarray | bool = False) -> np.ndarray:
        c = np.maximum(counts, 1)
        d = np.where(counts <= K, self.low[np.minimum(c, K) - 1], 1.0)
        return np.where(np.asarray(half) | self.half, (c - 0.5) / c, d)

    def lost(self, small: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Counts taken off where ``small`` [..., K] items have the counts 1 to K, of ``distinct`` items."""
        by_half = 0.5 * distinct
        if self.half:
            return by_half
        return np.where(small.sum(axis=-1) > 0, (small * np.arange(1, K + 1) * (1 - self.low)).sum(axis=-1), by_half)


def _to_blocks(limit: int):
    """A partition's rows (doc_id, text, held_out) as blocks."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, local = [], [], [], [], {}

        def flush():
            nonlocal ids, held, lengths, tokens, local, number
            n, all_tokens = np.array(lengths, dtype=np.int64), np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int32)
            learn = ~np.array(held, dtype=bool)
            counts = np.bincount(all_tokens[np.repeat(learn, n)], minlength=len(local))
            order = np.argsort(-np.bincount(all_tokens, minlength=len(local)), kind="stable")
            place = np.empty(len(local), dtype=np.int64)
            place[order] = np.arange(len(local))
            words = list(local)
            words = [words[i] for i in order]
            row = [
                [task << 32 | number], [ids], [np.array(held, dtype=np.uint8).tobytes()], [pack(n)], [pack(place[all_tokens])],
                [squeeze(b" ".join([END, *words]))], [pack(np.concatenate([[learn.sum()], counts[order]]))], [len(words) + 1], [int((n[learn] + 1).sum())],
            ]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "ids", "held", "lengths", "tokens", "words", "counts", "n_words", "n_train"])
            ids, held, lengths, tokens, local, number = [], [], [], [], {}, number + 1
            return out

        total = 0
        for b in batches:
            for i, text, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = (text or "").encode().lower().split()
                if words:
                    for w in set(words).difference(local):
                        local[w] = len(local)
                    tokens.append(np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(i)
                held.append(h)
                lengths.append(len(words))
                total += len(words) + 1
                if total >= limit:
                    yield flush()
                    total = 0
        if ids:
            yield flush()

    return run


_BLOCK = "block long, ids array<bigint>, held binary, lengths binary, tokens binary, words binary, counts binary, n_words long, n_train long"
_ROW = "kind string, part int, block long, a binary, b binary"
_NAMES = ["kind", "part", "block", "a", "b"]


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _NAMES)


def _part_of(words: list[bytes], parts: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)) % np.uint64(parts)


def _ask_words(parts: int):
    """For each block and part: the words, with their training counts."""

    def run(batches):
        for b in batches:
            for block, words, counts in rows_of(b):
                words, counts = expand(words).split(b" "), unpack(counts)
                part = _part_of(words, parts)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                rows = []
                for p in range(parts):
                    at = order[ends[p] : ends[p + 1]]
                    if len(at):
                        rows.append(("ask", p, block, squeeze(b" ".join([words[i] for i in at])), pack(counts[at])))
                yield from _rows(rows).to_batches()

    return run


def _answer_words(parts: int):
    """Adds a part's counts up: ids (by falling count) and counts for every block, the table's slice and its sums."""

    def run(table: pa.Table) -> pa.Table:
        p, total = table.column("part")[0].as_py(), {}
        asked = sorted(zip(*[table.column(c).to_pylist() for c in ("block", "a", "b")], strict=True))
        lists = [(block, expand(a).split(b" "), unpack(b)) for block, a, b in asked]
        for _, words, counts in lists:
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        known = sorted((w for w, c in total.items() if c), key=lambda w: (-total[w], w))
        ident = {w: i * parts + p + 1 for i, w in enumerate(known)}  # 0: unknown
        rows = []
        for block, words, _ in lists:
            ids = np.fromiter((ident.get(w, 0) for w in words), dtype=np.int64, count=len(words))
            rows.append(("answer", p, block, pack(ids), pack(np.fromiter((total[w] for w in words), dtype=np.int64, count=len(words)))))
        c = np.array([total[w] for w in known], dtype=np.int64)
        rows.append(("table", p, None, squeeze(b" ".join(known)), pack(c)))
        sums = [c.sum(), len(c), *[(c == r).sum() for r in range(1, K + 2)], total.get(END, 0)]
        rows.append(("stats", p, None, np.array(sums, dtype="<i8").tobytes(), None))
        return _rows(rows)

    return run


def _hot(total: int, parts: int):
    """Ids and counts of the words that are at least a thousandth of all tokens."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = unpack(data)
                n = int((c * HOT_SHARE >= total).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) * parts + p + 1)], ["id"])

    return run


class Block:
    """A block with what the parts answered: global ids and counts of its tokens, and its distinct pairs."""

    def __init__(self, held: bytes, lengths: bytes, tokens: bytes, words: bytes, answers: list, parts: int, start_count: int):
        names = expand(words).split(b" ")
        order = np.argsort(_part_of(names, parts), kind="stable")
        ids, counts = np.empty(len(names), dtype=np.int64), np.empty(len(names), dtype=np.int64)
        by_part = sorted(answers, key=lambda r: r["part"])
        ids[order] = np.concatenate([unpack(r["a"]) for r in by_part])
        counts[order] = np.concatenate([unpack(r["b"]) for r in by_part])
        local, self.n = unpack(tokens) + 1, unpack(lengths)  # place 0 is the end
        self.held = np.frombuffer(held, dtype=np.uint8).astype(bool)
        ends = np.cumsum(self.n + 1)
        seq = np.zeros(int(ends[-1]), dtype=np.int64)
        inner = np.ones(len(seq), dtype=bool)
        inner[ends - 1] = False
        seq[inner] = local
        self.starts = ends - self.n - 1
        self.word, self.count = ids[seq], counts[seq]
        before = np.empty_like(self.word)
        before[1:], self.context_count = self.word[:-1], np.empty_like(self.count)
        self.context_count[1:] = self.count[:-1]
        before[self.starts], self.context_count[self.starts] = _START, start_count
        self.before = before
        train = np.repeat(~self.held, self.n + 1)
        # an unknown word (0) makes a pair too: it needs its context's weight
        self.paired = (before > 0) & ((before != _START) | (start_count > 0))
        key = self.word[self.paired].astype(np.uint64) << _WIDTH | before[self.paired].astype(np.uint64)
        self.keys, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.train = np.bincount(self.pair, weights=train[self.paired], minlength=len(self.keys)).astype(np.int64)
        self.second = self.count[self.paired][first]

    def split(self, parts: int, hot: np.ndarray) -> list[np.ndarray]:
        """The places of the distinct pairs of each part: by context, and by the whole pair in hot contexts."""
        part = pair_part(self.keys, parts, hot)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        return [order[ends[p] : ends[p + 1]] for p in range(parts)]


def context_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(2**31 - 1)).astype(np.int64)


def pair_part(keys: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    context = context_of(keys)
    by = np.where(np.isin(context, hot), keys, context.astype(np.uint64))
    return ((by * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _ask_pairs(parts: int, words_parts: int, hot, starts: int):
    def run(batches):
        for b in batches:
            for block, held, lengths, tokens, words, answers in rows_of(b):
                x = Block(held, lengths, tokens, words, answers, words_parts, starts)
                rows = []
                for p, at in enumerate(x.split(parts, hot.value)):
                    if len(at):
                        keys = x.keys[at]
                        second = x.second[at]
                        new = np.concatenate([[True], keys[1:] >> _WIDTH != keys[:-1] >> _WIDTH])  # one count for each run of a word
                        rows.append(("ask", p, block, pack(np.diff(keys, prepend=np.uint64(0))), pack(np.concatenate([x.train[at], second[new]]))))
                yield from _rows(rows).to_batches()

    return run


def _answer_pairs(hot, first: Discounts, total: int):
    """Adds a part's pair counts up.

    Answers, in the order asked: 2 r + (context without small counts), and the
    contexts of unseen pairs.  Keeps of every context the counts 1 to K, the
    distinct successors, all successors, and the sum of their P(w).
    """

    def run(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        asked = sorted(zip(*[table.column(c).to_pylist() for c in ("block", "a", "b")], strict=True))
        keys, train, second = [], [], []
        for _, a, b in asked:
            k, both = np.cumsum(unpack(a)).astype(np.uint64), unpack(b)
            run_of = np.cumsum(np.concatenate([[True], k[1:] >> _WIDTH != k[:-1] >> _WIDTH])) - 1
            keys.append(k)
            train.append(both[: len(k)])
            second.append(both[len(k) :][run_of])
        sizes = [len(k) for k in keys]
        distinct, one, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        r = np.bincount(inverse, weights=np.concatenate(train), minlength=len(distinct)).astype(np.int64)
        c2 = np.concatenate(second)[one]
        lower = first(c2) * c2 / total
        contexts, ctx = np.unique(context_of(distinct), return_inverse=True)
        m = len(contexts)
        seen = r > 0
        small = np.stack([np.bincount(ctx[r == k], minlength=m) for k in range(1, K + 1)], axis=1)
        sums = np.bincount(ctx, weights=r, minlength=m).astype(np.int64)
        succ = np.bincount(ctx[seen], minlength=m)
        mass = np.bincount(ctx[seen], weights=lower[seen], minlength=m)
        is_hot = np.isin(contexts, hot.value)
        answer = 2 * r + ((small.sum(axis=1) == 0) & ~is_hot)[ctx]
        rows, at = [], 0
        for (block, _, _), n in zip(asked, sizes, strict=True):
            mine = inverse[at : at + n]
            at += n
            need = np.unique(ctx[mine[(r[mine] == 0) & ~is_hot[ctx[mine]]]])
            rows.append(("answer", p, block, pack(answer[mine]), pack(contexts[need])))
        facts = np.concatenate([small, succ[:, None], sums[:, None]], axis=1).astype("<i8")
        rows.append(("facts", p, None, pack(contexts[~is_hot]), squeeze(facts[~is_hot].tobytes() + mass[~is_hot].astype("<f8").tobytes())))
        rows.append(("table", p, None, pack(np.diff(distinct[seen], prepend=np.uint64(0))), pack(r[seen])))
        rows.append(("stats", p, None, np.array([(r == k).sum() for k in range(1, K + 2)], dtype="<i8").tobytes(), None))
        for i in np.flatnonzero(is_hot):
            whole = np.array([*small[i], succ[i], sums[i]], dtype="<i8").tobytes()
            rows.append(("hot", p, int(contexts[i]), whole, mass[i].astype("<f8").tobytes()))
        return _rows(rows)

    return run


def backoff_weights(facts: np.ndarray, mass: np.ndarray, second: Discounts) -> np.ndarray:
    """alpha of contexts: what discounting leaves, over what P(w) leaves to their unseen successors; 1 without a successor."""
    rest = second.lost(facts[:, :K].astype(float), facts[:, K].astype(float)) / np.maximum(facts[:, K + 1], 1)
    return np.where(facts[:, K + 1] > 0, rest / np.maximum(1 - mass, 1e-300), 1.0)


def _weigh(second: Discounts):
    """A part's backoff weights, as the model's table and for every block that asked."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        facts = next(r for r in rows if r["kind"] == "facts")
        contexts, raw = unpack(facts["a"]), expand(facts["b"])
        n = len(contexts)
        alpha = backoff_weights(np.frombuffer(raw, dtype="<i8", count=n * (K + 2)).reshape(n, K + 2), np.frombuffer(raw, dtype="<f8", offset=8 * n * (K + 2)), second)
        out = [("table", facts["part"], None, facts["a"], squeeze(alpha.astype("<f8").tobytes()))]
        for r in rows:
            if r["kind"] == "answer":
                asked = unpack(r["b"])
                out.append(("reply", r["part"], r["block"], r["b"], squeeze(alpha[np.searchsorted(contexts, asked)].astype("<f8").tobytes())))
        return _rows(out)

    return run


def _score(parts: int, words_parts: int, hot, starts: int, total: int, types: int, first: Discounts, second: Discounts, left: float, hot_sums):
    """Scores of a block's documents."""

    def run(batches):
        for b in batches:
            for ids, held, lengths, tokens, words, answers, pairs, replies in rows_of(b):
                x = Block(held, lengths, tokens, words, answers, words_parts, starts)
                value, of = np.zeros(len(x.keys), dtype=np.int64), {r["part"]: r["a"] for r in pairs or ()}
                for p, at in enumerate(x.split(parts, hot.value)):
                    if len(at):
                        value[at] = unpack(of[p])
                contexts = [unpack(r["a"]) for r in replies or ()]
                weights = [np.frombuffer(expand(r["b"]), dtype="<f8") for r in replies or ()]
                known, r, half = x.count > 0, np.zeros(len(x.word), dtype=np.int64), np.zeros(len(x.word), dtype=bool)
                r[x.paired], half[x.paired] = (value >> 1)[x.pair], (value & 1).astype(bool)[x.pair]
                for c, (f, m) in hot_sums.value.items():
                    contexts.append(np.array([c]))
                    weights.append(backoff_weights(f[None], np.array([m]), second))
                    if not f[:K].sum():
                        half[x.before == c] = True
                p1 = np.where(known, first(x.count) * x.count / max(total, 1), left)
                alpha = np.ones(len(p1))
                contexts, weights = np.concatenate([*contexts, []]).astype(np.int64), np.concatenate([*weights, []])
                if len(contexts):
                    order = np.argsort(contexts)
                    contexts, weights = contexts[order], weights[order]
                    at = np.minimum(np.searchsorted(contexts, x.before), len(contexts) - 1)
                    alpha = np.where(contexts[at] == x.before, weights[at], 1.0)
                out = np.where(r > 0, second(r, half) * r / np.maximum(x.context_count, 1), alpha * p1)
                logs = np.log10(np.maximum(out, 1e-300))
                base = np.log10((x.count + 0.1) / (total + 0.1 * (types + 1)))
                add = lambda v: np.add.reduceat(v, x.starts)
                cols = [pa.array(ids, pa.int64()), pa.array(x.held), pa.array(x.n + 1), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(logs))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def katz_scores(df: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows with ``held`` are not learnt from."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", (held if held is not None else held_out(10)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    try:
        rows.mapInArrow(_to_blocks(block_tokens), _BLOCK).write.format("parquet").bucketBy(buckets, "block").saveAsTable(name)
        return _scored(spark.table(name), buckets)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(blocks: DataFrame, buckets: int) -> DataFrame:
    """The scores of all documents of the blocks, written; what is joined to blocks is dealt like them."""
    spark = blocks.sparkSession
    sc = spark.sparkContext
    asked, tokens = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()

    parts = max(1, -(-asked // PART_WORDS))
    asks = blocks.select("block", "words", "counts").mapInArrow(_ask_words(parts), _ROW)
    words = materialise(asks.groupBy("part").applyInArrow(_answer_words(parts), _ROW), "katz-unigrams", ("kind",))
    sums = np.sum([np.frombuffer(r[0], dtype="<i8") for r in words.filter("kind = 'stats'").select("a").collect()] or [np.zeros(K + 4, dtype=np.int64)], axis=0)
    total, types, starts = int(sums[0]), int(sums[1]), int(sums[-1])
    first = Discounts(sums[2 : K + 3])
    small = sums[2 : K + 2].astype(float)
    left = float(first.lost(small, np.float64(types)) / total) if total else 1.0
    hot = words.filter("kind = 'table'").select("part", "b").mapInArrow(_hot(total, parts), "id long")
    hot_ids = sc.broadcast(np.array(sorted({r[0] for r in hot.collect()} | {_START}), dtype=np.int64))

    own = words.filter("kind = 'answer'").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "a", "b")).alias("answers"))
    joined = blocks.join(own, "block")
    pair_parts = max(1, -(-max(tokens, 1) // PART_PAIRS))
    asks = joined.select("block", "held", "lengths", "tokens", "words", "answers").mapInArrow(_ask_pairs(pair_parts, parts, hot_ids, starts), _ROW)
    pairs = materialise(asks.groupBy("part").applyInArrow(_answer_pairs(hot_ids, first, max(total, 1)), _ROW), "katz-bigrams", ("kind",))
    of_counts = np.sum([np.frombuffer(r[0], dtype="<i8") for r in pairs.filter("kind = 'stats'").select("a").collect()] or [np.zeros(K + 1, dtype=np.int64)], axis=0)
    second = Discounts(of_counts)
    hot_sums: dict[int, tuple[np.ndarray, float]] = {}
    for r in pairs.filter("kind = 'hot'").select("block", "a", "b").orderBy("block", "part").collect():
        f, m = np.frombuffer(r["a"], dtype="<i8"), float(np.frombuffer(r["b"], dtype="<f8")[0])
        g, n = hot_sums.get(r["block"], (0, 0.0))
        hot_sums[r["block"]] = (f + g, m + n)

    facts = pairs.filter("kind in ('facts', 'answer')").select("kind", "part", "block", F.when(F.col("kind") == "facts", F.col("a")).alias("a"), "b")
    backoff = materialise(facts.groupBy("part").applyInArrow(_weigh(second), _ROW), "katz-backoff", ("kind",))
    told = pairs.filter("kind = 'answer'").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "a")).alias("pairs"))
    replies = backoff.filter("kind = 'reply'").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("replies"))
    last = joined.join(told, "block", "left").join(replies, "block", "left").select("ids", "held", "lengths", "tokens", "words", "answers", "pairs", "replies")
    scored = last.mapInArrow(
        _score(pair_parts, parts, hot_ids, starts, total, types, first, second, left, sc.broadcast(hot_sums)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    out = materialise(scored, "katz-scores")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
