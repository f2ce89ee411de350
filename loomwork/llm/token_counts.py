"""Token counts that follow edits.

Per document the pre-tokens (their length in characters and number of tokens)
stand in blocks; a segment tree over the blocks sums both, so the block of a
character is found by descent.  An edit re-encodes the touched region plus its
boundary context only: reading starts at the last pre-token whose match cannot
see the edit (``CONTEXT`` characters of look-ahead) and stops at the first new
boundary behind the edit that was a boundary before, from where all further
matches are as they were.  Changed blocks are replaced and the sums on the
paths to the root are updated; when the number of blocks changes, the sums
above the blocks are rebuilt from the blocks' sums.  Boundaries do not depend
on token counts, so the new pre-tokens of a batch of documents are encoded
together when all their edits are in place, and then the sums of the blocks
that hold them are updated.

Edits of a document apply in order, each to the text that the one before left:
``start`` is clamped to the text and ``remove`` to what follows it; a null
start, remove or insert counts as 0, 0 and no text.  Edits of one document with
equal ``seq`` (ties) apply in order of start, remove and insert.  A null text
counts as empty; null ids and repeated rows are edited like any other; very
long texts are counted whole; a document without edits keeps its counts; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, id_text, vocabulary_path
from loomwork.llm.bpe import Encoder, load_table, small_batches

BLOCK, CONTEXT = 64, 3
VOCABULARY = "byte_bpe_50k.tiktoken"
EDITS = "array<struct<start:bigint,remove:bigint,insert:string>>"


class SumTree:
    """Sums of (characters, tokens) over a sequence of blocks."""

    def __init__(self, sums: np.ndarray):
        self.rebuild(sums)

    def rebuild(self, sums: np.ndarray) -> None:
        n = len(sums)
        self.size = 1 << max(0, (n - 1)).bit_length() if n > 1 else 1
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + n] = sums
        half = self.size
        while half > 1:
            below = self.sums[half : 2 * half]
            half //= 2
            self.sums[half : 2 * half] = below[0::2] + below[1::2]

    def set(self, block: int, value: tuple[int, int]) -> None:
        i = block + self.size
        self.sums[i] = value
        i //= 2
        while i:
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            i //= 2

    def find(self, char: int) -> tuple[int, int]:
        """The block that holds the character, and the characters before the block."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            left = int(self.sums[i, 0])
            if char >= before + left:
                before += left
                i += 1
        return i - self.size, before

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])


class CountedText:
    """One document's text, blocks of pre-tokens and sum tree."""

    def __init__(self, text: str, leaves: np.ndarray, encoder: Encoder):
        self.text, self.encoder, self.reencoded = text, encoder, 0
        #: New pre-tokens that are not encoded yet; the k-th one's leaf has -1 - k for its tokens.
        self.pending: list[str] = []
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [leaves]
        self.tree = SumTree(np.add.reduceat(leaves, np.arange(0, len(leaves), BLOCK), axis=0) if len(leaves) else leaves)

    @property
    def leaves(self) -> np.ndarray:
        return np.concatenate(self.blocks)

    def edit(self, start: int, remove: int, insert: str) -> None:
        self.replace(start, remove, insert)
        self.settle(self.encoder.known(self.pending))

    def settle(self, ids: dict[str, bytes]) -> None:
        """Gives the pending pre-tokens the lengths of their ids and updates the sums of their blocks."""
        if not self.pending:
            return
        counts = np.fromiter((len(ids[p]) >> 2 for p in self.pending), dtype=np.int64, count=len(self.pending))
        for k, block in enumerate(self.blocks):
            new = block[:, 1] < 0
            if new.any():
                block = block.copy()
                block[new, 1] = counts[-1 - block[new, 1]]
                self.blocks[k] = block
                self.tree.set(k, tuple(block.sum(axis=0)))
        self.pending = []

    def replace(self, start: int, remove: int, insert: str) -> None:
        """Edits the text and the boundaries; the new pre-tokens become pending."""
        start = min(max(0, start), len(self.text))
        remove = min(max(0, remove), len(self.text) - start)
        if not remove and not insert:
            return
        shift = len(insert) - remove
        self.text = self.text[:start] + insert + self.text[start + remove :]
        # the last pre-token that cannot see the edit ends at or before this character
        block, before = self.tree.find(max(0, start - CONTEXT))
        block = min(block, len(self.blocks) - 1)
        if before > start - CONTEXT and block:
            block -= 1
            before -= int(self.tree.sums[self.tree.size + block, 0])
        ends = before + np.cumsum(self.blocks[block][:, 0])
        kept = int(np.searchsorted(ends, start - CONTEXT, side="right"))
        at = int(ends[kept - 1]) if kept else before
        # read new pre-tokens until a new boundary behind the edit is an old one
        behind = start + len(insert)
        last, base = block, before
        known: set[int] = set()
        upto = base  # old boundaries up to here are known, in old positions
        fresh, position = [], at
        for m in self.encoder.find(self.text, at):
            position = m.end()
            fresh.append(m.group())
            if position < behind:
                continue
            while upto < position - shift and last < len(self.blocks):
                stops = upto + np.cumsum(self.blocks[last][:, 0])
                known.update(stops.tolist())
                upto = int(stops[-1]) if len(stops) else upto
                last += 1
            if position - shift in known:
                break
        else:
            position = len(self.text)
            last, upto = len(self.blocks), position - shift
        # what is left of the last block that was opened
        rest = np.zeros((0, 2), dtype=np.int64)
        if position - shift < upto:
            tail = self.blocks[last - 1]
            stops = upto - tail[:, 0].sum() + np.cumsum(tail[:, 0])
            rest = tail[int(np.searchsorted(stops, position - shift, side="right")) :]
        first = len(self.pending)
        self.pending += fresh
        new = np.array([(len(p), -1 - k) for k, p in enumerate(fresh, first)], dtype=np.int64).reshape(-1, 2)
        self.reencoded += len(fresh)
        merged = np.concatenate([self.blocks[block][:kept], new, rest])
        last = max(last, block + 1)
        parts = [merged[i : i + BLOCK] for i in range(0, len(merged), BLOCK)] if len(merged) > 2 * BLOCK else [merged] * bool(len(merged))
        same = len(parts) == last - block
        self.blocks[block:last] = parts
        if not self.blocks:
            self.blocks = [np.zeros((0, 2), dtype=np.int64)]
            same = False
        if same:
            for k, p in enumerate(parts):
                self.tree.set(block + k, tuple(p.sum(axis=0)))
        else:
            self.tree.rebuild(np.array([b.sum(axis=0) for b in self.blocks], dtype=np.int64).reshape(-1, 2))


def leaves_of(texts: list[str], encoder: Encoder) -> list[np.ndarray]:
    """For each text the length and the number of tokens of its pre-tokens."""
    lists = [encoder.findall(t) for t in texts]
    find = encoder.known(set().union(*lists)).__getitem__
    out = []
    for pieces in lists:
        n = len(pieces)
        both = np.empty((n, 2), dtype=np.int64)
        both[:, 0] = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        both[:, 1] = np.fromiter(map(len, map(find, pieces)), dtype=np.int64, count=n) >> 2
        out.append(both)
    return out


def _build(batches, encoder: Encoder):
    """For batches (doc_id, text and, if there, edits): doc_id, text, tree, n_tokens and edits."""
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for part in small_batches(texts):
            leaves = leaves_of(texts[part], encoder)
            trees = pa.array([x.astype("<u4").tobytes() for x in leaves], pa.binary())
            counts = pa.array([int(x[:, 1].sum()) for x in leaves], pa.int64())
            own = [b.column(k).slice(part.start, part.stop - part.start) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(texts[part], pa.string()), trees, counts, *own[2:]], ["doc_id", "text", "tree", "n_tokens", "edits"][: 2 + len(own)])


def build_trees(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, tree (lengths and counts of pre-tokens as 32-bit pairs) and n_tokens."""
    table = df.sparkSession.sparkContext.broadcast(load_table(path))
    return id_text(df, id_col, text_col).mapInArrow(lambda batches: _build(batches, Encoder(table.value)), "doc_id long, text string, tree binary, n_tokens long")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the edits (doc_id, seq, start, remove, insert) of each document in order of seq."""
    one = F.struct("seq", "start", "remove", "insert")
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))
    each = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["remove"].alias("remove"), e["insert"].alias("insert"))).cast(EDITS)
    return trees.join(lists.withColumn("edits", each), "doc_id", "left")


_EDITED = "doc_id long, text string, tree binary, n_tokens long, n_tokens_before long, n_edits long, n_pretokens long, n_reencoded long"


def _apply(batches, encoder: Encoder):
    """For batches (doc_id, text, tree, n_tokens, edits): what ``apply_edits`` gives."""
    kinds = (pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 5)
    names = [x.split()[0] for x in _EDITED.split(", ")]
    for b in batches:
        sizes = [len(t) for t in b.column(1).to_pylist()]
        start = 0
        while start < b.num_rows:
            stop = start + 1
            chars = sizes[start]
            while stop < b.num_rows and chars + sizes[stop] <= 1 << 21 and stop - start < 512:
                chars += sizes[stop]
                stop += 1
            out, made = [], []
            for doc_id, text, tree, before, edits in zip(*[c.to_pylist() for c in b.slice(start, stop - start).columns], strict=True):
                counted = CountedText(text, np.frombuffer(tree, dtype="<u4").astype(np.int64).reshape(-1, 2), encoder)
                for e in edits or ():
                    if e is not None:
                        counted.replace(e["start"] or 0, e["remove"] or 0, e["insert"] or "")
                made.append((doc_id, counted, before, edits))
            ids = encoder.known(set().union(*[m[1].pending for m in made]))
            for doc_id, counted, before, edits in made:
                counted.settle(ids)
                leaves = counted.leaves
                out.append((doc_id, counted.text, leaves.astype("<u4").tobytes(), counted.tree.tokens, before, len(edits or ()), len(leaves), counted.reencoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            start = stop


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """The trees after their ``edits``: doc_id, text, tree, n_tokens, n_tokens_before, n_edits, n_pretokens, n_reencoded."""
    table = trees.sparkSession.sparkContext.broadcast(load_table(path))
    rows = trees.select("doc_id", "text", "tree", "n_tokens", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(lambda batches: _apply(batches, Encoder(table.value)), _EDITED)


def edit_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``build_trees`` and ``apply_edits`` of rows that have their edits, in one worker with one cache."""
    table = df.sparkSession.sparkContext.broadcast(load_table(path))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))

    def run(batches):
        encoder = Encoder(table.value)
        yield from _apply(_build(batches, encoder), encoder)

    return rows.mapInArrow(run, _EDITED)


def standard_edits(docs: DataFrame, edits: int = 4) -> DataFrame:
    """doc_id, text and an ``edits`` column: replacements at places that checksums of the id spread over the text."""
    key = lambda k, salt: F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(k), F.lit(salt)).cast("binary"))
    length = F.length(F.coalesce("text", F.lit("")))
    words = F.array(*[F.lit(w) for w in ("", " and", "n't ", "\n\n", " 2024", "é", "...", " over the")])
    each = [
        F.struct(
            F.pmod(key(k, "at"), length + 1).cast("long").alias("start"),
            F.pmod(key(k, "cut"), F.lit(12)).cast("long").alias("remove"),
            F.get(words, F.pmod(key(k, "word"), F.lit(8)).cast("int")).alias("insert"),
        )
        for k in range(edits)
    ]
    return docs.withColumn("edits", F.array(*each))


def op10_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after four edits, with a checksum of the edited text."""
    path = vocabulary_path(VOCABULARY)
    done = edit_counts(standard_edits(id_text(documents(spark, sf_dir))), path)
    return done.select("doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_pretokens", "n_reencoded", F.sha2("text", 256).alias("text_sha256"))
