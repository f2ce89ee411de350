"""Sharding by a k-d tree over document metadata.

The tree splits recursively at weighted medians (or the weighted quantile that
matches an uneven number of leaves) along the widest metadata dimension, until
a leaf holds the target bytes.  All nodes of a level are split together.  The
weighted quantile is found by histogram refinement: each pass sums the weights
of ``BINS`` equal bins of every open node, and the next pass looks only into
the bin that holds the quantile, until an edge is within ``tolerance`` of a
leaf's weight.  The driver sees at most nodes x BINS sums.  Points are ordered
by (dimension, text checksum), so that equal texts, which share every dimension
used here, always stay together: a cut goes beside a group, on the nearer side.
The halves then share the leaves in proportion to what they hold, so that a
group that is larger than a shard gets one of its own and the others stay
near equal.

Defined results: a null text has no bytes (size 16, checksum 0); a null
language is a point of its own; rows with a null ``doc_id`` and repeated rows
each get a slot; ties in all dimensions are a group; of equally wide dimensions
the first is split; very long texts are measured whole; an empty table gives an
empty result; shards that get no row stay empty; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm._shared import documents, materialise

BINS, OVERHEAD = 1024, 16


@dataclass
class Node:
    """A leaf, or a split of the rows below ``cut`` (a prefix of dim, crc) from the others."""

    leaves: int
    shard: int
    dim: str | None = None
    cut: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


def _below(dim: str, cut: list[int]) -> Column:
    """Whether (dim, crc) comes before the cut."""
    keys = [F.col(dim), F.col("crc")][: len(cut)]
    out = keys[-1] < cut[-1]
    for k, v in list(zip(keys, cut, strict=True))[-2::-1]:
        out = (k < v) | ((k == v) & out)
    return out


def _shard_of(node: Node) -> Column:
    """The first shard of the node that a row has reached so far."""
    if node.left is None:
        return F.lit(node.shard)
    return F.when(_below(node.dim, node.cut), _shard_of(node.left)).otherwise(_shard_of(node.right))


@dataclass
class _Search:
    """The state of one node's search for its weighted quantile."""

    node: Node
    keys: list[str]
    target: float
    tolerance: float
    low: int
    high: int
    before: float = 0
    fixed: list[int] = field(default_factory=list)
    done: bool = False
    #: The weight below the cut.
    below: float = 0

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def following(self) -> str:
        return self.keys[min(len(self.fixed) + 1, len(self.keys) - 1)]

    def settle(self, edge: int, below: float) -> None:
        self.node.cut, self.below, self.done = [*self.fixed, edge], below, True

    def refine(self, bins: list) -> None:
        """Look at the sums of this pass: either an edge is near enough, or go on in the bin that holds the target."""
        total = self.before
        for b in bins:
            if total + b["w"] < self.target and b is not bins[-1]:
                total += b["w"]
                continue
            under, over = self.target - total, total + b["w"] - self.target
            tied = b["least"] == b["most"]
            if min(under, over) <= self.tolerance or tied and len(self.fixed) + 1 == len(self.keys):
                self.settle(*((b["least"], total) if under <= over else (b["most"] + 1, total + b["w"])))
            elif not tied:
                self.low, self.high, self.before = b["least"], b["most"], total
            else:
                self.fixed.append(b["least"])
                self.low, self.high, self.before = b["next_least"], b["next_most"], total
            return
        self.settle(self.low, total)


def _parameters(searches: list[_Search], keys: list[str]) -> Column:
    """By node: which columns to bin and to bound, and the bins."""
    of = lambda s: F.struct(
        F.lit(keys.index(s.keys[len(s.fixed)])).alias("key"), F.lit(keys.index(s.following())).alias("next"),
        F.lit(s.low).cast("long").alias("low"), F.lit(s.high).cast("long").alias("high"), F.lit(s.width).cast("long").alias("width"),
        F.array(*[F.lit(keys.index(k)) for k in s.keys[: len(s.fixed)]]).cast("array<int>").alias("tied"),
        F.array(*[F.lit(v).cast("long") for v in s.fixed]).cast("array<long>").alias("fixed"),
    )
    return F.create_map(*[x for s in searches for x in (F.lit(s.node.shard), of(s))])


def build_tree(points: DataFrame, dims: list[str], leaves: int, tolerance: float = 0.004) -> Node:
    """The tree over ``points``: long columns dims, crc and the weight w."""
    root, whole = Node(leaves, 0), None
    keys = list(dict.fromkeys([*dims, "crc"]))
    open_nodes = [root] if leaves > 1 else []
    while open_nodes:
        placed = points.withColumn("at", _shard_of(root)).filter(F.col("at").isin([n.shard for n in open_nodes]))
        ends = [f(c).alias(f"{c}_{n}") for c in dims for n, f in (("least", F.min), ("most", F.max))]
        stats = {r["at"]: r for r in placed.groupBy("at").agg(F.sum("w").alias("w"), *ends).collect()}
        whole = whole or stats.get(0)
        searches = []
        for node in open_nodes:
            node.left = Node(node.leaves // 2, node.shard)
            node.right = Node(node.leaves - node.leaves // 2, node.shard + node.leaves // 2)
            r = stats.get(node.shard)
            spread = lambda c, r=r: (r[f"{c}_most"] - r[f"{c}_least"]) / max(1, whole[f"{c}_most"] - whole[f"{c}_least"])
            node.dim = max(dims, key=lambda c: (spread(c), -dims.index(c))) if r else dims[0]
            if r:
                at = r["w"] * node.left.leaves / node.leaves
                searches.append(_Search(node, list(dict.fromkeys([node.dim, "crc"])), at, tolerance * r["w"] / node.leaves, r[f"{node.dim}_least"], r[f"{node.dim}_most"]))
            else:
                node.cut = [0]
        # the halves get their cuts before rows are placed below them
        halves = [(n, n.left, n.right) for n in open_nodes]
        for n, _, _ in halves:
            n.left = n.right = None
        while todo := [s for s in searches if not s.done]:
            rows = points.withColumn("at", _shard_of(root)).withColumn("p", _parameters(todo, keys)[F.col("at")])
            values, p = F.array(*[F.col(k).cast("long") for k in keys]), F.col("p")
            inside = F.get(values, p["key"]).between(p["low"], p["high"]) & F.forall(F.arrays_zip(p["tied"], p["fixed"]), lambda x: F.get(values, x["tied"]) == x["fixed"])
            rows = rows.filter(inside).select("at", "w", "p", F.get(values, p["key"]).alias("key"), F.get(values, p["next"]).alias("next"))
            rows = rows.withColumn("bin", F.call_function("div", F.col("key") - p["low"], p["width"]))
            sums = rows.groupBy("at", "bin").agg(
                F.sum("w").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"),
                F.min("next").alias("next_least"), F.max("next").alias("next_most"),
            )
            found: dict[int, list] = {}
            for r in sums.collect():
                found.setdefault(r["at"], []).append(r)
            for s in todo:
                s.refine(sorted(found.get(s.node.shard, []), key=lambda r: r["bin"]))
        weight = {id(s.node): (s.below, stats[s.node.shard]["w"]) for s in searches}
        for n, left, right in halves:
            below, all_of = weight.get(id(n), (0, 0))
            if all_of:  # leaves in proportion to what the halves hold
                left.leaves = min(n.leaves - 1, max(1, round(n.leaves * below / all_of)))
                right.leaves, right.shard = n.leaves - left.leaves, n.shard + left.leaves
            n.left, n.right = left, right
        open_nodes = [x for _, left, right in halves for x in (left, right) if x.leaves > 1]
    return root


def points_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions: language, size and checksum."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    lang = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    size = (F.octet_length(data) + OVERHEAD).cast("long")
    return rows.select(
        "doc_id", size.alias("size"), F.crc32(data).alias("text_crc32"),
        F.crc32(F.coalesce(F.col("lang"), F.lit("")).cast("binary")).alias("language"),
        F.floor(F.log2(size.cast("double")) * 65536).cast("long").alias("log_size"),
    )


def shard(
    df: DataFrame, shards: int | None = None, target_bytes: int | None = None, law: str = "bytes",
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``law`` is ``bytes`` (sizes near equal) or ``rows`` (every row weighs the
    same).  Without ``shards`` there are as many as ``target_bytes`` asks for.
    """
    points = materialise(points_of(df, id_col, text_col, lang_col), "shard-points")
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    keyed = points.withColumns({"crc": F.col("text_crc32"), "w": F.col("size") if law == "bytes" else F.lit(1)})
    root = build_tree(keyed, ["language", "log_size", "crc"], shards)
    placed = keyed.withColumn("shard", _shard_of(root).cast("int"))
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def slots(placed: DataFrame, rows_at_once: int = 200_000) -> DataFrame:
    """``placed`` with a gapless slot from 0 in each shard.

    Rows are numbered within (shard, part) and parts are offset by the rows
    before them, so no task sorts a whole shard.
    """
    biggest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-biggest // rows_at_once))
    parted = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(parts)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("shard", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    within = Window.partitionBy("shard", "part").orderBy("crc", "doc_id")
    numbered = parted.withColumn("n", F.row_number().over(within))
    return numbered.join(offsets.select("shard", "part", "offset"), ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("n") - 1).cast("long"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), shards=40)
