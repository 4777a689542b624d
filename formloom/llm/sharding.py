"""Sharding by a k-d tree over document metadata.

The tree starts with one node that stands for all shards. A node with several shards is cut along its widest dimension at the
weighted median (or the share that fits an odd number of shards), until every leaf holds one shard's bytes. Medians are
found by histograms that each task sums up before the shuffle; the tree itself is a nested CASE, so the texts never move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import read_table
from formloom.session import cut_lineage

#: Metadata that spans the tree; each is a long column of ``metadata()``.
DIMENSIONS = ("source_code", "bytes", "lang_code", "doc_place")
#: Bins of a histogram for each shard that the node stands for.
BINS = 4096
TIE_BITS = 31
#: A cut may miss its share by this part of one shard's bytes, or by one document.
TOLERANCE = 0.0005


@dataclass
class Node:
    shards: int
    first: int
    cut: tuple[str, int, int, int] | None = None  # dimension, lowest value, step, key at which the right part begins
    left: Node | None = None
    right: Node | None = None
    widths: dict[str, int] | None = None  # of the whole table, kept at the root

    def leaves(self) -> list[Node]:
        return [self] if self.cut is None else [*self.left.leaves(), *self.right.leaves()]


def metadata(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32``, the dimensions, and ``tie``, which orders documents of equal value: copies of a text first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(-1)).cast("long")
    size = (F.octet_length(text) + overhead).cast("long")
    crc = F.crc32(text.cast("binary"))
    mixed = F.xxhash64("doc_id")
    return docs.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        code("source").alias("source_code"),
        size.alias("bytes"),
        code("lang").alias("lang_code"),
        F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), 2).alias("doc_place"),
        F.shiftleft(F.shiftright(crc, 17), 16).bitwiseOR(mixed.bitwiseAND(F.lit(0xFFFF))).alias("tie"),
    )


def _key(dimension: str, lowest: int, step: int) -> Column:
    return F.expr(f"shiftleft(({dimension} - {lowest}L) div {step}L, {TIE_BITS}) + tie")


def _route(node: Node, leaf: Callable[[Node], Column]) -> Column:
    if node.cut is None:
        return leaf(node)
    dimension, lowest, step, at = node.cut
    return F.when(_key(dimension, lowest, step) < F.lit(at), _route(node.left, leaf)).otherwise(_route(node.right, leaf))


def _of_node(values: dict[int, int], node: str = "node") -> Column:
    """The value that belongs to the row's node; null for nodes without one."""
    cells = ", ".join(f"{values[i]}L" if i in values else "CAST(NULL AS BIGINT)" for i in range(max(values) + 1))
    return F.expr(f"get(array({cells}), {node})")


def _find_cuts(rows: DataFrame, root: Node, tolerance: float) -> bool:
    """Cuts every leaf that stands for several shards and has documents; False if there was none."""
    open_leaves = {n.first: n for n in root.leaves() if n.shards > 1}
    if not open_leaves:
        return False
    at_leaf = rows.withColumn("node", _route(root, lambda n: F.lit(n.first if n.shards > 1 else None).cast("int"))).where("node IS NOT NULL")
    spans = [f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]
    stats = {r["node"]: r for r in at_leaf.groupBy("node").agg(F.sum("size").alias("total"), *spans).collect()}  # at most a row a shard
    state = {}
    for first, s in stats.items():
        width = {d: s[f"{d}_max"] - s[f"{d}_min"] for d in DIMENSIONS}
        root.widths = root.widths or width
        widest = max(DIMENSIONS, key=lambda d: width[d] / max(root.widths[d], 1))
        step = -(-(width[widest] + 1) // 2**TIE_BITS)
        node = open_leaves[first]
        share = s["total"] * ((node.shards + 1) // 2) / node.shards
        top = ((width[widest] // step) << TIE_BITS) + 2**TIE_BITS - 1
        state[first] = {"key": (widest, s[f"{widest}_min"], step), "lo": 0, "hi": top, "before": 0, "share": share, "fine": tolerance * s["total"] / node.shards}
    while state:
        each = lambda f: _of_node({n: f(x) for n, x in state.items()})
        value = F.get(F.array(*DIMENSIONS), each(lambda x: DIMENSIONS.index(x["key"][0])).cast("int"))
        keyed = at_leaf.select("node", "size", "tie", value.alias("value"), each(lambda x: x["key"][1]).alias("lowest"), each(lambda x: x["key"][2]).alias("step"))
        keyed = keyed.withColumn("key", F.expr(f"shiftleft((value - lowest) div step, {TIE_BITS}) + tie"))
        bits = {n: max(0, (x["hi"] - x["lo"]).bit_length() - (BINS * open_leaves[n].shards).bit_length() + 1) for n, x in state.items()}
        counted = (
            keyed.where(F.col("key").between(each(lambda x: x["lo"]), each(lambda x: x["hi"])))
            .withColumn("lo", each(lambda x: x["lo"]))
            .withColumn("bits", _of_node(bits).cast("int"))
            .withColumn("bin", F.expr("(key - lo) div shiftleft(1L, bits)"))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("words"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        )
        start = F.sum("words").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
        want = F.coalesce(*[F.when(F.col("node") == f, F.lit(float(x["share"] - x["before"]))) for f, x in state.items()])
        hit = counted.withColumn("start", start).where((F.col("start") < want) & (want <= F.col("start") + F.col("words"))).collect()  # a row a node
        done = {f: state[f]["lo"] for f in set(state) - {r["node"] for r in hit}}
        for r in hit:
            x = state[r["node"]]
            x |= {"before": x["before"] + r["start"], "lo": r["lo"], "hi": r["hi"]}
            if r["words"] <= x["fine"] or r["lo"] == r["hi"]:
                nearer_end = x["before"] + r["words"] - x["share"] <= x["share"] - x["before"]
                done[r["node"]] = r["hi"] + 1 if nearer_end else r["lo"]
        for f, at in done.items():
            node, big = open_leaves[f], (open_leaves[f].shards + 1) // 2
            node.left, node.right = Node(big, f), Node(node.shards - big, f + big)
            node.cut = (*state.pop(f)["key"], at)
    return bool(stats)


def build_tree(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Node:
    """The tree over ``metadata()`` rows. The driver holds one row a node, never more than there are shards."""
    root = Node(shards, 0)
    while _find_cuts(rows, root, tolerance):
        pass
    return root


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for ``doc_id, text, lang, source``; other columns are ignored.

    Shards get near equal bytes (law ``bytes``). A null text counts as empty, a null source or language as a value of its own,
    a null doc_id as 0. Rows equal in every dimension and in ``tie`` stay in one shard. One document longer than a shard
    fills its shard alone or with few others; with fewer documents than shards some stay empty. Slots number the
    documents of a shard without gaps, in hash order, by offsets of hash ranges; repeated rows get a slot each.
    """
    rows = cut_lineage(metadata(docs, overhead))
    tree = build_tree(rows, shards, tolerance)
    placed = rows.select("doc_id", "size", "text_crc32", _route(tree, lambda n: F.lit(n.first)).cast("int").alias("shard"), F.xxhash64("doc_id").alias("mixed"))
    placed = placed.withColumn("bin", F.shiftrightunsigned("mixed", 52))
    per_bin = placed.groupBy(F.col("shard").alias("c_shard"), F.col("bin").alias("c_bin")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c_shard").orderBy("c_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = per_bin.select("c_shard", "c_bin", before.alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("mixed", "doc_id", "size", "text_crc32"))
    return placed.join(offsets, (F.col("shard") == F.col("c_shard")) & (F.col("bin") == F.col("c_bin"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + number - 1).alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
