"""Near-duplicate documents by MinHash.

Equal shingle sets become one class. Class representatives get the minima of many universal hash functions; bands of them are
buckets. Each bucket member is compared with the bucket's smallest document first, and links found become components. Where a
bucket still holds several, the blocks of documents that meet in it are compared inside a task: by signature, and what a
signature cannot rule out on the full sets. Only confirmed links leave the task, so a group's pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from formloom.llm.common import by_slices, cut_plain, give_back, read_table
from formloom.llm.components import connected
from formloom.llm.shingles import Minima, mix, shingle_set
from formloom.session import drop_cut

#: Bands and minima in each: a pair at similarity 0.75 misses all bands with probability 1.3e-6.
BANDS, ROWS = 50, 5
PERCENT = 75
#: Standard errors of the estimate from signatures that a pair may lie below the threshold and still be confirmed on its sets.
MARGIN = 5.0
#: Documents of a block, about.
BLOCK = 512


def _signature(minima: np.ndarray) -> list[bytes]:
    """Two bits of each mixed minimum, packed by fours. The lowest bits of the minima themselves depend on two bits of a shingle."""
    two = (mix(minima) & np.uint64(3)).astype(np.uint8)
    two = np.pad(two, ((0, 0), (0, -two.shape[1] % 4)))
    return [x.tobytes() for x in two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6]


def sketch(bands: int, rows: int) -> Column:
    """From a text: ``n`` (its shingles), ``set_key`` (equal for equal sets), ``bands`` and ``signature``; null without shingles."""
    kind = "struct<n:bigint,set_key:binary,bands:array<bigint>,signature:binary>"

    minima = Minima(bands * rows)

    def some(texts: list) -> pa.Array:
        sets = [shingle_set(t) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        m = minima.of([sets[i] for i in full]) if full else np.empty((0, bands * rows), np.uint64)
        keys: list = [None] * len(sets)
        band: list = [None] * len(sets)
        sign: list = [None] * len(sets)
        for i, x, s in zip(full, m.reshape(len(full), bands, rows), _signature(m)):
            keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            band[i] = np.array([xxhash.xxh3_64_intdigest(x[k].tobytes(), k) for k in range(bands)], np.uint64).view(np.int64)
            sign[i] = s
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sign, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["n", "set_key", "bands", "signature"])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(some, texts)

    return run


def _full_sets(texts: list) -> pa.Array:
    sets = [shingle_set(t) for t in texts]
    keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
    return pa.StructArray.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "items"])


@F.arrow_udf(StructType([StructField("key", BinaryType()), StructField("items", ArrayType(LongType()))]))
def _full_set(texts: pa.Array) -> pa.Array:
    return by_slices(_full_sets, texts)


#: The key of a text without shingles.
EMPTY_KEY = xxhash.xxh3_128_digest(b"")


#: Marked so that no filter on its result moves it below the join that selects the texts it is for.
full_set = _full_set.asNondeterministic()


def _signs(signatures: list[bytes], count: int) -> np.ndarray:
    """Signatures as rows of +1 and -1 whose inner product counts equal minima: each two-bit value by its three characters."""
    raw = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    two = np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(raw), -1)[:, :count]
    a, b = 1 - 2 * (two & 1).astype(np.float32), 1 - 2 * (two >> 1).astype(np.float32)
    return np.concatenate([a, b, a * b], axis=1)


def least_equal(count: int, percent: int, margin: float) -> float:
    """Equal two-bit minima from which a pair may reach the threshold."""
    p = percent / 100
    p += (1 - p) / 4
    return count * p - margin * np.sqrt(count * p * (1 - p))


def _block_links(count: int, percent: int, margin: float):
    """Links between documents of different components in pairs of blocks ``a, b``; ``side`` tells the blocks apart."""
    least = least_equal(count, percent, margin)

    def confirmed(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which sets reach the threshold with the first one; sets are sorted."""
        sizes = np.array([len(x) for x in others])
        every = np.concatenate(others)
        at = np.minimum(np.searchsorted(one, every), len(one) - 1)
        common = np.add.reduceat((one[at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        return common * 100 >= (len(one) + sizes - common) * percent

    def links(rows: pa.Table, starts: np.ndarray) -> np.ndarray:
        """Links of the pairs of blocks that begin at ``starts``; the last start is the end."""
        a, b, side, rep, component, n = (rows[c].to_numpy() for c in ("a", "b", "side", "rep", "component", "n"))
        items = rows["items"].combine_chunks()
        ends, flat = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        signatures = rows["signature"].to_pylist()
        found = [np.empty((0, 2), np.int64)]
        for first, end in zip(starts[:-1], starts[1:]):
            middle = first + int(np.searchsorted(side[first:end], 1))
            left = np.arange(first, middle)
            right = left if a[first] == b[first] else np.arange(middle, end)
            if not len(left) or not len(right):
                continue
            equal = (count + _signs([signatures[k] for k in left], count) @ _signs([signatures[k] for k in right], count).T) / 4
            x, y = n[left][:, None], n[right]
            fits = (equal >= least) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent) & (component[left][:, None] != component[right])
            for i in np.flatnonzero(fits.any(axis=1)):
                j = right[np.flatnonzero(fits[i])]
                j = j[confirmed(sets[left[i]], [sets[k] for k in j])]
                found.append(np.stack([np.full(len(j), rep[left[i]]), rep[j]], axis=1))
        return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of pairs and sides; a pair is done once the next one begins."""
        rest: pa.Table | None = None
        for batch in chain(batches, (None,)):
            if batch is None and rest is None:
                break
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(1, np.int64)
            if batch is None:
                starts = np.append(starts, len(a))
            done = links(rows.slice(0, starts[-1]).combine_chunks(), starts)
            rest = rows.slice(starts[-1])
            yield pa.RecordBatch.from_pydict({"a": pa.array(done[:, 0]), "b": pa.array(done[:, 1])})
        give_back()

    return run


def _similar(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``a, b`` whose full sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = edges.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Documents link if 100 times the common shingles reach ``percent`` times all their shingles (five lower-cased words each;
    a shorter text is one shingle). The component is the smallest doc_id that links lead to. Null, empty and blank texts
    have no shingle and link with nothing; rows without doc_id have no component. Classes are those of texts: where a doc_id is
    repeated, each row has the component of its own text. An empty table gives an empty result. No cap on partners: whatever shares
    a band is compared, in blocks of bounded size, by signature and, where that cannot rule a link out, by full sets.
    """
    return _components(docs, **options).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """The rows of ``near_duplicates`` with ``set_key`` and ``component``, a number for each component of texts (null without shingles).

    Texts with the same shingles are one class, which has a number of its own (``rep``), as a doc_id may stand for several texts.
    """
    count = bands * rows
    least = float(least_equal(count, percent, margin))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    marks = cut_plain(base.select("doc_id", sketch(bands, rows)(F.col("text")).alias("s")).select("doc_id", "s.*"))
    some = marks.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut_plain(some.groupBy("set_key").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()))
    named = classes.select(F.col("set_key").alias("c_key"), "low", "rep")
    own = (F.col("doc_id") == F.col("low")) & (F.col("set_key") == F.col("c_key"))
    # One row a class, even where a row is repeated; the join has dealt the rows by both columns already.
    reps = cut_plain(some.join(named.hint("merge"), own).dropDuplicates(["doc_id", "set_key"]).select("rep", "low", "n", "set_key", "bands", "signature"))
    filed = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = filed.groupBy(F.col("bucket").alias("k")).agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("k", "first")
    member = cut_plain(filed.join(shared.hint("merge"), F.col("bucket") == F.col("k")).select("bucket", "rep", "first"))
    # The sets of all documents that share a bucket. The join is a merge join at every size: texts move once.
    sign = reps.join(member.select(F.col("rep").alias("w")).distinct(), F.col("rep") == F.col("w"), "left_semi").select("rep", "low", "n", "set_key", "signature")
    sets = base.join(sign.hint("merge"), F.col("doc_id") == F.col("low")).select("low", "rep", "n", "set_key", "signature", full_set(F.col("text")).alias("s"))
    sets = cut_plain(sets.where("set_key = s.key").dropDuplicates(["low", "set_key"]).select("rep", "n", "signature", "s.items"))
    drop_cut(reps)

    star = member.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    tested = cut_plain(star.join(one, "a").join(two, "b").where(fits & (equal_minima(count)(F.col("s_a"), F.col("s_b")) >= least)).select("a", "b"))
    links = _similar(tested, sets, percent)
    first = cut_plain(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    late = cut_plain(_late_links(member, sets, first, count, percent, margin, block))
    told = lambda c, n: late.join(first, F.col(c) == F.col("node"), "left").select("a", "b", F.coalesce("component", c).alias(n))
    second = cut_plain(connected(told("a", "u").join(told("b", "v"), ["a", "b"]).select("u", "v")))
    for table in (member, sets, tested, late):
        drop_cut(table)
    step = first.select(F.col("node").alias("f_node"), F.col("component").alias("f_component"))
    known = named.join(step, F.col("rep") == F.col("f_node"), "left").select("c_key", "low", F.coalesce("f_component", "rep").alias("c"))
    known = cut_plain(known.join(second, F.col("c") == F.col("node"), "left").select("c_key", "low", F.coalesce("component", "c").alias("component")))
    least_id = known.groupBy("component").agg(F.min("low").alias("component_id"))
    out = marks.join(known.join(least_id, "component"), F.col("set_key") == F.col("c_key"), "left")
    shown = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), shown, "set_key", "component")


def _late_links(member: DataFrame, sets: DataFrame, first: DataFrame, count: int, percent: int, margin: float, block: int) -> DataFrame:
    """Links that the comparison with each bucket's smallest document has missed.

    Only buckets that hold several components matter. Their documents are put into blocks by the smallest document that a
    chain of two buckets leads to, a large group into several blocks; block pairs that meet in such a bucket are compared.
    """
    placed = member.join(first, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "first", F.coalesce("component", "rep").alias("component"))
    open_ones = placed.groupBy(F.col("bucket").alias("k")).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("k")
    rest = cut_plain(placed.join(open_ones, F.col("bucket") == F.col("k")).select("bucket", "rep", "first", "component"))
    homes = rest.groupBy("rep", "component").agg(F.min("first").alias("home"))
    jump = homes.select(F.col("rep").alias("j_rep"), F.col("home").alias("j_home")).distinct()
    homes = homes.join(jump, F.col("home") == F.col("j_rep"), "left").select("rep", "component", F.coalesce("j_home", "home").alias("home"))
    split = homes.groupBy(F.col("home").alias("h")).agg(F.ceil(F.count("*") / block).alias("parts"))
    where = F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts")))
    blocks = cut_plain(homes.join(split, F.col("home") == F.col("h")).select("rep", "component", where.alias("block")))
    # Most buckets of a group hold the same blocks, so only distinct lists of blocks are unfolded to pairs.
    lists = rest.select("bucket", "rep").join(blocks.select("rep", "block"), "rep").groupBy("bucket").agg(F.array_sort(F.collect_set("block")).alias("x")).select("x").distinct()
    pairs = lists.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a <= b").distinct()
    pairs = cut_plain(pairs)
    full = blocks.join(sets, "rep").select("rep", "component", "block", "n", "signature", "items")
    facing = full.join(pairs, F.col("block") == F.col("a")).withColumn("side", F.lit(0))
    facing = facing.union(full.join(pairs.where("a < b"), F.col("block") == F.col("b")).withColumn("side", F.lit(1)))
    facing = facing.select("a", "b", "side", "rep", "component", "n", "signature", "items").repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return facing.mapInArrow(_block_links(count, percent, margin), "a bigint, b bigint").distinct()


def equal_minima(count: int) -> Column:
    """How many two-bit minima two signatures share."""

    @F.arrow_udf("bigint")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        if not len(left):
            return pa.array([], pa.int64())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (left, right))
        differ = x ^ y
        differ = (differ | differ >> 1) & 0x55
        return pa.array(count - np.bitwise_count(differ).sum(axis=1, dtype=np.int64), pa.int64())

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, in the columns of ``docs``: the one with the smallest doc_id. Rows without doc_id stay.

    Where that doc_id stands for several texts of the component, or its row is repeated, one row stays, the same at each run.
    Rows without shingles stay, one for each doc_id.
    """
    found = cut_plain(_components(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "set_key", "component", "component_id"))
    best = F.min(F.struct("doc_id", "set_key"))
    linked = found.where("component IS NOT NULL AND doc_id = component_id").groupBy("component").agg(best.alias("k"))
    kept = linked.select("k.*").union(found.where("component IS NULL").select("doc_id", "set_key").distinct())
    often = found.groupBy("doc_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(F.col("doc_id").alias("o_doc"))
    kept = kept.join(often, F.col("doc_id") == F.col("o_doc"), "left").select(F.col("doc_id").alias("k_doc"), F.col("set_key").alias("k_key"), F.col("o_doc").isNotNull().alias("often"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = row.join(kept.where("NOT often"), F.col("row.doc_id") == F.col("k_doc"), "left_semi")
    # Only rows of repeated ids need their text's class again.
    several = row.join(kept.where("often"), F.col("row.doc_id") == F.col("k_doc")).select("row", "k_doc", "k_key", full_set(F.col("row.text"))["key"].alias("key"))
    several = several.where(F.coalesce(F.col("k_key") == F.col("key"), F.col("key") == F.lit(EMPTY_KEY)))
    order = W.partitionBy("k_doc", "key").orderBy(F.xxhash64("row"), F.col("row.text"))
    several = several.withColumn("place", F.row_number().over(order)).where("place = 1").select("row")
    return once.union(several).union(row.where("row.doc_id IS NULL")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
