"""Interval joins on sheets without pairing everything inside a sheet.

Each rectangle is filed under the tiles it covers at the level that fits its size, and under the coarser tiles above.
Two rectangles meet in a tile of the coarser one's level, so the join is an equi-join on (keys, level, tile) and a hot
sheet spreads over its tiles. A pair is reported only in the tile that holds the corner of the intersection, hence once.
Where a side is cheap to read, an aggregate first finds its coarsest level, and the other files no coarser tiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.session import cut_lineage

RECT = ["r0", "c0", "r1", "c1"]
# (rows, columns) of a tile per level, as powers of two.
LEVELS = ((6, 4), (10, 8), (14, 12))
#: Groups with so many rows, or fewer, are held as arrays.
FEW = 64


def _own_level(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    fits = lambda lv: (r1 - r0 < 1 << LEVELS[lv][0]) & (c1 - c0 < 1 << LEVELS[lv][1])
    return F.when(fits(1), 0).when(fits(2), 1).otherwise(2)


def _spans(rect: tuple[Column, ...], tag: Column | int) -> list[Column]:
    """Tile span of a rectangle at each level."""
    r0, c0, r1, c1 = rect
    return [
        F.struct(
            F.lit(lv).alias("lv"),
            F.lit(tag).alias("tag"),
            F.shiftright(r0, h).alias("i0"),
            F.shiftright(r1, h).alias("i1"),
            F.shiftright(c0, w).alias("j0"),
            F.shiftright(c1, w).alias("j1"),
        )
        for lv, (h, w) in enumerate(LEVELS)
    ]


def _unfold(df: DataFrame, spans: Column, keep: Column, name: str) -> DataFrame:
    """One row per tile, by plain explodes, which stay inside generated code."""
    d = df.withColumn("_s", F.explode(spans)).filter(keep)
    d = d.withColumn("_i", F.explode(F.sequence("_s.i0", "_s.i1"))).withColumn("_j", F.explode(F.sequence("_s.j0", "_s.j1")))
    tile = F.struct(F.col("_s.lv").alias("lv"), F.col("_s.tag").alias("tag"), F.col("_i").alias("ti"), F.col("_j").alias("tj"))
    return d.withColumn(name, tile).drop("_s", "_i", "_j", "_own")


def _coarsest(df: DataFrame, grow: int = 0) -> Column:
    r0, c0, r1, c1 = (F.col(c) for c in RECT)
    return df.agg(F.max(_own_level(r0 - grow, c0 - grow, r1 + grow, c1 + grow))).scalar()


def _filed_left(df: DataFrame, grow: int, points: bool, levels: DataFrame | None) -> DataFrame:
    """Own tiles carry tag 0, coarser ones tag 1; those only up to the coarsest level of ``levels``, where it is given."""
    rect = (F.col("r0") - grow, F.col("c0") - grow, F.col("r1") + grow, F.col("c1") + grow)
    d = df.withColumn("_own", F.lit(0) if points else _own_level(*rect))
    spans = [s.withField("tag", F.when(F.col("_own") == lv, 0).otherwise(1)) for lv, s in enumerate(_spans(rect, 0))]
    keep = F.col("_s.lv") >= F.col("_own")
    if levels is not None:
        keep = keep & ((F.col("_s.lv") == F.col("_own")) | (F.col("_s.lv") <= _coarsest(levels)))
    return _unfold(d, F.array(*spans), keep, "_t")


def _filed_right(df: DataFrame, grow: int, points: bool, levels: DataFrame | None) -> DataFrame:
    """Own and coarser tiles meet tag 0, own tiles alone meet tag 1, which no rectangle of the finest level carries.

    Points are all of the finest level, so only that level's tiles can meet their tag 0; others meet none above the coarsest
    level of ``levels``, where it is given.
    """
    rect = tuple(F.col("o_" + c) for c in RECT)
    d = df.withColumn("_own", _own_level(*rect))
    lv, tag = F.col("_s.lv"), F.col("_s.tag")
    own = (lv == F.col("_own")) & ((tag == 0) | (lv > 0))
    keep = own & ((tag == 1) | (lv == 0)) if points else own | ((lv > F.col("_own")) & (tag == 0))
    if levels is not None and not points:
        keep = keep & ((tag == 1) | (lv <= _coarsest(levels, grow)))
    return _unfold(d, F.array(*_spans(rect, 0), *_spans(rect, 1)), keep, "_u")


def _sides(
    left: DataFrame, right: DataFrame, keys: list[str], grow: int, points: bool = False, levels: DataFrame | None = None,
    left_levels: DataFrame | None = None,
):
    """Both sides filed under tiles, and the conditions of the join. ``points``: the left side holds single cells.

    ``levels`` is a frame, cheap to read, with rectangles as large as the right side's or larger; often the right side itself.
    ``left_levels`` is the same for the left side.
    """
    assert not points or grow < 1 << LEVELS[1][1] - 1, grow
    renamed = right.select(*[F.col(c).alias("o_" + c if c in RECT else c) for c in right.columns])
    a = _filed_left(left, grow, points, levels).alias("a")
    # Tiles multiply the rows, which Spark's estimate of a file's size does not see: never broadcast them.
    b = _filed_right(renamed.select(*[F.col(c).alias("_k_" + c if c in keys else c) for c in renamed.columns]), grow, points, left_levels).hint("merge").alias("b")
    cond = [F.col("a." + k) == F.col("b._k_" + k) for k in keys]
    cond += [F.col("a._t." + x) == F.col("b._u." + x) for x in ("lv", "ti", "tj", "tag")]
    meets = (
        (F.col("r0") - grow <= F.col("o_r1"))
        & (F.col("o_r0") <= F.col("r1") + grow)
        & (F.col("c0") - grow <= F.col("o_c1"))
        & (F.col("o_c0") <= F.col("c1") + grow)
    )
    return a, b, cond, meets


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], grow: int = 0, points: bool = False, levels: DataFrame | None = None,
    left_levels: DataFrame | None = None,
) -> DataFrame:
    """Every overlapping pair once. The right rectangle comes out as ``o_r0 .. o_c1``; other columns must not collide."""
    a, b, cond, meets = _sides(left, right, keys, grow, points, levels, left_levels)
    corner_r = F.greatest(F.col("r0") - grow, F.col("o_r0"))
    corner_c = F.greatest(F.col("c0") - grow, F.col("o_c0"))
    here = F.lit(False)
    for lv, (h, w) in enumerate(LEVELS):
        at_corner = (F.shiftright(corner_r, h) == F.col("_t.ti")) & (F.shiftright(corner_c, w) == F.col("_t.tj"))
        here = here | ((F.col("_t.lv") == lv) & at_corner)
    on = meets & here
    for c in cond:
        on = on & c
    return a.join(b, on).drop("_t", "_u", *["_k_" + k for k in keys])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], grow: int = 0) -> DataFrame:
    """Distinct left rectangles (keys and corners) that meet any right one. Copies are folded before the join.

    The right side is read twice, so it should be a table or little more than one.
    """
    a, b, cond, meets = _sides(
        left.select(*keys, *RECT).distinct(), right.select(*keys, *RECT).distinct(), keys, grow, levels=right
    )
    on = meets
    for c in cond:
        on = on & c
    return a.join(b, on, "left_semi").select(*keys, *RECT).distinct()


def flag_overlap(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left rows with a boolean column: does the rectangle meet any right one?"""
    return flag_overlaps(left, {name: right}, keys)


def split_small(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``FEW`` rows, and the keys of larger groups (none: there are none). ``df`` is a table."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = cut_lineage(size.filter(F.col("_n") > FEW).select(*keys))
    return df.join(size.filter(F.col("_n") <= FEW).select(*keys), keys), None if large.isEmpty() else large


def flag_overlaps(left: DataFrame, rights: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left rows with a boolean column for each right side.

    A group with few right rectangles brings them as arrays to its left rows, so nothing is filed under tiles. In larger groups
    left rectangles are folded once, and all flags return in one join.
    """
    tagged = [right.select(*keys, *RECT, F.lit(name).alias("_of")) for name, right in rights.items()]
    r = cut_lineage(reduce(DataFrame.unionByName, tagged).distinct())
    small, large = split_small(r, keys)
    lists = small.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("_of") == n, F.struct(*RECT))).alias("_" + n) for n in rights])
    meets = lambda x: (x["r0"] <= F.col("r1")) & (F.col("r0") <= x["r1"]) & (x["c0"] <= F.col("c1")) & (F.col("c0") <= x["c1"])
    flagged = left.join(lists, keys, "left")
    flags = {n: F.coalesce(F.exists("_" + n, meets), F.lit(False)) for n in rights}
    if large is not None:
        own = cut_lineage(left.select(*keys, *RECT).join(large, keys, "left_semi").distinct())
        hits = []
        for name in rights:
            right = r.filter(F.col("_of") == name).join(large, keys, "left_semi").select(*keys, *RECT)
            a, b, cond, on = _sides(own, right, keys, 0, levels=r, left_levels=own)
            for c in cond:
                on = on & c
            hits.append(a.join(b, on, "left_semi").select(*keys, *RECT, *[F.lit(n == name).alias("_m_" + n) for n in rights]))
        met = reduce(DataFrame.unionByName, hits).groupBy(*keys, *RECT).agg(*[F.max("_m_" + n).alias("_m_" + n) for n in rights])
        flagged = flagged.join(met, [*keys, *RECT], "left")
        flags = {n: f | F.coalesce(F.col("_m_" + n), F.lit(False)) for n, f in flags.items()}
    return flagged.select(*left.columns, *[f.alias(n) for n, f in flags.items()])


def semi_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(overlapping(left, right, keys), [*keys, *RECT], "left_semi")


def anti_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(overlapping(left, right, keys), [*keys, *RECT], "left_anti")
