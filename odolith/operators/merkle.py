"""Hash trees over tables: two runs are compared by their roots, and where they differ is found by going down, not by comparing rows.

A leaf is a block of rows that are neighbours in order, at most ``span`` of distinct order; each further level hashes up to ``FAN`` nodes of the level below, in order, up to one
root for each group. Groups meet in a trie of the digests of their names, sixteen nodes at a time, up to one root for the whole table. No node ever holds
more than a block's row digests or its children's, so no group is gathered.

Rows that are equal in order count as a set with repeats. A null group, order or value has a place of its own: nulls are written as such in the text that is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.streaming.run import folder

SPAN, FAN = 4096, 64
#: levels of the trie over groups
TRIE = 4


def _text(c: str) -> Column:
    """A value with its length before it, so that no two rows of values are written alike."""
    s = F.col(c).cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s))


def _joined(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One hash for all rows (keys, order, hash, n) of the same keys."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(order), F.lit(-1).cast("long")).alias("o"), "hash")))
    return df.groupBy(*keys).agg(rows.alias("r"), F.sum("n").alias("n")).select(*keys, F.sha2(F.concat_ws(",", F.transform("r", lambda x: x["hash"])), 256).alias("hash"), "n")


def leaves(df: DataFrame, group: str, order: str, values: list[str], span: int = SPAN) -> DataFrame:
    """(grp, idx, hash, n) of blocks of rows; ``order`` is a long."""
    rows = df.select(F.col(group).cast("string").alias("grp"), F.floor(F.col(order) / span).alias("idx"), F.col(order).cast("long").alias("o"), F.sha2(F.concat(*[_text(c) for c in [order, *values]]), 256).alias("hash"), F.lit(1).cast("long").alias("n"))
    return _joined(rows, ["grp", "idx"], "o")


def height(*trees: DataFrame, fan: int = FAN) -> int:
    """Levels of ``fan`` blocks until a group has fewer nodes than that, for the largest of ``leaves``."""
    top = max(t.agg(F.max(F.abs("idx"))).first()[0] or 0 for t in trees)
    out = 0
    while top >= fan:
        top, out = top // fan, out + 1
    return out


def _parent(k: int, h: int, fan: int) -> Column:
    """The node above one of level k: over the last level, of fewer than ``fan`` places, is the group's root."""
    return F.lit(0).cast("long") if k == h else F.floor(F.col("idx") / fan)


def levels(blocks: DataFrame, h: int, fan: int = FAN) -> list[DataFrame]:
    """The levels over ``leaves``, these first; the last has a root for each group."""
    out = [blocks]
    for k in range(h + 1):
        out.append(_above(out[-1], k, h, fan))
    return out


def _above(nodes: DataFrame, k: int, h: int, fan: int) -> DataFrame:
    """The level over level k."""
    up = nodes.select("grp", _parent(k, h, fan).alias("up"), F.col("idx").alias("o"), "hash", "n")
    return _joined(up, ["grp", "up"], "o").withColumnRenamed("up", "idx")


def root(groups: DataFrame) -> DataFrame:
    """(hash, n) of the whole table, from the last of ``levels``."""
    d = groups.select(F.substring(F.sha2(_text("grp"), 256), 1, TRIE).alias("p"), F.conv(F.substring(F.sha2(_text("grp"), 256), TRIE + 1, 12), 16, 10).cast("long").alias("o"), "hash", "n")
    for k in range(TRIE, -1, -1):
        d = _joined(d, ["p"], "o")
        if k:
            d = d.select(F.substring("p", 1, k - 1).alias("p"), F.conv(F.substring("p", k, 1), 16, 10).cast("long").alias("o"), "hash", "n")
    return d.select("hash", "n")


def differing_blocks(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """(grp, idx) of the blocks in which two tables of ``leaves`` differ: from the groups' roots down, only what is under a node that differs is looked at."""
    h, spark, at = height(a, b, fan=fan), a.sparkSession, folder(a.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        # both sides of a level take what the level above found, so that a plan which isn't cut here would double with each level
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    trees = []
    for side, x in zip("ab", (a, b), strict=True):
        own = [x]
        for k in range(h + 1):
            own.append(kept(_above(own[-1], k, h, fan), f"{side}{k}"))
        trees.append(own)
    wanted = None
    for k, (x, y) in reversed(list(enumerate(zip(*trees, strict=True)))):
        x, y = (t.select("grp", "idx", F.col("hash").alias(n), _parent(k, h, fan).alias("up")) for t, n in ((x, "ha"), (y, "hb")))
        if wanted is not None:
            x, y = (t.join(wanted, F.col("grp").eqNullSafe(F.col("_g")) & F.col("up").eqNullSafe(F.col("_i")), "left_semi") for t in (x, y))
        met = x.alias("x").join(y.alias("y"), F.col("x.grp").eqNullSafe(F.col("y.grp")) & F.col("x.idx").eqNullSafe(F.col("y.idx")), "full")
        here = F.coalesce("ha", "hb").isNotNull() & ~F.col("ha").eqNullSafe(F.col("hb"))
        wanted = kept(met.where(here).select(F.coalesce("x.grp", "y.grp").alias("_g"), F.coalesce("x.idx", "y.idx").alias("_i")), f"odd{k}")
    return wanted.select(F.col("_g").alias("grp"), F.col("_i").alias("idx"))


def first_differences(a: DataFrame, b: DataFrame, group: str, order: str, values: list[str], span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(grp, o): for each group in which ``a`` and ``b`` differ the least order of a row that one has and the other hasn't, as often."""
    odd = differing_blocks(leaves(a, group, order, values, span).persist(), leaves(b, group, order, values, span).persist(), fan)  # a row for each block
    rows = []
    for df, sign in ((a, 1), (b, -1)):
        own = df.select(F.col(group).cast("string").alias("grp"), F.floor(F.col(order) / span).alias("idx"), F.col(order).cast("long").alias("o"), F.sha2(F.concat(*[_text(c) for c in [order, *values]]), 256).alias("hash"), F.lit(sign).alias("s"))
        w = odd.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"))
        rows.append(own.join(w, F.col("grp").eqNullSafe(F.col("_g")) & F.col("idx").eqNullSafe(F.col("_i")), "left_semi"))
    counts = rows[0].unionByName(rows[1]).groupBy("grp", "o", "hash").agg(F.sum("s").alias("s")).where("s <> 0")
    return counts.groupBy("grp").agg(F.min("o").alias("o"))
