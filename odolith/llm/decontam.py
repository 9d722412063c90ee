"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five of them (all of them, if there are fewer), repeats
included. A document is contaminated by an item if some window of the item's size reaches a weighted Jaccard similarity
of ``SIMILARITY`` with it: the sum of the smaller counts of each shingle over the sum of the larger.

1. Pairs. A window that reaches the similarity holds at least q of the item's shingles, q following from the similarity. So it holds one of
   the item's few rarest, those that are left without any q - 1 of the others; rare is what few items have. Documents and items that share one of these are found by an
   equi-join on hashes; all other documents are done here. What many items have in common, such as a preamble, is none of these and brings no pairs.
2. Windows. A window loses none of its shared shingles when it is moved right to the first. So in a pair the windows that begin at a shared
   shingle and whose q-th shared shingle lies within the window (and the last window of the text) are all that can count.
3. Fingerprints. SimHash over the window's shingle hashes. The 64 bits are cut into ``RADIUS`` + 1 blocks, and the distinct fingerprints of an item's windows
   meet the item's own where they agree on a block, which guarantees all within the radius; each counts at the first block it agrees on.
4. Verification of the windows that the blocks select, by exact shingle counts.
5. An extra pass, unless ``exact`` is off, so that the result is whole: the windows of step 2 that the blocks didn't select (at a similarity of 0.8 one in some
   thousand of those that reach it where shingles are distinct, and up to half where one shingle has much of the weight), but for pairs of document and item that step 4
   has settled at a similarity of 1.

The benchmark's rare shingles are broadcast while there are at most ``SMALL`` of them, items while their shingles together are, and keys of candidate
documents likewise, each a long or two; beyond that they are shuffled. No group is gathered: an array holds one text's or one item's shingles.

Null and empty texts, and items without words, match nothing. Rows that share doc_id and text are one document; rows that only share
doc_id are looked at apart and give the doc_id's best window. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 20
SMALL = 1_000_000


def _words(text) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the shingles of a column of words, in order."""
    n = F.size(words)
    several = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, several).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is 1 if it is set in over half of the hashes.

    Up to 127 hashes are counted eight bits at a time: lane i of the k-th sum has the count of bit 8 i + k.
    """
    lanes = F.lit(0x0101010101010101)
    right = lambda x, k: F.call_function("shiftrightunsigned", x, F.lit(k))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in range(8)])
    sums = F.aggregate(hashes, zero, lambda acc, h: F.struct(*[(acc[f"s{k}"] + right(h, k).bitwiseAND(lanes)).alias(f"s{k}") for k in range(8)]))

    def lanes_to_bits(s):
        out = F.lit(0).cast("long")
        for i in range(8):
            for k in range(8):
                out = out.bitwiseOR(F.when(2 * right(s[f"s{k}"], 8 * i).bitwiseAND(F.lit(255).cast("long")) > F.size(hashes), F.lit((1 << (8 * i + k)) - (1 << 64 if 8 * i + k == 63 else 0))).otherwise(F.lit(0).cast("long")))
        return out

    def bit(acc, k):
        ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(1).cast("long")))
        return F.when(2 * ones > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(acc)

    few = F.get(F.transform(F.array(sums), lanes_to_bits), F.lit(0))  # the sums once, for all bits
    return F.when(F.size(hashes) <= 127, few).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit))


def _blocks() -> list[tuple[int, int]]:
    """(shift, mask) of each block."""
    edge = [round(i * 64 / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edge, edge[1:], strict=False)]


def _block_values(fp: str) -> Column:
    return F.array(*[F.shiftrightunsigned(F.col(fp), s).bitwiseAND(F.lit(m)).cast("int") for s, m in _blocks()])


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("th"), text.alias("text")).where(F.col("text").isNotNull())


def _need(m: str, n: str) -> str:
    """SQL: how many shingles an m-shingle item and the windows of an n-shingle text must share."""
    return f"cast(ceil({SIMILARITY / (1 + SIMILARITY)!r} * (least({m}, {n}) + {m}) - 1e-9) as int)"


def _rare(items: DataFrame) -> DataFrame:
    """(item_id, h): of each item its shingles that the fewest items have, as many as a window that reaches the similarity can't be without."""
    each = items.select("item_id", "m", F.explode("item").alias("h"))
    spread = each.groupBy("h").agg(F.countDistinct("item_id").alias("n"))
    ranked = each.join(spread, "h").withColumn("i", F.row_number().over(W.partitionBy("item_id").orderBy("n", "h")))  # an item's shingles, ties by hash, so repeats are neighbours
    return ranked.where(f"i <= m - cast(ceil({SIMILARITY!r} * m - 1e-9) as int) + 1").select("item_id", "h").distinct()


def windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All windows that can reach the similarity, (doc_id, th, item_id, n_words, m, item, ifp, start, win, fp), and the items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    items = cut(items.select("item_id", F.size("w").alias("n_words"), _shingles(F.col("w")).alias("item")).withColumn("m", F.size("item")).withColumn("ifp", _fingerprint(F.col("item"))), "items")
    # rows that share an item_id are items of their own: they are told apart by their shingles' hash
    items = items.withColumn("of", F.xxhash64("item")).dropDuplicates(["item_id", "of"])
    rare = cut(_rare(items.select(F.struct("item_id", "of").alias("item_id"), "m", "item")), "rare")
    n_shingles = items.agg(F.sum("m")).first()[0] or 0

    keyed = _keyed(docs)
    placed = keyed.withColumn("w", _words(F.col("text"))).select("doc_id", "th", _shingles(F.col("w")).alias("s"))
    # outer generators: others make the optimizer repeat what builds the array in a filter below it
    hits = placed.select("doc_id", "th", F.explode_outer("s").alias("h")).join(_sized(rare, rare.count()), "h")
    pairs = cut(hits.select("doc_id", "th", "item_id.*").distinct(), "pairs")
    texts = pairs.select("doc_id", "th").distinct()
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.th == b.th)
    with_text = keyed.join(_sized(texts, texts.count()), same(keyed, texts), "left_semi").dropDuplicates(["doc_id", "th"])
    whole = cut(with_text.withColumn("w", _words(F.col("text"))).select("doc_id", "th", _shingles(F.col("w")).alias("s")), "shingles")
    both = pairs.join(whole, same(pairs, whole)).select(pairs.doc_id, pairs.th, "item_id", "of", "s").join(_sized(items, n_shingles), ["item_id", "of"])
    at = F.filter(F.transform("s", lambda x, i: F.when(F.array_contains("item", x), i)), lambda i: i.isNotNull())
    spots = both.withColumn("n", F.size("s")).withColumn("at", at).withColumn("q", F.expr(_need("m", "n"))).where("size(at) >= q")
    last = F.expr("if(get(at, size(at) - q) >= greatest(n - m, 0), array(greatest(n - m, 0)), cast(array() as array<int>))")
    full = F.expr("filter(transform(at, (x, i) -> if(get(at, i + q - 1) < x + m and x <= n - m, x, null)), x -> x is not null)")
    starts = spots.withColumn("start", F.explode_outer(F.array_union(full, last))).where("start is not null")
    cut_out = starts.select("doc_id", "th", "item_id", "of", "n_words", "m", "item", "ifp", "start", F.slice("s", F.col("start") + 1, F.col("m")).alias("win"))
    return cut(cut_out.withColumn("fp", _fingerprint(F.col("win"))), "printed"), items


def near(printed: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, of, fp): the distinct fingerprints of items' windows within the radius of the item's, by blocks."""
    left = printed.select("item_id", "of", "fp").distinct().select("*", F.posexplode(_block_values("fp")).alias("block", "value"))
    right = items.select("item_id", "of", "ifp", F.posexplode(_block_values("ifp")).alias("block", "value"))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    earlier = F.lit(False)
    for k, (s, mask) in enumerate(_blocks()):
        earlier = earlier | ((F.col("block") > k) & (F.shiftrightunsigned(differ, s).bitwiseAND(F.lit(mask)) == 0))
    met = left.join(_sized(right, items.count() * (RADIUS + 1)), ["item_id", "of", "block", "value"])
    return met.where((F.bit_count(differ) <= RADIUS) & ~earlier).select("item_id", "of", "fp")


def _verified(candidates: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, of, n_words, start, hamming, similarity) of the windows that reach the similarity."""
    shared = F.aggregate(F.array_distinct("item"), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter("item", lambda y: y == x)), F.size(F.filter("win", lambda y: y == x))))
    found = candidates.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))).withColumn("shared", shared)
    found = found.withColumn("similarity", F.col("shared") / (F.size("win") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= SIMILARITY - 1e-12)
    return found.select("doc_id", "th", "item_id", "of", "n_words", "start", "hamming", "similarity")


def matches(docs: DataFrame, benchmark: DataFrame, exact: bool = True) -> DataFrame:
    """(doc_id, th, item_id, start, n_words, hamming, similarity): the best window of each contaminated document and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; start counts words, th is the text's hash. The blocks select the
    windows; with ``exact``, a second pass verifies those they left, of pairs that a window within the radius didn't already equal.
    """
    printed, items = windows(docs, benchmark)
    close = cut(near(printed, items).withColumn("near", F.lit(True)), "near")
    marked = printed.join(_sized(close, close.count()), ["item_id", "of", "fp"], "left")
    found = cut(_verified(marked.where("near")), "selected")
    if exact:
        settled = found.where("similarity = 1").select(*[F.col(c).alias(f"{c}_") for c in ("doc_id", "th", "item_id", "of")]).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("th") == F.col("th_")) & (F.col("item_id") == F.col("item_id_")) & (F.col("of") == F.col("of_"))
        left = marked.where("near is null").join(_sized(settled, settled.count()), same, "left_anti")
        found = found.unionByName(_verified(left))
    best = found.groupBy("doc_id", "th", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("apart"))).alias("b"))
    return best.select("doc_id", "th", "item_id", (-F.col("b.back")).alias("start"), "n_words", (-F.col("b.apart")).alias("hamming"), "b.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity), one row per contaminated doc_id and item."""
    m = matches(docs, benchmark)
    return m.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("apart"))).alias("b")).select("doc_id", "item_id", (-F.col("b.back")).cast("int").alias("start"), "n_words", (-F.col("b.apart")).cast("int").alias("hamming"), "b.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates."""
    bad = cut(matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "bad")
    here = F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0).cast("long"))
    return docs.join(_sized(bad, bad.count()), docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (here == bad["_th"]), "left_anti")
