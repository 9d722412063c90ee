"""Preference formatting of chosen and rejected conversations.

The turns at the start on which both sides of a pair agree, in role and text, are its prompt and rendered once; what follows on
either side is that side's completion. Loss counts on what a completion's assistant turns say and on their end marks. All but the
last step is equi-joins and aggregates by pair and turn: no conversation, however long, is gathered. The agreed prefix ends before the
first turn number at which the sides differ as sets of (role, text) with counts, so turns that repeat or tie need no order.

``records`` makes one training record of a pair: its prompt, and the two completions with their masks. Pairs of many turns or bytes
come as several records, one for each range of turn numbers, so that what is gathered is bounded but for rows that share a turn number.

A pair with one side is all completion, one whose sides agree throughout has two empty ones. Null texts and roles count as empty and equal
each other. Rows without pair, side or turn have no place in a pair: ``format_pairs`` gives them the segment 'unplaced' and no loss,
``records`` leaves them out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "\n<|end|>\n"
#: turn numbers of a record, and the rows and characters beyond which a record is split further
TURNS, ROWS, CHARS = 1024, 4096, 32 << 20


def sample_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, side, turn, role, text) from a table that has single conversations only.

    A conversation is the chosen side of the pair of its name. Its rejected side has its turns up to its last answer, and there the last answer
    of the next conversation. Each tenth pair's rejected side ends before that answer, as does one without a next answer; each tenth, and each
    without an answer, has two equal sides.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = c.where("role = 'assistant' and turn is not null and pair_id is not null").groupBy("pair_id").agg(F.max("turn").alias("last"))
    both = c.join(last, "pair_id", "left")
    kept = both.where("last is null or turn < last or pair_id % 10 = 5").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    answer = both.where("turn = last and role = 'assistant'").groupBy("pair_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    swapped = answer.select((F.col("pair_id") - 1).alias("pair_id"), "text").where("pair_id % 10 not in (0, 5)").join(last, "pair_id")
    swapped = swapped.select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), "text")
    return c.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(kept).unionByName(swapped)


def _segments(turns: DataFrame, rows: int, chars: int) -> tuple[DataFrame, Column]:
    """Placed turns with their segment and ``width``, the turn numbers of a record, without the rejected side's prompt; and which of ``turns`` are placed.

    What decides is one thin row for a turn and one for a pair; texts move once, to these.
    """
    placed = F.coalesce(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected") & F.col("turn").isNotNull(), F.lit(False))
    here = turns.where(placed)
    thin = here.select("pair_id", "side", "turn", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"), F.length("text").alias("size"))
    cells = thin.groupBy("pair_id", "turn", "digest").agg(F.count_if(F.col("side") == "chosen").alias("c"), F.count_if(F.col("side") == "rejected").alias("j"), F.sum("size").alias("size"))
    pairs = cells.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("j"), F.col("turn"))).alias("first"), F.sum(F.col("c") + F.col("j")).alias("n"), F.sum("size").alias("size"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    width = F.greatest(F.lit(1), F.least(F.lit(TURNS), F.floor(F.col("span") * rows / F.col("n")), F.floor(F.col("span") * chars / F.greatest("size", F.lit(1)))))
    pairs = pairs.select("pair_id", "first", width.alias("width"))
    agreed = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    both = here.join(pairs, "pair_id").where(~agreed | (F.col("side") == "chosen"))
    return both.select("pair_id", F.when(agreed, "prompt").otherwise(F.col("side")).alias("segment"), "turn", "role", "text", "width"), placed


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("pair_id", "side", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def _head() -> Column:
    return F.concat(F.lit(START), F.col("role"), F.lit(MIDDLE))


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, segment, turn, role, rendered, loss) for every turn of ``turns`` (pair_id, side, turn, role, text).

    ``side`` is 'chosen' or 'rejected'; segment is 'prompt', which the rejected side doesn't repeat, 'chosen' or 'rejected'.
    """
    t = _turns(turns)
    kept, placed = _segments(t, ROWS, CHARS)
    every = kept.drop("width").unionByName(t.where(~placed).select("pair_id", F.lit("unplaced").alias("segment"), "turn", "role", "text"))
    loss = (F.col("segment").isin("chosen", "rejected") & (F.col("role") == "assistant")).cast("int")
    return every.select("pair_id", "segment", "turn", "role", F.concat(_head(), "text", F.lit(END)).alias("rendered"), loss.alias("loss"))


def records(turns: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """(pair_id, from_turn, prompt, chosen, chosen_mask, rejected, rejected_mask): a record for each pair, or for each range of its turns.

    A mask is the runs of a completion's characters, 'loss:length' joined by commas, with loss 1 on what assistants say.
    """
    kept, _ = _segments(_turns(turns), rows, chars)
    dealt = kept.withColumn("from_turn", F.floor(F.col("turn") / F.col("width")) * F.col("width"))
    speaks = (F.col("role") == "assistant") & (F.col("segment") != "prompt")
    n_head, n_rest = F.length(_head()), F.length("text") + len(END)
    mask = F.when(speaks, F.concat(F.lit("0:"), n_head, F.lit(",1:"), n_rest)).otherwise(F.concat(F.lit("0:"), n_head + n_rest))
    piece = F.struct("turn", "role", "text", mask.alias("mask"))
    lists = dealt.groupBy("pair_id", "from_turn").agg(*[F.array_sort(F.collect_list(F.when(F.col("segment") == s, piece))).alias(s) for s in ("prompt", "chosen", "rejected")])
    joined = lambda s: F.concat_ws("", F.transform(s, lambda x: F.concat(F.lit(START), x["role"], F.lit(MIDDLE), x["text"], F.lit(END))))
    masks = lambda s: F.concat_ws(",", F.transform(s, lambda x: x["mask"])).alias(f"{s}_mask")
    return lists.select("pair_id", "from_turn", joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), masks("chosen"), joined("rejected").alias("rejected"), masks("rejected"))
