"""Preference formatting: a shared prompt and a pair of masked completions.

Both conversations of a pair meet in one aggregation by pair id.  The longest
common prefix of turns (role and text equal) is rendered once as the prompt;
the rest of each conversation is its completion, with the character ranges
that train (text and end mark of assistant turns) as its mask.  Only built-in
functions run.

A conversation is one training example, so its turns are held in one row;
nothing else is gathered.  Rows without pair id or turn number have no place
in a conversation and are left out; exact repeats of a turn count once, other
ties on the turn number are ordered by role and text.  A null role is
``unknown``, a null text is empty.  Texts can't forge marks: ``<|`` becomes
``< |``.  A pair of which one side is missing is left out.  Conversations that
are equal, or of which one ends where the other goes on, have an empty
completion; ``usable`` tells that both completions train something.  An empty
table gives no pairs.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

END = "<|end|>\n"
_TURN = f"concat('<|', x.role, '|>\\n', x.text, '{END}')".replace("\n", "\\n")


def _mask(turns: str) -> str:
    """Trained ranges of the rendered ``turns``: arrays of (start, end)."""
    return f"""filter(transform({turns}, (x, i) -> named_struct('role', x.role,
        'start', aggregate(slice({turns}, 1, i), 0L, (n, x) -> n + length({_TURN})) + length(x.role) + 5,
        'end', aggregate(slice({turns}, 1, i + 1), 0L, (n, x) -> n + length({_TURN})) - 1)), x -> x.role = 'assistant')"""


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """Pairs from two turn tables (``pair_id``, ``turn``, ``role``, ``text``).

    Returns pair_id, n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask (arrays of start and end in the completion) and usable.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        clean = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
        role = F.replace(F.coalesce(F.col("role"), F.lit("unknown")), F.lit("<|"), F.lit("< |"))
        return df.where(F.col(pair_id).isNotNull() & F.col("turn").isNotNull()).select(
            F.col(pair_id).alias("pair_id"), F.struct("turn", role.alias("role"), clean.alias("text")).alias("t"), F.lit(name).alias("side"))

    def turns(name: str) -> Column:
        return F.transform(F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t"))))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))

    d = side(chosen, "chosen").unionByName(side(rejected, "rejected")).groupBy("pair_id").agg(turns("chosen").alias("c"), turns("rejected").alias("r"))
    d = d.where((F.size("c") > 0) & (F.size("r") > 0))
    d = d.withColumn("differs", F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False))
    d = d.withColumn("n_common", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.size("c")).cast("int"))
    d = d.withColumns({"p": F.expr("slice(c, 1, n_common)"), "c": F.expr("slice(c, n_common + 1, size(c))"), "r": F.expr("slice(r, n_common + 1, size(r))")})
    d = d.withColumns({"chosen_mask": F.expr(_mask("c")), "rejected_mask": F.expr(_mask("r"))})
    ranges = lambda m: F.transform(m, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    text = lambda a: F.expr(f"array_join(transform({a}, x -> {_TURN}), '')")
    return d.select(
        F.col("pair_id").alias(pair_id), F.col("n_common").cast("long").alias("n_common"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
        ranges("chosen_mask").alias("chosen_mask"), ranges("rejected_mask").alias("rejected_mask"),
        ((F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)).alias("usable"))


def next_ids(ids: DataFrame, column: str) -> DataFrame:
    """(``column``, next_id) of distinct ids: the next greater one, the least for the greatest.

    Ids are sorted by range; only each part's first id passes to the part before.
    """
    ring = staged(ids.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ring")
    firsts = ring.groupBy("part").agg(F.min(column).alias("first"))
    every = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(every), F.min("first").over(every)).alias("after"))
    ring = ring.withColumn("inside", F.lead(column).over(Window.partitionBy("part").orderBy(column)))
    return ring.join(firsts, "part").select(column, F.coalesce("inside", "after").alias("next_id"))


def neighbour_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations (conv_id, turn, role, text).

    Chosen is the conversation up to its last assistant turn.  Rejected has the
    same turns, but from one assistant turn on, the one numbered ``conv_id``
    modulo their number, each assistant turn's text is the last one of the next
    conversation, by id, that has an assistant turn (the first follows the
    last).  Every conversation with an assistant turn gives a pair; a single
    one is paired with itself.  A null text is empty; of
    several last texts with one turn number the greatest counts.
    """
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = staged(turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"), F.array_sort(F.collect_set("turn")).alias("at")), "last-turns")
    own = own.withColumn("split", F.expr("element_at(at, CAST(pmod(conv_id, size(at)) AS INT) + 1)"))
    other = next_ids(own.select("conv_id"), "conv_id").join(own.select(F.col("conv_id").alias("next_id"), F.col("last.text").alias("other")), "next_id")
    both = turns.join(own.select("conv_id", "split", F.col("last.turn").alias("end")).join(other, "conv_id"), "conv_id").where(F.col("turn") <= F.col("end"))
    swapped = (F.col("turn") >= F.col("split")) & (F.col("role") == "assistant")
    return (both.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"),
            both.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(swapped, F.col("other")).otherwise(F.col("text")).alias("text")))
