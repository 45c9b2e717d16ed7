"""Preference formatting: one prompt for a chosen and a rejected conversation, and a masked completion of each.

Texts stay where they are until the end. What is numbered, compared and cut is a key for each turn: the digest of its text and its
length. The keys of a pair meet in one partition, which numbers the turns of both sides, finds their longest common prefix and
cuts them; pairs of very many turns are numbered over sorted ranges instead. Each different text is then joined to its places once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import broadcast_if_small, row_numbers, running_totals, stored

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"
LARGE = 4096  # turns of a pair that one task numbers; more are numbered over ranges
_HOT, _SALTS = 1024, 64
_ORDER = ["turn", "role", "head", "text_key"]


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), F.coalesce(text, F.lit("")), F.lit(END))


def text_key(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256; null for a null text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def turn_keys(turns: DataFrame) -> DataFrame:
    """``pair, side, turn, role, text`` without the texts: their digest, length and first 32 characters."""
    pair_key = F.coalesce(F.concat(F.lit("id"), F.col("pair").cast("string")), F.lit("null")).alias("pair_key")
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size")
    return turns.select("pair", pair_key, "side", "turn", "role", text_key(F.col("text")).alias("text_key"), F.substring("text", 1, 32).alias("head"), size)


def _rendered_size() -> Column:
    return F.char_length(header(F.col("role"))).cast("long") + F.col("size") + len(END)


def _numbered(keys: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """Keys with ``position`` and ``before``, the characters of the earlier turns of their side: those of small and of large pairs."""
    counts = keys.groupBy("pair_key").agg(F.count("*").alias("n")).where(F.col("n") > large)
    long = stored(counts.select("pair_key"))
    known = long.isEmpty()
    small = keys if known else keys.join(broadcast_if_small(long, 48), "pair_key", "left_anti")
    side = Window.partitionBy("pair_key", "side").orderBy(*_ORDER)
    before = F.coalesce(F.sum(_rendered_size()).over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The partitions by pair serve the windows, the comparison and the cut.
    numbered = small.repartition("pair_key").withColumns({"position": (F.row_number().over(side) - 1).cast("long"), "before": before}).drop("head")
    if known:
        return numbered, None
    held = keys.join(broadcast_if_small(long, 48), "pair_key", "left_semi").withColumn("side_key", F.concat_ws(":", "side", "pair_key"))
    totals = running_totals(held, "side_key", _ORDER, position=F.lit(1).cast("long"), before=_rendered_size())
    return numbered, stored(totals.select(*numbered.columns))


def _cut(numbered: DataFrame) -> DataFrame:
    """Turns of the prompt once, the others by side, with ``start`` in their part."""
    same = F.struct("role", "text_key")
    compared = numbered.groupBy("pair_key", "position").agg(
        ((F.count_if(F.col("side") == "chosen") > 0) & (F.count_if(F.col("side") == "rejected") > 0)).alias("both"),
        (F.min(same).eqNullSafe(F.max(same))).alias("same"),
        F.max(F.when(F.col("side") == "chosen", _rendered_size())).alias("length"),
    )
    alike = F.col("both") & F.col("same")
    cuts = compared.groupBy("pair_key").agg(
        F.coalesce(F.min(F.when(~alike, F.col("position"))), F.max("position") + 1).alias("prefix"),
    )
    lengths = compared.join(cuts, "pair_key").groupBy("pair_key").agg(
        F.max("prefix").alias("prefix"), F.coalesce(F.sum(F.when(F.col("position") < F.col("prefix"), F.col("length"))), F.lit(0)).alias("prompt_length")
    )
    in_prompt = F.col("position") < F.col("prefix")
    placed = numbered.join(lengths, "pair_key").where(~in_prompt | (F.col("side") == "chosen"))
    return placed.select(
        "pair",
        F.when(in_prompt, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        "position",
        "role",
        "text_key",
        (F.col("before") - F.when(in_prompt, 0).otherwise(F.col("prompt_length"))).alias("start"),
    )


def _with_texts(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``placed`` joined with ``text_key, text``, of which each text moves once.

    Keys of over 1/1024 of the rows, 1,024 at most, are dealt over 64 copies of their text, so a common turn is no hot key.
    """
    counts = stored(placed.groupBy("text_key").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("text_key").isNotNull() & (F.col("n") > _SALTS) & (F.col("n") * _HOT > total)).select("text_key", F.lit(True).alias("hot"))

    def marked(frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(hot), "text_key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("pair", "part", "position"), F.lit(_SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = marked(texts.where("text_key is not null")).select("text_key", F.explode(salts).alias("salt"), "text")
    once = copies.groupBy("text_key", "salt").agg(F.first("text").alias("text"))
    return marked(placed).withColumn("salt", salt).join(once, ["text_key", "salt"], "left")


def format_keys(keys: DataFrame, texts: DataFrame, large: int = LARGE) -> DataFrame:
    """:func:`format_preferences` of turn keys (:func:`turn_keys`) and the texts they name, ``text_key, text``, repeated or not."""
    small, long = _numbered(keys, large)
    placed = _cut(small) if long is None else _cut(small).unionByName(_cut(long))
    whole = _with_texts(placed, texts).withColumn("rendered", rendered(F.col("role"), F.col("text")))
    learnt = (F.col("part") != "prompt") & (F.coalesce("role", F.lit("")) == LEARNT)
    head = F.char_length(header(F.col("role"))).cast("long")
    return whole.select(
        "pair", "part", "position", "role", "start", "rendered",
        F.when(learnt, head).otherwise(0).alias("loss_start"),
        F.when(learnt, F.char_length("rendered").cast("long") - head).otherwise(0).alias("loss_length"),
    )


def format_preferences(turns: DataFrame, large: int = LARGE) -> DataFrame:
    """``pair, side, turn, role, text`` becomes one row for each rendered turn; other columns are not read.

    ``side`` is ``chosen`` or ``rejected``; turns stand in the order of ``turn``, ties in that of role, of the text's first 32 characters and of its
    digest, and nulls first. The longest common prefix of both sides' turns (role and text alike) is rendered once, as ``part`` ``prompt``,
    the rest of each side as ``chosen`` and ``rejected``. ``position`` counts the turns of a conversation, ``start`` is where
    ``rendered`` begins in its part, in characters. The loss mask covers ``loss_length`` characters from ``loss_start`` in
    ``rendered``: the text and end mark of assistant turns of a completion, nothing of a prompt or of other roles.

    Pairs of equal conversations have a prompt and no completions; a pair with one side has no prompt. A null pair is
    a pair of its own; repeated rows are turns of their own; an empty table gives no rows. Pairs of over ``large`` turns are numbered over sorted
    ranges, compared by position, and joined with one number for each pair, so none is gathered in one task.
    """
    return format_keys(turn_keys(turns), turns.select(text_key(F.col("text")).alias("text_key"), "text"), large)


def branched_keys(conversations: DataFrame) -> DataFrame:
    """The keys of a pair for each conversation: itself as chosen; as rejected its turns before a branch, and the next one's turns from there.

    The branch is a turn number between 0 and one beyond the conversation's last, by a hash of its id, so that sides part early, late or not at all and have
    unlike lengths. One conversation in eight, by the same hash, has no rejected side. The next conversation is the one with the next id, the last takes the
    first one's turns; a null turn counts as -1. Repeated rows stay; an empty table gives no rows.
    """
    keys = turn_keys(conversations.select(F.col("conv_id").alias("pair"), F.lit("chosen").alias("side"), "turn", "role", "text"))
    turn = F.coalesce("turn", F.lit(-1)).cast("long")
    last = keys.groupBy("pair").agg(F.max(turn).alias("last"))
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("pair").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    branch = F.when(digest % 8 > 0, F.floor(digest / 8) % (F.col("last") + 2))
    ranked = stored(row_numbers(last.select("pair", branch.alias("branch")), "pair"))
    rows = max(1, ranked.count())
    earlier = ranked.select(F.pmod(F.col("number") + 1, F.lit(rows)).alias("number"), F.col("pair").alias("earlier"), F.col("branch").alias("earlier_branch"))
    plan = ranked.join(earlier, "number").select(F.col("pair").alias("of"), "branch", "earlier", "earlier_branch")
    planned = keys.join(broadcast_if_small(stored(plan), 48), keys.pair.eqNullSafe(F.col("of")))
    # A turn is chosen once, and rejected in its own pair before the branch and in the earlier pair from that one's branch on.
    own = F.struct(F.col("pair"), F.lit("chosen").alias("side"))
    before = F.when(turn < F.col("branch"), F.struct(F.col("pair"), F.lit("rejected").alias("side")))
    after = F.when(turn >= F.col("earlier_branch"), F.struct(F.col("earlier").alias("pair"), F.lit("rejected").alias("side")))
    uses = F.explode(F.filter(F.array(own, before, after), lambda use: use.isNotNull())).alias("use")
    used = planned.select(uses, "turn", "role", "text_key", "head", "size").select("use.pair", "use.side", "turn", "role", "text_key", "head", "size")
    return used.withColumn("pair_key", F.coalesce(F.concat(F.lit("id"), F.col("pair").cast("string")), F.lit("null")))
