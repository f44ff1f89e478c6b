"""Chat formatting with budgeted windows; DataFrame and SQL functions only.

Template: a turn is written `<turn ROLE>TEXT</turn>\\n`.  In ROLE and TEXT the characters
\\ < > become \\b \\l \\g, so no text can hold a mark, and unescaping gives it back exactly.

Windows: turns are ordered by turn (ties by role, then text; nulls first).  A prefix sum of turn
tokens places each turn on a line cut every SLOT tokens; the turns that end in one slot are the new
turns of a window.  A turn of more than SLOT tokens (always the first of its slot) has a window of
its own, so any other window has fewer than 2 * SLOT new tokens.  Each window after the first repeats
the conversation's system turn (its first turn, if that has the role system) where that fits into
BUDGET, and then the turn just before, if that has HISTORY tokens or fewer and still fits.  So a window
has BUDGET tokens or fewer, repeated turns and marks included, or it is one single longer turn, alone.
The loss mask covers the text of assistant turns that are new in the window; repeated ones are
masked out, so each assistant text is learned once.

Tokens are counted by a rule (TOKEN), not by a tokenizer's vocabulary, which no DataFrame function
has: a budget for a certain tokenizer needs room for the difference.

Long conversations: prefix sums are taken in two levels (blocks of BLOCK turn numbers, then
inside a block), so no task holds a whole conversation until its digest is asked for.

Null text or role is empty.  Rows of a null conv_id form one conversation.  Repeated rows are
repeated turns.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, SLOT, HISTORY, BLOCK = 1024, 384, 256, 128
#: Tokens are runs of letters or digits and single other characters; a turn's marks count as MARKS.
TOKEN, MARKS = r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]", 4


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_windows(turns: DataFrame) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss): one row for each window.

    repeated: leading turns that an earlier window had; loss: spans (from, to) of code points.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("long"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"), F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        (F.sum("sum").over(by_block) - F.col("sum")).alias("before"),
        F.lead("head.tokens").over(by_block).alias("after"),
        F.first(F.when(F.col("head.role") == "system", F.struct("head.tokens", "head.text"))).over(by_block).alias("system"),
        (F.row_number().over(by_block) == 1).alias("opens"),
    )
    rows = rows.join(sums, rows.conv_id.eqNullSafe(sums.c) & (rows.block == sums.b)).drop("c", "b")
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ends = F.col("before") + F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", ends).withColumn("next", F.coalesce(F.lead("tokens").over(within), F.col("after")))
    rows = rows.withColumn("nth", F.row_number().over(within))

    def window(end: Column, tokens: Column) -> Column:
        return (2 * F.floor((end - 1) / SLOT) + F.when(tokens > SLOT, 0).otherwise(1)).cast("long")

    rows = rows.withColumn("w", window(F.col("end"), F.col("tokens"))).withColumn("to", window(F.col("end") + F.col("next"), F.col("next")))
    first = F.col("opens") & (F.col("nth") == 1)
    is_system = first & (F.col("role") == "system")
    goes_on = F.col("next").isNotNull() & (F.col("to") != F.col("w")) & (F.col("tokens") <= HISTORY) & ~is_system
    own, again = F.struct(F.col("w").alias("w"), F.lit(False).alias("old")), F.struct(F.col("to").alias("w"), F.lit(True).alias("old"))
    copies = F.when(goes_on, F.array(own, again)).otherwise(F.array(own))
    # the system turn goes along with one row of a window, not with all
    leads = F.coalesce(F.lag("w").over(within) != F.col("w"), F.lit(True))
    rows = rows.withColumn("system", F.when(leads, F.col("system")))
    rows = rows.select("conv_id", "end", "turn", "role", "text", "tokens", "nth", "system", first.alias("first"), F.explode(copies).alias("at"))
    turn = F.struct(F.col("at.old").alias("old"), "end", "nth", "tokens", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    made = rows.groupBy("conv_id", F.col("at.w").alias("window")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.first(F.when(~F.col("at.old"), F.col("system")), True).alias("system"),
        F.max(F.col("first") & ~F.col("at.old")).alias("opening"), F.sum(F.when(F.col("at.old"), 0).otherwise(F.col("tokens"))).alias("spent"),
    )
    keeps = F.col("system").isNotNull() & ~F.col("opening") & (F.col("spent") + F.col("system.tokens") <= BUDGET)
    spent = F.col("spent") + F.when(keeps, F.col("system.tokens")).otherwise(0)
    none = F.array().cast("array<struct<role:string,text:string>>")
    system = F.when(keeps, F.transform(F.array("system"), lambda s: F.struct(F.lit("system").alias("role"), escape(s["text"]).alias("text")))).otherwise(none)
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = made.withColumn("room", BUDGET - spent)
    old = F.filter("turns", lambda t: t["old"] & (t["tokens"] <= F.col("room")))
    new = F.filter("turns", lambda t: ~t["old"])
    made = made.select("conv_id", "window", F.concat(system, plain(old)).alias("old"), plain(new).alias("new"))
    written = lambda t: F.concat(F.lit("<turn "), t["role"], F.lit(">"), t["text"], F.lit("</turn>\n"))
    made = made.select("conv_id", "window", F.size("old").alias("repeated"), F.concat("old", "new").alias("all"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(acc, t):
        body = acc["at"] + F.length(t["role"]) + 7
        span = F.struct(body.alias("from"), (body + F.length(t["text"])).alias("to"))
        learn = (acc["n"] >= F.col("repeated")) & (t["role"] == "assistant")
        return F.struct((acc["at"] + F.length(written(t))).alias("at"), (acc["n"] + 1).alias("n"), F.when(learn, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return made.select("conv_id", "window", F.array_join(F.transform("all", written), "").alias("formatted"), "repeated", F.aggregate("all", start, step)["spans"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars), taken from the formatted strings."""
    parts = F.slice(F.split(F.col("formatted"), "<turn "), 2, F.lit(1 << 30))
    fresh = F.slice(parts, F.col("repeated") + 1, F.lit(1 << 30))
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, ">", 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, "</turn>", 1), ">", -1)).alias("text")
    )
    rows = windows.select(
        "conv_id", "window", F.transform(fresh, turn).alias("new"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["from"] + 1, s["to"] - s["from"]))), "").alias("lost"),
        F.length("formatted").cast("long").alias("chars"),
    )
    rows = rows.select("conv_id", "window", F.size("new").alias("n"), F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "lost", "chars")
    whole = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "lost"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    join = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select("conv_id", "n_turns", join("said").alias("turns"), join("lost").alias("loss_text"), "formatted_chars")
