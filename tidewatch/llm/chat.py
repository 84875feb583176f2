"""Chat formatting with DataFrame functions only.

Turns of a conversation are dealt into windows of at most `budget` tokens. Prefix sums of turn tokens give each turn
its window: a window takes the turns whose prefix falls into one stride, so no turn is cut. Every later window
repeats the system turn in force, the last one before it, and as history the last turns of the window before it, up to
`history` tokens; repeated turns carry no loss. A stride is half of what history and the conversation's
longest repeated system turn leave of the budget, so a window's turns, the last of which may reach over its stride's end, fit.

What doesn't fit: a system turn of more than half of what history leaves is shown in its own place only. A turn of
more than a stride stands alone in its window; there the system turn is repeated if it fits beside it, and history shrinks to what is then
left. Only a turn that is longer than the budget by itself makes a longer window, and nothing is repeated there.

Template: `<|kind:role|>text<|end|>`, kind `t` for a turn's own place and `r` for a repeat. In roles and
texts `&` is written `&amp;` and `<` is written `&lt;`, so no text can hold a control string and
reading back is exact.

Defined results: null texts and roles are empty. Turns are ordered by turn (null first), then role,
then text; repeated rows are turns of their own. A conversation is one group, as its digest must be,
but windows are built per window. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, CHARS_PER_TOKEN = 1024, 128, 4


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def tokens(text: Column) -> Column:
    """A turn's tokens, estimated from its length without a tokenizer: one for the mark and one per four characters."""
    return F.lit(1) + F.ceil(F.length(text) / CHARS_PER_TOKEN)


def turn_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per turn and window that shows it: conv_id, win, place, kind (0 system repeat, 1 history, 2 own), role, text."""
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", tokens(F.col("text")))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    system = F.when((F.col("role") == "system") & (F.col("n") <= (budget - history) // 2), F.struct("role", "text", "n"))
    placed = base.withColumn("own_system", system).select(
        "*",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.last("own_system", ignorenulls=True).over(before).alias("system"),
        F.floor((budget - history - F.coalesce(F.max("own_system.n").over(whole), F.lit(0))) / 2).alias("stride"),
    )
    # a long turn has a run of its own (odd), the turns between long ones are in the even runs; strides are counted within a run
    long = F.when(F.col("n") > F.col("stride"), 1).otherwise(0)
    placed = placed.withColumn("run", F.sum(2 * long).over(upto) - long)
    first_in_run = F.min("start").over(Window.partitionBy("conv_id", "run"))
    placed = placed.withColumn("span", F.floor((F.col("start") - first_in_run) / F.col("stride")))
    step = F.when((F.lag("run").over(order) != F.col("run")) | (F.lag("span").over(order) != F.col("span")), 1).otherwise(0)
    placed = placed.withColumn("step", step).withColumn("win", F.sum("step").over(upto))
    in_win, next_win = Window.partitionBy("conv_id", "win"), whole.orderBy("win").rangeBetween(1, 1)
    placed = placed.withColumn("own", F.sum("n").over(in_win)).withColumn("end_of_win", F.max(F.col("start") + F.col("n")).over(in_win))
    # the first turn of a later window brings the system turn
    placed = placed.withColumn("opens", (F.col("step") == 1) & F.coalesce(F.col("own") + F.col("system.n") <= budget, F.lit(False)))
    left = budget - F.max("own").over(next_win) - F.coalesce(F.max(F.when(F.col("opens"), F.col("system.n"))).over(next_win), F.lit(0))
    repeats = (F.col("end_of_win") - F.col("start") <= F.least(F.lit(history), F.col("left"))) & (F.col("role") != "system")
    item = lambda win, kind, role, text: F.struct(win.cast("long").alias("win"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    own = item(F.col("win"), 2, F.col("role"), F.col("text"))
    old = F.when(F.col("left").isNotNull() & repeats, item(F.col("win") + 1, 1, F.col("role"), F.col("text")))
    shown = F.array_compact(F.array(own, old, F.when(F.col("opens"), item(F.col("win"), 0, F.col("system.role"), F.col("system.text")))))
    return placed.withColumn("left", left).select("conv_id", "place", F.explode(shown).alias("s")).select("conv_id", "place", "s.win", "s.kind", "s.role", "s.text")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, win, formatted and mask, the spans (start, length) in characters of formatted that carry loss."""
    shown = turn_windows(turns, budget, history)
    role = F.replace(escape(F.col("role")), F.lit("|"), F.lit("&bar;"))
    head = F.concat(F.lit("<|"), F.when(F.col("kind") == 2, "t").otherwise("r"), F.lit(":"), role, F.lit("|>"))
    piece = F.struct("kind", "place", head.alias("head"), escape(F.col("text")).alias("body"), ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("loss"))
    wins = shown.select("conv_id", "win", piece.alias("piece")).groupBy("conv_id", "win").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    formatted = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>"))))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 7
    start = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return wins.select("conv_id", "win", formatted.alias("formatted"), start["spans"].alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, read from the formatted windows."""
    pieces = F.transform(
        F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p.startswith("<|t:")),
        lambda p: F.concat(
            unescape(F.replace(F.regexp_extract(p, r"(?s)\A<\|t:([^|]*)\|>", 1), F.lit("&bar;"), F.lit("|"))), F.lit("\n"), unescape(F.regexp_extract(p, r"(?s)\A<\|t:[^|]*\|>(.*)\z", 1)), F.lit("\n")
        ),
    )
    lost = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    read = windows.select("conv_id", "win", pieces.alias("turns"), F.concat_ws("", lost).alias("loss"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("win", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.concat_ws("", F.flatten(F.col("w.turns")))
    loss = F.concat_ws("", F.col("w.loss"))
    return whole.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.size(x["turns"])).alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
