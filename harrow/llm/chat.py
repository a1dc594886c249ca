"""Chat formatting with budgeted windows.

Each turn is written as ``### role`` newline text ``</turn>`` newline. Inside
texts the characters that control strings need are replaced by two-character
escapes, so a control string can only come from the template and reading back is
plain splitting. Prefix sums of the turns' tokens choose turn-aligned spans: a
window takes new turns while they fit the budget beside the system turn and a
limited history of the turns just before; system and history turns are repeated
for context and masked, so every assistant text is a target exactly once.

Everything is built-in column functions. A conversation is the unit of output:
its turns meet in one row.

Defined results: null text or role: empty; turns are ordered by turn (nulls
first), ties by role, then text; repeated rows stay; a null conversation id is a
conversation; a turn over the budget has a window of its own and is never cut;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens (words and 4 for the template) in a window, and of repeated history.
BUDGET, HISTORY, PER_TURN = 512, 96, 4
TURN, END = "### ", "</turn>\n"


def escape(c: Column) -> Column:
    r"""Backslash to \b, < to \l, # to \h: no control string is left, and every backslash begins an escape."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, turn, role, text) to one row per window: conv_id, window, n_repeated, formatted, loss.

    ``loss`` holds (start, length) in code points of ``formatted``: the escaped
    assistant texts among the window's new turns. ``n_repeated`` turns at the
    front are repeats.
    """
    row = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("cost", F.size(F.filter(F.split("text", "[\\x00-\\x20]+"), lambda w: w != "")) + F.lit(PER_TURN))
    # prefix sums while the turns pass in order; turns that are equal in all columns cost the same, so their order does not matter
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = row.withColumn("end", F.sum("cost").over(so_far))
    conversation = row.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "cost", "end"))).alias("turns"))
    first = F.element_at("turns", 1)
    conversation = conversation.withColumn("lead", F.when(first["role"] == "system", 1).otherwise(0)).withColumn(
        "lead_cost", F.when(F.col("lead") == 1, first["cost"]).otherwise(0)
    )
    # ends[i]: tokens of turns 0 .. i-1
    conversation = conversation.withColumn("ends", F.concat(F.array(F.lit(0).cast("long")), F.col("turns.end")))
    most = max(0, history) // PER_TURN  # every turn costs PER_TURN or more, so no history has more turns

    def repeats(start: Column) -> Column:
        """First turn of the history before ``start``: whole turns within the limit, never the system turn."""
        earlier = F.filter(F.sequence(F.greatest(F.col("lead"), start - most), start), lambda j: (F.get("ends", start) - F.get("ends", j)) <= history)
        return F.array_min(earlier)

    def next_start(starts: Column, i: Column) -> Column:
        """Turn i opens a window if it would go over the budget in the window that the last start opened."""
        start = F.element_at(starts, -1)
        front = F.when(start <= F.col("lead"), 0).otherwise(F.col("lead_cost") + F.get("ends", start) - F.get("ends", repeats(start)))
        used = front + F.get("ends", i + 1) - F.get("ends", start)
        return F.when((i > F.col("lead")) & (used > budget), F.concat(starts, F.array(i))).otherwise(starts)

    conversation = conversation.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), F.array(F.lit(0)), next_start))
    windows = conversation.select(
        "conv_id", "turns", "lead", "starts", F.posexplode(F.transform("starts", lambda s: F.struct(s.alias("start"), repeats(F.greatest(s, F.col("lead"))).alias("from")))).alias("window", "w"), "ends"
    )
    end = F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns"))
    lead = F.when(F.col("window") == 0, 0).otherwise(F.col("lead"))
    behind = F.when(F.col("window") == 0, 0).otherwise(F.col("w.start") - F.col("w.from"))
    old = F.concat(F.slice("turns", F.lit(1), lead), F.slice("turns", F.col("w.from") + 1, behind))
    windows = windows.select("conv_id", "window", old.alias("old"), F.slice("turns", F.col("w.start") + 1, end - F.col("w.start")).alias("new"))
    windows = windows.withColumn("n_repeated", F.size("old")).withColumn("shown", F.concat("old", "new"))
    heads = F.transform("shown", lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n")))
    bodies = F.transform("shown", lambda t: escape(t["text"]))
    windows = windows.select("conv_id", "window", "n_repeated", F.transform("shown", lambda t: t["role"]).alias("roles"), heads.alias("heads"), bodies.alias("bodies"))
    pieces = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    lengths = F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.length(x["heads"]) + F.length(x["bodies"]) + F.lit(len(END)))
    windows = windows.withColumn(
        "offsets", F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    )
    targets = F.filter(F.sequence(F.lit(0), F.size("roles") - 1), lambda i: (i >= F.col("n_repeated")) & (F.get("roles", i) == "assistant"))
    loss = F.transform(targets, lambda i: F.struct((F.get("offsets", i) + F.length(F.get("heads", i))).alias("start"), F.length(F.get("bodies", i)).alias("length")))
    return windows.select("conv_id", "window", "n_repeated", F.array_join(pieces, "").alias("formatted"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Read windows back: conv_id, window, turns (role, text of the new turns), targets (unescaped text under the mask)."""
    pieces = F.filter(F.split("formatted", "</turn>\\n"), lambda p: p != "")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescape_role(F.substr(F.substring_index(p, "\n", 1), F.lit(len(TURN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
