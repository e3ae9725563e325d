"""Chat formatting in budgeted, turn-aligned windows.

Template of a turn: ``<s>[INST]`` role ``[/INST]`` text ``</s>``; a turn that is
repeated as context starts with ``<s>[CTX]`` instead. Control strings inside
roles and texts are escaped reversibly: ``&`` becomes ``&amp;``, and the first
character of a control string becomes ``&lt;`` or ``&#91;``.

* Prefix sums of turn tokens place each turn: with ``room`` tokens for new turns
  a turn that starts and ends in slot ``k`` of the sum belongs to window ``k``;
  the one turn that crosses the slot's end gets a window of its own. So a window
  holds at most ``room`` tokens of new turns, or a single longer turn.
* Every window starts with the conversation's first system turn and then repeats
  the last ``history_turns`` turns of the window before it, as far as they fit
  into ``history`` tokens. Repeated turns are never under the loss mask.
* ``loss`` lists code point ranges [start, stop) of the window's text, one per
  new assistant turn: the escaped text without its markers.

Prefix sums are taken over ranges of turn numbers and then within a range, so a
conversation with very many turns is spread over tasks. No step but the reader's
digest gathers a conversation.

Edge cases: null roles and texts count as empty; null turns come first; ties are
ordered by role, then text; a null conv_id is a conversation of its own; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS, MARKERS = 1024, 256, 2, 6
TURN_RANGE = 64
TOKEN = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, "<(/?s>)", "&lt;$1")
    return F.regexp_replace(out, "\\[(/?INST\\]|CTX\\])", "&#91;$1")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&#91;"), F.lit("["))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _turn(mark: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"<s>[{mark}]"), role, F.lit("[/INST]"), text, F.lit("</s>"))


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """conv_id, window (from 0), text, loss array<struct<start, stop>>, tokens, repeated (turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), escape(role).alias("r"), escape(text).alias("t"),
        (F.regexp_count(text, F.lit(TOKEN)) + MARKERS).cast("long").alias("n"),
        F.expr(f"turn div {TURN_RANGE}").alias("range"),
    )
    order = ["turn", "r", "t"]
    ranges = rows.groupBy("conv_id", "range").agg(
        F.sum("n").alias("part"),
        F.min(F.when(F.col("role") == "system", F.struct("turn", "r", "t", "n"))).alias("sys"),
    )
    conv = Window.partitionBy("conv_id")
    earlier = conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "conv_id", "range", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base"),
        F.min("sys").over(conv).alias("sys"),
    )
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    rows = rows.withColumn("inner", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("sys.n", F.lit(0)))
    rows = rows.alias("a").join(
        ranges.alias("b"),
        F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.range").eqNullSafe(F.col("b.range")),
    ).select("a.conv_id", "turn", "role", "r", "t", "n", "sys", (F.col("base") + F.col("inner")).alias("end"), room.alias("room"))
    slot = F.expr("(end - n) div room")
    rows = rows.withColumn("slot", slot).withColumn("over", F.col("end") > (F.col("slot") + 1) * F.col("room"))
    key = ["conv_id", "slot", "over"]
    in_window = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("piece", _turn("INST", F.col("r"), F.col("t"))).withColumn(
        "upto", F.sum(F.length("piece")).over(in_window.rowsBetween(Window.unboundedPreceding, 0))
    )
    same = [F.col(name).eqNullSafe(F.col(f"sys.{name}")) for name in order]
    rows = rows.withColumn("is_sys", F.coalesce((F.col("role") == "system") & same[0] & same[1] & same[2], F.lit(False)))
    stop = F.col("upto") - 4  # before the end marker
    listed = F.struct(
        *order, "piece", "end", "n", "is_sys",
        F.when(F.col("role") == "assistant", F.struct((stop - F.length("t")).alias("start"), stop.alias("stop"))).alias("loss"),
    )
    wins = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(listed)).alias("turns"), F.sum("n").alias("new_tokens"),
        F.max("end").alias("last"), F.min("sys").alias("sys"), F.max("is_sys").alias("has_sys"),
    )
    tail = F.slice(F.reverse(F.filter("turns", lambda x: (F.col("last") - x["end"] + x["n"] <= history) & ~x["is_sys"])), 1, history_turns)
    again = F.transform(F.reverse(tail), lambda x: _turn("CTX", x["r"], x["t"]))
    wins = wins.select(
        "conv_id", F.row_number().over(conv.orderBy("slot", "over")).alias("no"), "sys", "has_sys", "new_tokens",
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("body"),
        F.filter(F.transform("turns", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"),
        F.array_join(again, "").alias("tail"), F.size(tail).alias("tail_turns"),
        F.aggregate(tail, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("tail_tokens"),
        F.struct("slot", "over").alias("at"),
    )
    sys_at = F.min(F.when(F.col("has_sys"), F.col("no"))).over(conv)
    wins = wins.withColumn("sys_at", sys_at)
    before = wins.select("conv_id", (F.col("no") + 1).alias("no"), "tail", "tail_turns", "tail_tokens")
    out = wins.drop("tail", "tail_turns", "tail_tokens").alias("w").join(
        before.alias("p"), F.col("w.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("w.no") == F.col("p.no")), "left"
    )
    system = F.when(
        F.col("sys").isNotNull() & (F.col("w.no") != F.col("sys_at")), _turn("CTX", F.col("sys.r"), F.col("sys.t"))
    )
    head = F.concat(F.coalesce(system, F.lit("")), F.coalesce("tail", F.lit("")))
    out = out.select(
        "w.conv_id", (F.col("w.no") - 1).alias("window"), F.concat(head, "body").alias("text"),
        F.length(head).alias("shift"), "loss",
        (F.col("new_tokens") + F.coalesce("tail_tokens", F.lit(0)) + F.when(system.isNotNull(), F.col("sys.n")).otherwise(0)).alias("tokens"),
        (F.coalesce("tail_turns", F.lit(0)) + system.isNotNull().cast("int")).alias("repeated"),
    )
    moved = F.transform("loss", lambda x: F.struct(
        (x["start"] + F.col("shift")).alias("start"), (x["stop"] + F.col("shift")).alias("stop")
    ))
    return out.select("conv_id", "window", "text", moved.alias("loss"), "tokens", "repeated")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the mask, parsed from the formatted windows alone."""
    pieces = F.filter(F.split("text", "</s>", -1), lambda x: F.startswith(x, F.lit("<s>[INST]")))
    cut = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len("<s>[INST]") + 1)), "\\[/INST\\]", 2))
    turns = F.transform(cut, lambda x: F.concat(unescape(x[0]), F.lit("\n"), unescape(x[1]), F.lit("\n")))
    lost = F.transform("loss", lambda x: unescape(
        F.substr(F.col("text"), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int"))
    ))
    parsed = windows.select(
        "conv_id", "window", F.size(turns).alias("k"), F.array_join(turns, "").alias("turns"),
        F.array_join(lost, "").alias("lost"), F.length("text").alias("chars"),
    )

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", name))), lambda x: x[name]), "")

    whole = parsed.groupBy("conv_id").agg(
        F.sum("k").cast("long").alias("n_turns"), joined("turns").alias("turns"), joined("lost").alias("lost"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
