"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn's tokens are its words and signs, counted by a pattern, and a fixed
overhead for its marks. Prefix sums of these tokens choose spans of whole
turns: a new span begins where the sum passes a multiple of half the budget for
new turns, and a turn above that half stands alone, so a window never exceeds
the budget unless one turn alone, or a system turn beyond its own budget, does. A window is the conversation's system turn, as
much of the turns just before the span as the history budget allows, and the
span. Repeated turns, the system turn included, are outside the loss mask.

The template is <|im_start|>role<|im_sep|>text<|im_end|> and a line feed. In
roles and texts a backslash is doubled and <| becomes <\\|, so no control string
can be read from a text, and a single pass undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OVERHEAD = 4
#: Turns of a conversation whose prefix sums one task adds up; their totals are added up in a second step.
SPAN_TURNS = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _prefix(turns: DataFrame, value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the earlier turns of the conversation, in two levels so that no task sums up a whole long conversation."""
    inner = Window.partitionBy("conv", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col(f"base_{value}"))


def windows(turns: DataFrame, budget: int = 1024, history: int = 128, system: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, n_turns, n_tokens, loss (start, end of code points, exclusive).

    Turns are ordered by turn, then role, text. A null role or text is empty;
    turns of a null conversation form one conversation; repeated rows are turns
    of their own. The system turn is the first turn if its role is system; it is
    repeated in every window after the first. An empty table gives no window.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")) + OVERHEAD).cast("long"))
    ord_ = F.struct("turn", "role", "text").alias("ord")
    rows = rows.select("conv", "role", "text", "tokens", ord_, F.floor(F.col("turn") / SPAN_TURNS).alias("part"))

    half = (budget - history - system) // 2
    long_ = (F.col("tokens") > half).cast("long")
    short = F.when(F.col("tokens") > half, 0).otherwise(F.col("tokens"))
    rows = rows.withColumns({"big": long_, "small": short, "one": F.lit(1).cast("long")})
    parts = rows.groupBy("conv", "part").agg(F.sum("big").alias("big"), F.sum("small").alias("small"), F.sum("one").alias("one"), F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("big", "small", "one", "tokens")))
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.conv").eqNullSafe(F.col("p.conv")) & (F.col("r.part") == F.col("p.part"))).select("r.*", "base_big", "base_small", "base_one", "base_tokens")
    for value, name in (("big", "bigs"), ("small", "sum"), ("one", "nth"), ("tokens", "earlier")):
        rows = _prefix(rows, value, name)
    # Where a span begins: another stretch of half the budget, or before and after a long turn.
    rows = rows.withColumn("span", F.struct((2 * F.col("bigs") + F.col("big")).alias("run"), F.floor(F.col("sum") / half).alias("cut")))
    return _assembled(Scratch(turns.sparkSession, "chat").save(rows.drop("big", "small", "one", "bigs", "sum", "base_big", "base_small", "base_one", "base_tokens", "part", "ord"), "turns"), budget, history)


def _assembled(rows: DataFrame, budget: int, history: int) -> DataFrame:
    # A turn may be repeated in the window after its own, if the turns between fit the history budget.
    rows = rows.withColumn("upto", F.col("earlier") + F.col("tokens"))
    spans = rows.groupBy("conv", "span").agg(F.max("upto").alias("upto_last"), F.min("nth").alias("begin"))
    window_no = Window.partitionBy("conv").orderBy("begin")
    spans = spans.withColumns({"window": F.row_number().over(window_no).cast("long") - 1, "to": F.lead("span").over(window_no)})
    spans = spans.select(F.col("conv").alias("c"), F.col("span").alias("s"), "window", "to", "upto_last", "begin")
    rows = rows.join(spans, rows.conv.eqNullSafe(F.col("c")) & (rows.span == F.col("s"))).drop("c", "s")
    is_system = (F.col("nth") == 0) & (F.col("role") == "system")
    piece = lambda where, again: F.struct(where.alias("window"), F.lit(again).alias("again"))
    fits = (F.col("upto_last") - F.col("upto") + F.col("tokens") <= history) & F.col("to").isNotNull() & ~is_system
    own = rows.select("conv", "role", "text", "tokens", "nth", F.explode(F.filter(F.array(piece(F.col("window"), False), F.when(fits, piece(F.col("window") + 1, True))), lambda x: x.isNotNull())).alias("at"))
    own = own.select("conv", F.col("at.window").alias("window"), F.col("at.again").alias("again"), "role", "text", "tokens", "nth")
    system = rows.where(is_system).select(F.col("conv").alias("c"), "role", "text", "tokens", "nth")
    later = spans.where("window > 0").select("c", "window").alias("w").join(system.alias("s"), F.col("w.c").eqNullSafe(F.col("s.c"))).select(F.col("w.c").alias("conv"), "w.window", F.lit(True).alias("again"), "role", "text", "tokens", "nth")
    turn = F.struct("nth", "again", "tokens", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"), (~F.col("again") & (F.col("role") == "assistant")).alias("learn"))
    made = own.unionByName(later).groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = len(END) + 1
    none = F.array().cast("array<struct<start:int,`end`:int>>")

    def step(a: Column, t: Column) -> Column:
        begin = a.at + F.length(t.head)
        stop = begin + F.length(t.body)
        return F.struct((stop + tail).alias("at"), F.when(t.learn, F.concat(a.loss, F.array(F.struct(begin.alias("start"), stop.alias("end"))))).otherwise(a.loss).alias("loss"))

    return made.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END + "\n"))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t.again)).alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t.tokens).alias("n_tokens"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda a: a.loss).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows' text and masks alone: its turns once each, and all text under the mask."""
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda s: s != ""),
        lambda s: F.struct(unescape(F.substring_index(F.substring(s, len(START) + 1, 1 << 30), SEP, 1)).alias("role"), unescape(F.substring_index(s, SEP, -1)).alias("text")),
    )
    learned = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x.start + 1, x.end - x.start))), "")
    each = formatted.select("conv_id", "window", F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.col("n_turns"), F.lit(1))).alias("own"), learned.alias("learned"), F.length("formatted").cast("long").alias("n"))
    whole = F.array_join(F.transform("own", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    each = each.select("conv_id", F.struct("window", F.size("own").alias("n"), whole.alias("turns"), "learned").alias("w"), "n")
    joined = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("formatted_chars"))
    text = joined.select("conv_id", F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w.n).alias("n_turns"), F.array_join(F.transform("ws", lambda w: w.turns), "").alias("turns"), F.array_join(F.transform("ws", lambda w: w.learned), "").alias("learned"), "formatted_chars")
    return text.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
