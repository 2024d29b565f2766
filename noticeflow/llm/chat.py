"""Chat formatting: conversations as training windows with a loss mask, by column expressions only.

A turn is written as ``<|role|>text<|end|>`` and a newline; the role is URL-encoded, and in a text
every ``<`` that is followed by backslashes (none or more) and ``|`` gets one more backslash, so
that no text holds a control string and taking one away restores it.

Windows follow the prefix sums of the turns' token counts (``start`` and ``end`` of a turn in its
conversation, the leading system turn apart). The axis is cut into cells of ``budget - history -
system`` tokens; a turn belongs to the cell where it starts, and joins the other turns of that cell
if it ends within a cell's length of the first of them, else it opens a window of its own. So windows
are whole turns, in order, each turn once, and keep the budget unless one turn alone breaks it
(``over_budget``). Every window after the first repeats the leading system turn and the turns before
it that start at most ``history`` tokens before it.

The loss mask is a list of (start, end) code points of the window: the texts of its own assistant
turns. Repeated turns are never targets, so each assistant text is a target once.

One exchange by conversation serves prefix sums, windows and what readers group by conversation.

Defined cases: turns are ordered by (turn, role, text), nulls first, so equal rows are turns each
and ties have one order; null text or role is empty; rows without conv_id are one conversation; only
a first turn with role ``system`` is the leading one; one longer than the budget leaves cells of one token;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
#: An ASCII letter or digit run of up to six, or another character that is no white space.
TOKEN = r"[A-Za-z0-9]{1,6}|[^A-Za-z0-9\x20\x09-\x0D]"
MARKER_TOKENS = 3
TARGET = "assistant"
END = "<|end|>\n"

_CONTROL = r"<(\\*+)\|"
_ESCAPED = r"<\\(\\*+)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|")


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.url_encode(role), F.lit("|>"))


def n_tokens(text: Column) -> Column:
    """Tokens of a turn with its marks."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARKER_TOKENS


def placed_turns(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their start and end on the token axis, their window (start of its first turn) and what repeats them.

    ``repeats`` lists the starts of later windows that repeat the turn as history.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", n_tokens(F.col("text")))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(by)).withColumn("is_system", (F.col("nth") == 1) & (F.col("role") == "system"))
    told = Window.partitionBy("conv_id").orderBy("nth")
    upto = told.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("is_system"), F.lit(0).cast("long")).otherwise(F.col("tokens"))
    rows = rows.withColumns({
        "end": F.sum(own).over(upto),
        "system_tokens": F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(upto),
    }).withColumn("start", F.col("end") - own)
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_tokens"))
    rows = rows.withColumn("room", room).withColumn("cell", F.floor(F.col("start") / F.col("room")))
    # the leading system turn and the turn after it start at 0, in the first window
    cell = Window.partitionBy("conv_id", "cell").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cell_start", F.min("start").over(cell))
    alone = (F.col("end") - F.col("cell_start") > F.col("room")) & (F.col("start") > F.col("cell_start"))
    rows = rows.withColumn("window", F.when(alone, F.col("start")).otherwise(F.col("cell_start")))
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    first = (F.col("window") == F.col("start")) & ~F.col("is_system")
    return rows.withColumn("repeats", F.when(F.col("is_system"), F.array()).otherwise(F.collect_list(F.when(first, F.col("start"))).over(ahead)))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 0), formatted, loss (array of start, end), n_repeated, n_tokens, over_budget.

    The first ``n_repeated`` turns of a window are repeated ones.
    """
    placed = placed_turns(turns, budget, history)
    by = Window.partitionBy("conv_id").orderBy("nth")
    system = F.first(F.when(F.col("is_system"), F.struct("role", "text", "tokens"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opens = (F.col("window") == F.col("start")) & ~F.col("is_system") & (F.col("start") > 0)
    turn = lambda nth, role, text, tokens, target: F.struct(nth.alias("nth"), role.alias("role"), text.alias("text"), tokens.alias("tokens"), target.alias("target"))
    mine = turn(F.col("nth"), F.col("role"), F.col("text"), F.col("tokens"), F.lit(True))
    again = turn(F.col("nth"), F.col("role"), F.col("text"), F.col("tokens"), F.lit(False))
    kept = F.when(opens & F.col("system").isNotNull(), F.array(turn(F.lit(0), F.col("system.role"), F.col("system.text"), F.col("system.tokens"), F.lit(False)))).otherwise(F.array())
    at = lambda window, t: F.struct(window.alias("at"), t.alias("t"))
    parts = F.concat(
        F.array(at(F.col("window"), mine)),
        F.transform("repeats", lambda w: at(w, again)),
        F.transform(kept, lambda t: at(F.col("window"), t)),
    )
    rows = placed.withColumn("system", system).select("conv_id", F.inline(parts))
    windows = rows.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(opening(t.role).alias("head"), escape(t.text).alias("body"), (t.target & (t.role == TARGET)).alias("target"), t.target.alias("own"), t.tokens.alias("tokens")))
    windows = windows.select("conv_id", "at", F.inline(F.array(F.struct(written.alias("turns")))))
    # a fold over the turns carries the position and drops the spans that are no targets
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        stop = begin + F.length(t["body"])
        span = F.array(F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("end")))
        return F.struct((stop + len(END)).cast("int").alias("at"), F.when(t["target"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    number = Window.partitionBy("conv_id").orderBy("at")
    return windows.select(
        "conv_id",
        (F.row_number().over(number) - 1).alias("window"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", zero, step)["spans"].alias("loss"),
        F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_repeated"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted window."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def read(piece: Column) -> Column:
        head = F.locate("|>", piece)
        return F.struct(F.url_decode(F.substr(piece, F.lit(3), head - 3)).alias("role"), unescape(F.substr(piece, head + 2)).alias("text"))

    return F.transform(pieces, read)


def read_targets(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, targets and sizes."""
    own = F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    newline = F.lit("\n")
    said = F.array_join(F.transform("own", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    read = windows.withColumn("turns", read_turns(F.col("formatted"))).withColumn("own", own).select(
        "conv_id", "window", F.size("own").alias("n"), said.alias("said"), F.array_join(read_targets(F.col("formatted"), F.col("loss")), "").alias("learned"), F.length("formatted").alias("chars")
    )
    whole = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda w: w[c]), "")
    joined = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), whole("said").alias("said"), whole("learned").alias("learned"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    return joined.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars"
    )
