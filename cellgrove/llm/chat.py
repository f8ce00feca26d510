r"""Chat formatting in budgeted windows of whole turns.

A turn is written ``### role: text</turn>`` and a line end; a turn that an earlier
window already had is written ``### * role: text</turn>``. Backslash, ``#`` and ``<``
inside texts (also ``:`` and ``*`` inside roles) get a backslash before them, so no
text can hold a control string, and taking the backslashes off gives it back.

Windows come from prefix sums alone. What the budget leaves beside the system turn and
the history is the room for new turns; the token axis of a conversation is cut into
blocks of that many tokens. Turns wholly inside a block share a window. A turn over a
border joins the window before it if the room holds both, else it has a window of its
own. So a window, system turn and history counted, keeps to the budget. One turn that is
longer than the room is kept whole and gets as much history as the budget leaves it;
its window is over the budget only if that turn and the system turn are so by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens (words) of a window and of the history repeated in it; turns of history.
BUDGET, HISTORY, HISTORY_TURNS = 512, 64, 2
TARGET = "assistant"
_TURN = r"### (\* )?([^\\:]*+(?:\\.[^\\:]*+)*+): ([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n"


def _escape(text: Column, marks: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{marks}])", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    target: str = TARGET,
) -> DataFrame:
    """One row per window: ``conv``, ``window``, ``formatted``, ``loss`` (start and end of each masked-in span).

    A window has the conversation's first turn if that is a system turn, then up
    to ``HISTORY_TURNS`` turns before its first one while they stay within
    ``history`` tokens, then its own turns. Only targets among its own turns
    carry loss, so each does so once over all windows; spans are code points of
    ``formatted`` over the escaped text.

    Null texts and roles count as empty ones, null turns come first, equal turn
    numbers are ordered by role and text, repeated rows are turns of their own.
    A null conversation is one conversation. No rows give no windows.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.select(
        F.col(conv).alias("_c"), F.col(turn).alias("_n"), F.coalesce(F.col(role), F.lit("")).alias("_r"),
        F.coalesce(F.col(text), F.lit("")).alias("_t"), words.alias("_w"),
    )
    order = Window.partitionBy("_c").orderBy("_n", "_r", "_t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    this = F.struct(F.col("_r").alias("role"), F.col("_t").alias("text"), F.col("_w").alias("words"))
    rows = rows.withColumns(
        {
            "_i": F.row_number().over(order),
            "_end": F.sum("_w").over(upto),
            "_first": F.first(F.when(F.col("_r") == "system", this)).over(upto),
            **{f"_h{k}": F.lag(this, k).over(order) for k in range(1, HISTORY_TURNS + 1)},
        }
    )
    start, left = F.col("_end") - F.col("_w"), F.lit(budget) - F.coalesce(F.col("_first")["words"], F.lit(0))
    room = F.greatest(left - history, F.lit(1))
    block, last = F.floor(start / room), F.floor(F.greatest(F.col("_end") - 1, start) / room)
    rows = rows.withColumns({"_start": start, "_room": room, "_block": block, "_over": block != last})
    # what starts in a block starts there behind the turn over its first border
    since = F.min("_start").over(Window.partitionBy("_c", "_block"))
    alone = F.col("_over") & (F.col("_end") - since > F.col("_room"))
    rows = rows.withColumn("_b", (2 * F.col("_block") + alone.cast("long")).cast("long"))
    # history that is left beside a turn longer than the room
    new = F.greatest("_w", F.lit(1))
    history = F.when(new > left - history, F.least(F.lit(history), left - new)).otherwise(history)

    part = lambda t, repeated: F.struct(F.lit(repeated).alias("repeated"), t["role"].alias("role"), t["text"].alias("text"))
    used, before = F.lit(0), []
    for k in range(1, HISTORY_TURNS + 1):
        h = F.col(f"_h{k}")
        used = used + h["words"]
        # turn 1 is not history if it is the system turn, which the window has anyway
        before.append(F.when((used <= history) & ~((F.col("_i") - k == 1) & F.col("_first").isNotNull()), part(h, True)))
    ahead = F.array(F.when((F.col("_i") > 1) & F.col("_first").isNotNull(), part(F.col("_first"), True)), *before[::-1])
    lead = F.struct(F.col("_i").alias("at"), F.filter(ahead, lambda t: t.isNotNull()).alias("turns"))
    own = F.struct(F.col("_i").alias("at"), part(this, False).alias("turn"))
    grouped = rows.groupBy("_c", "_b").agg(F.min_by(lead, "_i").alias("lead"), F.sort_array(F.collect_list(own)).alias("own"))
    all_turns = F.concat(F.col("lead")["turns"], F.transform("own", lambda t: t["turn"]))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit("### "), F.when(t["repeated"], "* ").otherwise(""), _escape(t["role"], r"\\#<:*"), F.lit(": "))
        return F.struct(head.alias("head"), _escape(t["text"]).alias("body"), (~t["repeated"] & (t["role"] == target)).alias("loss"))

    def place(a: Column, p: Column) -> Column:
        first = a["at"] + F.length(p["head"])
        end = first + F.length(p["body"])
        span = F.when(p["loss"], F.array(F.struct(first.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len("</turn>\n")).alias("at"), F.concat(a["loss"], span).alias("loss"))

    laid = grouped.select("_c", F.col("lead")["at"].alias("window"), F.transform(all_turns, pieces).alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return laid.select(
        F.col("_c").alias(conv), F.col("window").cast("long").alias("window"),
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n"))), "").alias("formatted"),
        F.aggregate("p", zero, place, lambda a: a["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns and targets of each conversation, read from the formatted windows.

    The window column is the number of the window's first own turn, so it orders
    them. Columns: n_turns, turns (role, line end, text, line end for each own
    turn), loss (all text under the mask, unescaped), formatted_chars.
    """
    pick = lambda n: F.regexp_extract_all("formatted", F.lit(_TURN), n)
    own = F.filter(F.arrays_zip(pick(1).alias("again"), pick(2).alias("role"), pick(3).alias("text")), lambda t: t["again"] == "")
    said = F.transform(own, lambda t: F.concat(_unescape(t["role"]), F.lit("\n"), _unescape(t["text"]), F.lit("\n")))
    under = F.transform("loss", lambda s: _unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    rows = formatted.select(
        conv, F.length("formatted").cast("long").alias("chars"), F.size(own).cast("long").alias("n"),
        F.struct("window", F.array_join(said, "").alias("said"), F.array_join(under, "").alias("under")).alias("w"),
    )
    per = rows.groupBy(conv).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    return per.select(
        conv, "n_turns", F.array_join(F.transform("ws", lambda w: w["said"]), "").alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["under"]), "").alias("loss"), "formatted_chars",
    )


def report(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what ``read_back`` finds in the windows of each conversation."""
    return read_back(windows(turns, conv), conv).select(
        conv, "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
