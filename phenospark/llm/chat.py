"""Chat formatting in budgeted windows, in DataFrame expressions only.

A turn is written ``<s>role\\n text </s>\\n`` (without the blanks). Inside texts and roles every
``<``, backslashes, then ``s>`` or ``/s>`` gets one more backslash, so a text never holds a control
string and unescaping gives back the exact text. A conversation's leading system turns are kept in
every window and charged to its budget. The other turns have token counts whose prefix sums are
cut at multiples of a stride: the turns inside a cell make a span, a turn across a cell's end makes
one by itself. A span's window also repeats the last turns before it, up to the history budget and
to what the span leaves of the window's. Only assistant text that is new in a window is under the
loss mask, so each is learnt once.

Defined cases: null texts and roles are empty; a null turn number sorts first and ties go by role,
then text, so repeated rows are turns of their own; a window goes past the budget only if its
system turns and a single other turn do, as turns are never cut; a conversation of system turns only gives one window; a null conversation id
is one conversation; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenospark.llm.common import n_words

OPEN, CLOSE = "<s>", "</s>\n"
TURN_OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?s>)", r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\(/?s>)", r"<$1$2")


def escape_role(role: Column) -> Column:
    """A role on one line: backslashes doubled, line ends as backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes part the role into pieces in which a backslash begins a line end."""
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """Format (conv_id, turn, role, text) rows; one row per window.

    Returns conv_id, window (from 0), formatted, n_repeated (leading turns of the window that an
    earlier one already has) and loss_spans, an array of (start, length) in code points of
    ``formatted``. Words stand for tokens, with a few more for each turn's frame.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select(
        "conv_id", "role", "text", (n_words("text") + TURN_OVERHEAD).alias("tokens"),
        F.row_number().over(in_order).alias("pos"),
        (F.min(F.col("role") == "system").over(so_far)).alias("lead"),
    )
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "start": F.coalesce(F.sum(F.when(F.col("lead"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0)),
        "room": F.greatest(F.lit(budget) - F.sum(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).over(conv), F.lit(0)),
    })
    # a quarter at most, so that few spans begin within the history of one turn
    t = t.withColumn("back", F.least(F.lit(history), F.floor(F.col("room") / 4)))
    t = t.withColumn("stride", F.greatest(F.col("room") - F.col("back"), F.lit(1)))
    cell, last_cell = F.floor(F.col("start") / F.col("stride")), F.floor((F.col("start") + F.col("tokens") - 1) / F.col("stride"))
    t = t.withColumn("span", F.when(~F.col("lead"), 2 * cell + (cell != last_cell).cast("bigint")))
    t = t.withColumn("first_span", F.coalesce(F.min("span").over(conv), F.lit(0)))

    role_text = [F.col("role"), F.col("text"), F.col("pos")]
    of_span = Window.partitionBy("conv_id", "span")
    turns_ = t.where(~F.col("lead")).withColumns({"begin": F.min("start").over(of_span), "held": F.sum("tokens").over(of_span)})
    left = F.least(F.col("back"), F.greatest(F.col("room") - F.col("held"), F.lit(0)))
    mark = F.when(F.col("start") == F.col("begin"), F.struct("span", "begin", left.alias("left")))
    # the spans that begin within the history's reach after a turn's start
    ahead = conv.orderBy("start").rangeBetween(1, history)
    near = F.filter(F.collect_list(mark).over(ahead), lambda m: m["begin"] - F.col("start") <= m["left"])
    own = F.array(F.struct("span", F.lit(False).alias("repeated")))
    again = F.transform("near", lambda m: F.struct(m["span"].alias("span"), F.lit(True).alias("repeated")))
    placed = turns_.withColumn("near", near).withColumn("at", F.explode(F.concat(own, again)))
    placed = placed.select("conv_id", F.col("at.span").alias("cell"), "at.repeated", *role_text)
    spans = t.where(~F.col("lead") & (F.col("span") > F.col("first_span")))
    spans = spans.select(F.col("conv_id").alias("w_conv"), F.col("span").alias("w_cell")).distinct()
    lead = t.where("lead").select("conv_id", "first_span", *role_text)
    firsts = lead.select("conv_id", F.col("first_span").alias("cell"), F.lit(False).alias("repeated"), *role_text)
    later = lead.join(spans, F.col("conv_id").eqNullSafe(F.col("w_conv")))
    later = later.select("conv_id", F.col("w_cell").alias("cell"), F.lit(True).alias("repeated"), *role_text)
    pieces = placed.unionByName(firsts).unionByName(later)

    body_text = escape(F.col("text"))
    piece = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), body_text, F.lit(CLOSE))
    rows = pieces.select(
        "conv_id", "cell",
        F.struct(
            "pos", piece.alias("piece"), "repeated",
            (F.length(F.lit(OPEN)) + F.length(escape_role(F.col("role"))) + 1).alias("text_at"), F.length(body_text).alias("text_len"),
            (~F.col("repeated") & (F.col("role") == "assistant")).alias("loss"),
        ).alias("p"),
    )
    # a window holds a budget of turns, so its array is bounded
    grouped = rows.groupBy("conv_id", "cell").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    ends = F.expr("aggregate(ps, array(0), (a, p) -> concat(a, array(element_at(a, -1) + length(p.piece))))")
    grouped = grouped.withColumn("ends", ends)
    return grouped.select(
        "conv_id", F.col("cell").alias("window"),
        F.expr("array_join(transform(ps, p -> p.piece), '')").alias("formatted"),
        F.expr("size(filter(ps, p -> p.repeated))").alias("n_repeated"),
        F.expr(
            "filter(transform(ps, (p, i) -> if(p.loss, struct(ends[i] + p.text_at AS start, p.text_len AS length), null)), s -> s IS NOT NULL)"
        ).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say: conv_id, window, turns (role and text of new turns), losses (texts to learn)."""
    pieces = F.regexp_extract_all("formatted", F.lit(rf"(?s){OPEN}(.*?){CLOSE}"), F.lit(1))
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
    )
    return windows.select(
        "conv_id", "window", "formatted", F.transform(new, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start + 1, s.length))).alias("losses"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest is of one conversation's whole text, so that text comes together in one row.
    """
    said = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    back = read_back(windows).select(
        "conv_id", F.struct("window", said.alias("said"), F.array_join("losses", "").alias("loss")).alias("w"),
        F.size("turns").alias("n"), F.length("formatted").alias("chars"),
    )
    per = back.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("ws"),
        F.sum("chars").cast("bigint").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    joined = lambda field: F.expr(f"array_join(transform(ws, w -> w.{field}), '')")
    return per.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("bigint").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
