r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := turn*
    turn         := "### " ROLE ": " TEXT "</turn>" LF

ROLE and TEXT must not hold the control strings ``###`` and ``</turn>`` as they
are; a backslash makes the next character plain. A turn is first rendered as
it is and parsed back. Where the parse fails or differs from the source, the
turn is rendered with a backslash before each of its backslashes and number
signs and within ``</turn>``, and the whole conversation is parsed again; a conversation
that still differs stops the job.

The loss mask has, for each assistant turn, place and length of its text in
the formatted conversation.

Null texts and roles are empty. Turns are ordered by number (null first), then
role and text; repeated turns all count. Work on turns is done before they meet;
one conversation's text is one value, as its digests ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
TRAINED = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(MIDDLE), F.lit(":\\ ")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """Role and text of a rendered turn without its end, or null where the grammar doesn't hold."""
    body = F.substr(piece, F.lit(len(HEAD) + 1))
    cut = F.locate(MIDDLE, body)
    role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + len(MIDDLE))
    loose = lambda c: c.contains("###") | c.contains("</turn>")
    holds = piece.startswith(HEAD) & (cut > 0) & ~loose(role) & ~loose(text)
    return F.when(holds, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation; null in place of one that the grammar doesn't know."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn rendered, as it is where that parses back, else escaped: conv_id, place in order, piece, mask."""
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    source = F.struct("role", "text")
    as_is = render_turn(F.col("role"), F.col("text"))
    escaped = render_turn(escape(F.col("role"), True), escape(F.col("text")))
    tried = plain.withColumn("as_is", as_is).withColumn("back", parse(F.col("as_is")))
    same = F.col("back").eqNullSafe(F.array(source))
    made = tried.select(
        "conv_id", "turn", "role", "text", F.when(same, F.col("as_is")).otherwise(escaped).alias("piece"), (~same).alias("escaped")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = F.length(F.when(F.col("escaped"), escape(F.col("role"), True)).otherwise(F.col("role"))) + len(HEAD) + len(MIDDLE)
    start = F.coalesce(before, F.lit(0)) + head
    length = F.length("piece") - head - len(END)
    mask = F.when(F.col("role") == TRAINED, F.struct(start.cast("long").alias("start"), length.cast("long").alias("length")))
    return made.withColumn("place", F.row_number().over(order)).withColumn("mask", mask)


def format_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """conv_id, formatted, loss_mask (start, length), n_escaped; every conversation parses back to its source."""
    turns = format_turns(rows, **names)
    line = F.struct("place", "piece", "mask", F.struct("role", "text").alias("source"), "escaped")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    made = grouped.select(
        "conv_id",
        F.array_join(F.transform("lines", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("lines", lambda x: x["mask"]), lambda m: m.isNotNull()).alias("loss_mask"),
        F.transform("lines", lambda x: x["source"]).alias("source"),
        F.size(F.filter("lines", lambda x: x["escaped"])).alias("n_escaped"),
    )
    fails = F.raise_error(F.concat(F.lit("a conversation does not parse back to its source: "), F.col("conv_id").cast("string")))
    checked = F.when(parse(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(fails)
    return made.select("conv_id", checked.alias("formatted"), "loss_mask", "n_escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and the text under the loss mask, from the formatted conversations alone."""
    under = F.transform(
        "loss_mask",
        lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))),
    )
    return formatted.select(
        "conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped",
    )
