"""Conversation logs: history, transcripts, token totals, words.

The history before a turn is everything said earlier in the conversation. To
store that text for every turn would grow with the square of a conversation,
so it is kept once, in bounded ordered pieces (``transcript``); ``history``
gives each turn its place in it: the history of a turn is the transcript's
first ``chars_before`` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens

CHUNK = 1_024  # turns that one running window covers
PIECE = 256  # turns in one piece of a transcript


def message_line() -> Column:
    return F.concat(F.col("role"), F.lit(": "), F.col("text"), F.lit("\n"))


def history(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each turn: messages and characters before it, and its question number.

    A running total in two levels: within chunks of a conversation, and over
    the chunk totals. A conversation with a third of all rows is spread over
    as many groups as it has chunks.
    """
    measures = {
        "turns_before": F.lit(1).cast("long"),
        "chars_before": F.length(message_line()).cast("long"),
        "question_no": (F.col("role") == "user").cast("long"),
    }
    marked = log.withColumn("__chunk", F.floor(F.col("turn") / chunk)).withColumns(
        {f"__{name}": value for name, value in measures.items()}
    )
    totals = marked.groupBy("conv_id", "__chunk").agg(*[F.sum(f"__{m}").alias(m) for m in measures])
    earlier = Window.partitionBy("conv_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("conv_id").alias("__conv"),
        F.col("__chunk").alias("__at"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0).cast("long")).alias(f"__carried_{m}") for m in measures],
    )
    inside = Window.partitionBy("conv_id", "__chunk").orderBy("turn")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)

    def running(m: str) -> Column:
        own = F.sum(f"__{m}").over(upto if m == "question_no" else before)
        return (F.coalesce(own, F.lit(0).cast("long")) + F.col(f"__carried_{m}")).alias(m)

    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("__chunk").eqNullSafe(F.col("__at"))
    return marked.join(carried, same).select("conv_id", "turn", "role", "text", *[running(m) for m in measures])


def transcript(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """Messages in order as ``role: text`` lines, in pieces of a bounded number of turns."""
    return (
        log.groupBy("conv_id", F.floor(F.col("turn") / piece).alias("piece_no"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", message_line().alias("line")))).alias("lines"))
        .select(
            "conv_id",
            "piece_no",
            F.size("lines").alias("n_turns"),
            F.concat_ws("", F.col("lines.line")).alias("piece_text"),
        )
    )


def token_usage(log: DataFrame, prompt_rate: float = 0.0015, completion_rate: float = 0.002) -> DataFrame:
    """Tokens and cost per conversation (rates per 1000 tokens).

    What the assistant says is completion, everything else is prompt.
    """
    n = F.size(tokens(F.col("text"))).cast("long")
    said = F.col("role") == "assistant"
    sums = log.groupBy("conv_id").agg(
        F.sum(F.when(said, 0).otherwise(n)).alias("prompt_tokens"),
        F.sum(F.when(said, n).otherwise(0)).alias("completion_tokens"),
    )
    cost = (F.col("prompt_tokens") * prompt_rate + F.col("completion_tokens") * completion_rate) / 1000
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn(
        "total_cost", cost
    )


def word_rows(log: DataFrame) -> DataFrame:
    """The words of each message, one per row, with a trailing blank."""
    return log.select("conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("word_no", "word")).withColumn(
        "word", F.concat("word", F.lit(" "))
    )
