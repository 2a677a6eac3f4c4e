"""Chat formatting: preference pairs with a shared prompt and masked completions.

Input is one row per turn: ``pair_id, side ('chosen' or 'rejected'), turn, role, text``.
The longest common turn prefix of the two sides is rendered once as ``prompt``; what follows
on each side is its completion. A completion comes with the spans (start and end in
characters) of assistant texts, the only ones to be learned; everything else is masked.

Turns are compared by number, so no side is sorted as a whole: the prefix ends before the
first turn number at which the sides differ. Turns of one number are taken in order of
``(role, text)``; repeated rows count once. Null numbers come before all others, null roles
are rendered as ``unknown``, null texts as empty (both equal only to themselves when sides
are compared). Rows with a null pair or any other side are no part of a pair. A pair with
one side has an empty prompt. Completions may be empty. Conversations beyond ``PART`` turn
numbers continue in rows of the next ``part``, so no row grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PART = 1000
_EARLIEST = -(1 << 62)


def _turn_key() -> Column:
    return F.coalesce(F.col("turn").cast("long"), F.lit(_EARLIEST))


def _safe(text: Column) -> Column:
    """Markers inside a text lose their bars, so that no text can forge a turn."""
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("|", "")))
    return text


def _rendered(turns: Column) -> Column:
    """The rendered turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")


def _spans(turns: Column) -> Column:
    """``start-end`` of each learned text within ``_rendered(turns)``, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    tail = len(END) + 1

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + tail).alias("at"),
            F.when(t["learned"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def preference_pairs(turns: DataFrame, part: int = PART) -> DataFrame:
    """``pair_id, part, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen,
    chosen_spans, rejected, rejected_spans``; the counts are those of the part."""
    rows = (
        turns.where("pair_id is not null and side in ('chosen', 'rejected')")
        .select("pair_id", "side", _turn_key().alias("turn"), "role", "text")
        .distinct()
    )
    on = [F.when(F.col("side") == s, F.struct("role", "text")) for s in ("chosen", "rejected")]
    both = rows.groupBy("pair_id", "turn").agg(
        F.array_sort(F.collect_list(on[0])).alias("chosen"),
        F.array_sort(F.collect_list(on[1])).alias("rejected"),
    )
    first = (
        both.where(~F.col("chosen").eqNullSafe(F.col("rejected")))
        .groupBy("pair_id")
        .agg(F.min("turn").alias("first_difference"))
    )
    shared = F.col("first_difference").isNull() | (F.col("turn") < F.col("first_difference"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    parts = (
        both.join(first, "pair_id", "left")
        .withColumn("part", F.floor(F.col("turn") / part).cast("long"))
        .groupBy("pair_id", "part")
        .agg(
            *[
                F.array_sort(F.collect_list(F.struct("turn", F.when(take, F.col(side)).otherwise(none).alias("t"))))
                .alias(name)
                for name, side, take in (
                    ("prompt", "chosen", shared),
                    ("chosen", "chosen", ~shared),
                    ("rejected", "rejected", ~shared),
                )
            ]
        )
    )

    def flat(name: str) -> Column:
        def drawn(t: Column) -> Column:
            return F.struct(
                F.concat(F.lit(START), _safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n")).alias("head"),
                _safe(F.coalesce(t["text"], F.lit(""))).alias("body"),
                F.coalesce(t["role"] == LEARNED, F.lit(False)).alias("learned"),
            )

        return F.transform(F.flatten(F.transform(F.col(name), lambda x: x["t"])), drawn)

    names = ("prompt", "chosen", "rejected")
    drawn = parts.select("pair_id", "part", *[flat(n).alias(n) for n in names])
    return drawn.select(
        "pair_id",
        "part",
        *[F.size(n).cast("long").alias(f"n_{n}_turns") for n in names],
        _rendered(F.col("prompt")).alias("prompt"),
        _rendered(F.col("chosen")).alias("chosen"),
        _spans(F.col("chosen")).alias("chosen_spans"),
        _rendered(F.col("rejected")).alias("rejected"),
        _spans(F.col("rejected")).alias("rejected_spans"),
    )


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations ``2k`` and ``2k + 1`` as chosen and rejected side of pair ``k``."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn",
        "role",
        "text",
    )
