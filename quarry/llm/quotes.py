"""Quotation linking: conversations in reply order, without their quotes.

A message's lines are parsed into nested quote levels (leading ``>`` marks).  Runs
of lines of one level are passages; a passage is normalised (case, white space,
marks) and hashed.  Originals are the unquoted passages of all messages: whole
messages, their runs of unquoted lines, and the paragraphs of both.  Originals with the same hash are reduced to one
before any join, the earliest in the conversation and the earliest of all, so
that a passage that very many messages share doesn't multiply.  A quoted passage
is linked as a whole, or else paragraph by paragraph; it counts as one quote, linked
if a part of it is.  It links to the earliest original in its conversation before it, else to the
earliest of all if that stands in an earlier conversation.  A message replies to
the message that its longest linked passage (or paragraph) of the lowest level
comes from.

Conversations that quote an earlier one join its thread: links go to smaller
conversation ids only, so there are no cycles, and threads are found by jumping
along the links.  Messages sort by thread, conversation and turn.

Defined cases: a null text is an empty message without quotes; a passage without
letters or digits is linked with nothing, but removed; equal messages link to the
earliest; rows that repeat a turn are each returned; a null conversation is its
own thread (null) and links to nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, pack, unpack

MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
PARAGRAPH = r"\n[ \t\r]*\n"


def lines_of(text: F.Column) -> F.Column:
    """Array of (level, line): the number of quote marks before each line, and the rest."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")),
    )


def passages_of(lines: F.Column) -> F.Column:
    """Array of (level, text): runs of lines of one level, joined by newlines."""

    # arrays of one element bind what would otherwise be computed again for every line
    def of(every: F.Column) -> F.Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (i == 0) | (F.get(every, i).level != F.get(every, i - 1).level))

        def cut(begin: F.Column) -> F.Column:
            def run(at: F.Column, k: F.Column) -> F.Column:
                own = F.slice(every, at + 1, F.coalesce(F.get(begin, k + 1), F.size(every)) - at)
                return F.struct(F.get(every, at).level.cast("int").alias("level"), F.array_join(F.transform(own, lambda x: x.line), "\n").alias("text"))

            return F.transform(begin, run)

        return F.flatten(F.transform(F.array(starts), cut))

    return F.flatten(F.transform(F.array(lines), of))


def normal(text: F.Column) -> F.Column:
    """Letters and digits of all scripts, in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def name(text: F.Column) -> F.Column:
    return F.when(normal(text) != "", F.sha2(normal(text), 256))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``_body`` (text without quotes), ``_quotes``, ``_linked``, ``_reply_conv``, ``_reply_turn``
    and ``_thread``, sorted into reply order."""
    parsed = pack(messages, None, _conv=F.col(conv), _turn=F.col(turn), _text=F.col(text)).withColumn("_lines", lines_of(F.col("_text")))
    quoting = F.exists("_lines", lambda x: x.level > 0)
    body = F.array_join(F.transform(F.filter("_lines", lambda x: x.level == 0), lambda x: x.line), "\n")
    parsed = parsed.withColumns({"_body": F.when(quoting, body).otherwise(F.coalesce(F.col("_text"), F.lit(""))), "_quoting": quoting})
    parsed = materialize(parsed.withColumn("_passages", F.when(quoting, passages_of(F.col("_lines")))).drop("_lines", "_text").withColumn("_row", F.monotonically_increasing_id()), "messages")

    quotes = parsed.where("_quoting").select("_row", F.col("_conv").alias("c"), F.col("_turn").alias("t"), F.posexplode(F.filter("_passages", lambda x: x.level > 0)).alias("q", "p"))
    # part 0 is the whole passage, the others are its paragraphs
    paragraphs = F.split("p.text", PARAGRAPH)
    pieces = F.concat(F.array("p.text"), F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array().cast("array<string>")))
    quotes = quotes.select("_row", "c", "t", "q", F.col("p.level").alias("level"), F.posexplode(pieces).alias("part", "text"))
    quotes = materialize(quotes.select("_row", "c", "t", "q", "level", "part", F.length(normal(F.col("text"))).alias("size"), name(F.col("text")).alias("h")), "quotes")
    runs = F.when(F.col("_quoting"), F.transform(F.filter("_passages", lambda x: x.level == 0), lambda x: x.text)).otherwise(F.array().cast("array<string>"))
    parts = F.array_union(F.array_union(F.array("_body"), F.split("_body", PARAGRAPH)), F.array_union(runs, F.flatten(F.transform(runs, lambda x: F.split(x, PARAGRAPH)))))
    own = parsed.where(F.col("_conv").isNotNull() & F.col("_turn").isNotNull()).select(F.col("_conv").alias("c"), F.col("_turn").alias("t"), F.explode(F.transform(parts, name)).alias("h")).where("h IS NOT NULL")
    # only passages that somebody quotes go on; what is quoted is made distinct first
    wanted = materialize(quotes.where("h IS NOT NULL").select("h").distinct(), "quoted")
    own = own.join(wanted, "h", "left_semi")
    near = materialize(own.groupBy("h", "c").agg(F.min("t").alias("near")), "originals")
    far = materialize(near.groupBy("h").agg(F.min(F.struct("c", F.col("near").alias("t"))).alias("far")), "earliest")
    found = quotes.join(near, ["h", "c"], "left").join(far, "h", "left")
    to = F.when(F.col("near") < F.col("t"), F.struct("c", F.col("near").alias("t"))).when(F.col("far.c") < F.col("c"), F.col("far"))
    found = found.withColumn("to", to)
    best = F.min(F.when(F.col("to").isNotNull(), F.struct("level", F.col("part") > 0, (-F.col("size")).alias("less"), "to")))
    found = found.groupBy("_row", "q").agg(best.alias("best"), F.first("c").alias("c"))
    first = F.min(F.when(F.col("best").isNotNull(), F.struct("best.level", "best.less", "best.to")))
    links = materialize(found.groupBy("_row").agg(F.count("*").alias("_quotes"), F.count("best").alias("_linked"), first.getField("to").alias("_to"), F.first("c").alias("c")), "links")

    up = links.where("_to.c < c").groupBy("c").agg(F.min("_to.c").alias("up"))
    threads = materialize(up, "threads")
    while threads.limit(1).count():
        step = threads.join(threads.select(F.col("c").alias("up"), F.col("up").alias("next")), "up", "left").select("c", F.coalesce("next", "up").alias("up"), (F.col("next").isNotNull()).alias("moved"))
        step = materialize(step, "threads")
        threads = step.select("c", "up")
        if not step.where("moved").limit(1).count():
            break
    out = parsed.drop("_passages", "_quoting").join(links.drop("c"), "_row", "left").join(threads.withColumnRenamed("c", "_c"), F.col("_conv") == F.col("_c"), "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        ROW, "_conv", "_turn", "_body", F.coalesce("_quotes", zero).alias("_quotes"), F.coalesce("_linked", zero).alias("_linked"),
        F.col("_to.c").alias("_reply_conv"), F.col("_to.t").alias("_reply_turn"), F.coalesce("up", F.col("_conv")).alias("_thread"),
    )
    return unpack(out.orderBy("_thread", "_conv", "_turn"), messages.columns, None, False, ["_body", "_quotes", "_linked", "_reply_conv", "_reply_turn", "_thread"])
