"""Chat formatting from event logs: replayed into final messages, then rendered with a mask for the loss.

A log has a row for each event of a message: `delta` appends streamed text, `edit` replaces the text, `regenerate` throws it away
(the deltas after it stream a new one), `remove` takes the message back until something follows. Events are partitioned by conversation and message,
sorted by sequence and folded. Messages in order of their turns are rendered as

    <s>  <|role|>\\n text </s>\\n  ...

with every control string inside texts and roles broken by a backslash behind its first character and backslashes doubled, so that texts
come back exactly. The loss mask is a list of code point spans: the texts of assistants.

A conversation is one example and so one row. Conversations of up to `LONG` events are partitioned once, by
conversation; the events of longer ones are first folded by message, over all tasks, and only their final texts meet.

Defined results: null texts are empty, null roles are roles without a name, null conversations and turns are values of their own (turns: first); messages of
one turn come by role and text; equal rows are messages of their own; of events with equal sequence numbers the lesser kind, then the lesser text comes first;
an empty log has no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns

#: Events of a conversation from which on its messages are folded by themselves first.
LONG = 1024
#: Code points of a delta that a row's text is streamed in, and of the blocks that spans are cut from.
DELTA, BLOCK = 512, 4096
#: The control strings, this template's and others that models know.
CONTROL = ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, END = "<s>", "</s>\n"
LOSS = "assistant"


def escape(text: Column) -> Column:
    """Text without control strings; `unescape` gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _folded(events: Column) -> Column:
    """A message's text after its events, null if it was taken back. The last edit or regeneration starts it, the deltas after that follow."""
    resets = F.filter(F.sequence(F.lit(1), F.size(events)), lambda i: F.element_at(events, i)["kind"] != "delta")
    last = F.coalesce(F.array_max(resets), F.lit(0))
    begun = F.when(last == 0, F.lit("")).otherwise(F.coalesce(F.element_at(events, F.greatest(last, F.lit(1)))["text"], F.lit("")))
    kind = F.when(last > 0, F.element_at(events, F.greatest(last, F.lit(1)))["kind"])
    deltas = F.array_join(F.transform(F.slice(events, last + 1, F.size(events)), lambda e: F.coalesce(e["text"], F.lit(""))), "")
    gone = (kind == "remove") & (last == F.size(events))
    return F.when(~F.coalesce(gone, F.lit(False)), F.concat(F.when(F.coalesce(kind == "edit", F.lit(False)), begun).otherwise(F.lit("")), deltas))


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log (conv_id, turn, message, seq, kind, role, text)."""
    event = F.struct("seq", "kind", "text")
    grouped = log.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(event)).alias("events"), F.coalesce(F.max("role"), F.lit("")).alias("role"))
    return grouped.select("conv_id", "turn", "message", "role", _folded(F.col("events")).alias("text")).where("text IS NOT NULL")


def rendered_messages(final: DataFrame) -> DataFrame:
    """Messages with their piece of the formatted text, and start and end (code points, in the whole) of the text in it."""
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    cut = final.withColumns({"_head": head, "_body": escape(F.col("text"))})
    pieces = cut.select("conv_id", "turn", "message", "role", "text", F.concat("_head", "_body", F.lit(END)).alias("piece"), F.length("_head").cast("long").alias("_lead"), F.length("_body").cast("long").alias("_size"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + len(BEGIN) + F.col("_lead")
    return pieces.withColumn("start", start).withColumn("end", F.col("start") + F.col("_size")).drop("_lead", "_size")


def _joined(pieces: DataFrame) -> DataFrame:
    span = F.when(F.col("role") == LOSS, F.struct("start", "end"))
    rows = pieces.select("conv_id", F.struct("start", "piece", span.alias("span")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.concat(F.lit(BEGIN), F.array_join("x.piece", "")).alias("formatted"), F.filter("x.span", lambda s: s.isNotNull()).alias("loss"))


def format_log(log: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, formatted, loss): every conversation of a log as one text, with the spans (start, end) that a loss counts."""
    events = own_columns(log, **{c: c for c in ("conv_id", "turn", "message", "seq", "kind", "role", "text")})
    hot = materialize(events.groupBy("conv_id").count().where(F.col("count") > long).select(F.col("conv_id").alias("_conv")), "chat-long")  # its size is known when the joins are planned
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    if not hot.limit(1).count():
        return _joined(rendered_messages(messages(events.repartition("conv_id"))))
    short = events.join(hot, same, "left_anti").repartition("conv_id")
    return _joined(rendered_messages(messages(short))).unionByName(_joined(rendered_messages(messages(events.join(hot, same, "left_semi")))))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), "</s>\n")  # the last one is empty

    def turn(p: Column) -> Column:
        at = F.instr(p, "|>\n")
        return F.struct(unescape(F.substring(p, F.lit(3), at - 3)).alias("role"), unescape(F.substring(p, at + 3, F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under spans, as an array, unescaped. Spans are cut from blocks, so that long texts are not walked from their start for each."""
    blocks = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))

    def cut(held: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / BLOCK)
            near = F.array_join(F.slice(held, (first + 1).cast("int"), (F.floor(s["end"] / BLOCK) - first + 1).cast("int")), "")
            return unescape(F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

        return F.transform(spans, one)

    return F.element_at(F.transform(F.array(blocks), cut), 1)


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that ends in the given messages: texts stream in as deltas; some messages are drafted and edited, some generated twice."""
    rows = own_columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumns({"text": F.coalesce("text", F.lit("")), "message": F.monotonically_increasing_id()})
    kind = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn")), F.lit(4))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    chunks = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % DELTA), F.lit(0))
    streamed = F.transform(F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.lit(""))), lambda c, i: F.struct((i + 2).cast("long").alias("seq"), F.lit("delta").alias("kind"), c.alias("text")))
    first = F.substring("text", 1, 40)
    edited = F.array(event(0, "delta", first), event(1, "edit", F.col("text")))
    again = F.concat(F.array(event(0, "delta", first), event(1, "regenerate", F.lit(None).cast("string"))), streamed)
    events = F.when(kind == 1, edited).when(kind == 2, again).otherwise(streamed)
    return rows.select("conv_id", "turn", "message", "role", F.explode(events).alias("e")).select("conv_id", "turn", "message", "role", "e.*")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two texts are control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return own_columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe)


def digest_columns(formatted: DataFrame) -> DataFrame:
    """One row per conversation, all read back from its formatted text and mask."""
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss")), "").alias("said"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")
