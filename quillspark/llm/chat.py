r"""Chat formatting: event-sourced reconstruction of conversations (native).

A log of events is partitioned by message and conversation, sorted by sequence and
folded: streamed deltas extend a message, an edit replaces what it says, a
regeneration starts it anew. The final messages are rendered as

    ### role: text</turn>\n

Inside texts and roles a backslash is doubled and a backslash breaks up control
strings (``###`` becomes ``#\#\#``, ``</turn>`` becomes ``<\/turn>``), so markers stand
only where the template put them; dropping single backslashes undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import with_starts

TURN_END = "</turn>\n"
#: Events that say a message from the start; a delta extends what was said.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\)|(#)(?=##)|(<)(?=/turn>)", r"$1$2$3\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)?", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log.

    ``events``: conv_id, message_id, turn, seq, kind (message, delta, edit or regenerate),
    role, text. A message says the text of its last message, edit or regenerate event and
    of the deltas after it, in order of seq (null first; ties by kind, role, text). Its
    turn and role are those of its first event that has one; null texts count as empty, and
    unknown kinds are ignored. Returns conv_id, message_id, turn, role, text, n_events.

    Events are brought together by message, not by conversation, so a conversation that
    holds a third of the log is still spread over many tasks.
    """
    known = events.filter(F.col("kind").isin("delta", *RESETS))
    event = F.struct("seq", (F.col("kind") == "delta").alias("adds"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"), "turn")
    log = known.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.greatest(F.array_max(F.transform("log", lambda e, i: F.when(~e["adds"], i))), F.lit(0))
    return log.select(
        "conv_id",
        "message_id",
        F.get(F.filter(F.col("log.turn"), F.isnotnull), F.lit(0)).alias("turn"),
        F.get(F.filter(F.col("log.role"), F.isnotnull), F.lit(0)).alias("role"),
        F.array_join(F.slice(F.col("log.text"), F.coalesce(last, F.lit(0)) + 1, F.size("log")), "").alias("text"),
        F.size("log").cast("long").alias("n_events"),
    )


def render(messages: DataFrame, chunk_turns: int = 256) -> DataFrame:
    """Rendered conversations with their loss masks.

    ``messages``: conv_id, turn, role, text. Messages go by turn (null first; ties by
    role, then text). Returns conv_id, n_turns, formatted, and turns: for each turn start,
    end, loss_start and loss_end, as code points of ``formatted``. The loss mask covers just
    the text of assistant turns; elsewhere it is empty (loss_start = loss_end).

    Turns are first joined by runs of ``chunk_turns`` turn numbers, then the runs by
    conversation, so that a very long one is mostly put together by many tasks.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit("### "), F.regexp_replace(escape(role), ":", r"\\:"), F.lit(": "))
    said = escape(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "turn", role.alias("role"), "text", head.alias("head"), said.alias("said"))
    turns = turns.withColumn("shown", F.concat("head", "said", F.lit(TURN_END)))
    turn = F.struct("turn", "role", "text", "shown", F.length("head").alias("head_n"), F.length("said").alias("said_n"), F.length("shown").alias("n"), (F.col("role") == "assistant").alias("loss"))
    chunks = turns.groupBy("conv_id", F.floor(F.col("turn") / chunk_turns).alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    chunks = with_starts(chunks.withColumn("lengths", F.transform("t", lambda t: t["n"].cast("bigint"))), "lengths", "begins")

    def spot(t: Column, begin: Column) -> Column:
        at = begin + t["head_n"]
        return F.struct(begin.alias("start"), (begin + t["n"]).alias("end"), at.alias("loss_start"), (at + F.when(t["loss"], t["said_n"]).otherwise(0)).alias("loss_end"))

    shown = F.array_join(F.col("t.shown"), "")
    chunks = chunks.select("conv_id", F.struct("chunk", shown.alias("shown"), F.length(shown).cast("bigint").alias("n"), F.zip_with("t", "begins", spot).alias("spots")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    whole = with_starts(whole.withColumn("lengths", F.col("c.n")), "lengths", "begins")

    def shift(c: Column, base: Column) -> Column:
        return F.transform(c["spots"], lambda x: F.struct(*((x[k] + base).alias(k) for k in ("start", "end", "loss_start", "loss_end"))))

    spots = F.flatten(F.zip_with("c", "begins", shift))
    return whole.select("conv_id", F.array_join(F.col("c.shown"), "").alias("formatted"), spots.alias("turns")).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "turns")


def read_back(rendered: DataFrame) -> DataFrame:
    """What ``render`` wrote, read from ``formatted`` alone: adds messages (role, text) and loss_text.

    ``loss_text`` is the unescaped text under the loss mask.
    """
    pieces = F.split("formatted", TURN_END)
    cut = rendered.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    pattern = r"(?s)^### ((?:[^:\\]|\\.)*+): (.*)$"
    messages = F.transform("pieces", lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))
    masked = F.zip_with("pieces", "turns", lambda p, t: unescape(F.substring(p, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))))
    return cut.select(*rendered.columns, messages.alias("messages"), F.array_join(masked, "").alias("loss_text"))


#: Characters of a streamed delta, and of a draft that is taken back.
DELTA_CHARS, DRAFT_CHARS = 200, 12


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of turns, as it would have come about.

    Each row opens a message with a draft (its end, turned round). A user's draft is edited
    and an assistant's regenerated; then the text is streamed in deltas of DELTA_CHARS. Only a fold in
    order of seq gives the text back.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"))
    event = lambda seq, kind, text: F.struct(seq.cast("long").alias("seq"), kind.alias("kind"), text.alias("text"))
    draft = F.reverse(F.right("text", F.lit(DRAFT_CHARS)))
    reset = F.when(F.coalesce("role", F.lit("")) == "assistant", "regenerate").otherwise("edit")
    first = F.array(event(F.lit(0), F.lit("message"), F.lit("")), event(F.lit(1), F.lit("delta"), draft), event(F.lit(2), reset, F.lit("")))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / DELTA_CHARS) - 1, F.lit(0)).cast("int"))
    deltas = F.transform(pieces, lambda i: event(i + 3, F.lit("delta"), F.substring("text", i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    return rows.select("conv_id", "message_id", "turn", "role", F.explode(F.concat(first, deltas)).alias("e")).select("conv_id", "message_id", "turn", "e.seq", "e.kind", "role", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Fold, render and read back a table of turns (conv_id, turn, role, text).

    Every row is a turn, repeated rows too; a null conv_id is a conversation, a null role
    counts as empty, a null text as empty. An empty table gives an empty result.
    """
    return read_back(render(fold_events(conversation_events(conversations))))
