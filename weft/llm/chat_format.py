"""Chat formatting from event logs, with DataFrame functions only.

Events of a conversation, in order of seq, act on messages, which are ordered by turn:

    message     the message's role and whole text (replaces what it had)
    delta       a streamed piece of text to append
    edit        new text in place of what the message has; its role stays, whatever role the event has
    regenerate  drops the text so far; later deltas make the new one

A rendered turn is <s>[INST]role[/INST]text</s>. In roles and texts a backslash is put before every backslash and inside
every control string, so control strings occur only as marks and texts come back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, HEADER, END = "<s>[INST]", "[/INST]", "</s>"
#: A backslash, or a control string after its first character.
ESCAPED = r"\\|(?<=<)/?s>|(?<=\[)/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, kind, turn, role, text) to final messages (conv_id, turn, first_seq, role, text).

    A message is what one conv_id and turn name. Its text is that of its last message, edit or regenerate event and the deltas
    after it; its role that of its last message, delta or regenerate event with one, empty if there is none. Events of equal
    seq come in order of kind, then text; repeated deliveries of one event count once. Null texts are empty, null kinds and
    unknown ones have no effect. Null ids and turns are keys like others; other columns are not read; no events, no messages.
    One message is folded in one task, so its events and its text must fit there.
    """
    one = Window.partitionBy("conv_id", "turn")
    resets = F.col("kind").isin("message", "edit", "regenerate")
    rows = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["conv_id", "turn", "seq", "kind", "role", "text"])
    order = F.struct("seq", "kind", "text")
    marked = rows.withColumn("reset", F.max(F.when(resets, order)).over(one))
    adds = F.col("kind").isin("message", "edit", "delta") & (F.col("reset").isNull() | (order >= F.col("reset")))
    piece = F.struct("seq", "kind", "text")
    folded = marked.groupBy("conv_id", "turn").agg(
        F.min("seq").alias("first_seq"),
        F.max_by("role", F.when(F.col("role").isNotNull() & F.col("kind").isin("message", "delta", "regenerate"), F.struct("seq", "kind", "role"))).alias("role"),
        F.sort_array(F.collect_list(F.when(adds, piece))).alias("pieces"),
    )
    return folded.select("conv_id", "turn", "first_seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points of formatted, over texts of trained roles).

    Turns in order of turn, then first_seq; offsets are running sums within the conversation, so no array is grown turn by turn.
    """
    ordered = Window.partitionBy("conv_id").orderBy("turn", "first_seq")
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(HEADER))
    rows = messages.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("turn_text", F.concat("head", "body", F.lit(END))).withColumn("at", F.row_number().over(ordered))
    before = F.sum(F.char_length("turn_text").cast("long")).over(ordered) - F.char_length("turn_text")
    rows = rows.withColumn("start", before + F.char_length("head"))
    span = F.when(F.col("role").isin(*trained), F.struct(F.col("start"), F.char_length("body").cast("long").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn_text"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (texts under the mask), all from formatted and loss_spans."""
    marks = F.split("formatted", r"<s>\[INST\]", -1)
    turns = F.transform(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), _turn)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def _turn(part: Column) -> Column:
    parts = F.split(part, r"\[/INST\]", 2)
    return F.struct(unescape(parts[0]).alias("role"), unescape(F.regexp_replace(parts[1], r"</s>\z", "")).alias("text"))


def event_log(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text) as the log of a chat service that ends with these messages.

    An assistant's message opens empty, streams a draft, is regenerated and streams its text in two deltas. Any other one is
    sent as a draft, its first half, and edited to its whole text.
    """

    def event(step: int, kind: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    role, text, none = F.col("role"), F.col("text"), F.lit(None).cast("string")
    half = F.ceil(F.char_length(text) / 2).cast("int")
    front, back = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    streamed = F.array(event(0, "message", none, role), event(1, "delta", F.substring(text, 1, 8)), event(2, "regenerate", none), event(3, "delta", front), event(4, "delta", back))
    edited = F.array(event(0, "message", front, role), event(1, "edit", text))
    events = rows.withColumn("e", F.explode(F.when(role == "assistant", streamed).otherwise(edited)))
    return events.select("conv_id", F.col("place").alias("turn"), (F.col("place") * 8 + F.col("e.step")).alias("seq"), "e.kind", "e.role", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as an event log of drafts, edits, regenerations and deltas, folded, rendered and read back.

    Every row is a turn: rows of one turn, repeated ones too, come in order of role, then text. Null texts and roles are empty.
    Null turns come first; a null conv_id is a conversation of its own. No rows, no conversations; other columns are not read.
    Texts may be of any length as long as a conversation, which is one string in the end, fits a task and Spark's 2 GB.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    return read_back(render(fold_events(event_log(placed))))
