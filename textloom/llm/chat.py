"""Chat formatting: conversations rebuilt from an event log, then rendered. DataFrame functions only.

Events of a conversation are ordered by sequence number and folded into messages:

* ``message`` (also a null kind) opens a message with its text, or restarts it;
* ``delta`` appends its text to the message;
* ``edit`` replaces the message's text;
* ``regenerate`` discards the message's text (its own text, if any, begins the new one).

An edit or a regeneration also drops the messages that had followed the one it changes. Events
without a message id are messages of their own.

Rendered turns are ``<s>role\\ntext </s>`` for the assistant and
``<s>role\\n[INST] text [/INST]`` for others. A backslash is put before each control string in a
text (and before the backslashes that already stand there), which ``unescape`` takes away;
``%``, ``<``, ``[`` and line ends of roles are percent-coded.

Edge cases: null texts and roles are empty; a null sequence number sorts first; ties are ordered
by role, then text; repeated rows are turns of their own; rows with a null conversation id form
one conversation; an empty table gives an empty result; other columns of the input are ignored,
whatever their names. One conversation is one output value,
so it must fit a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.rows import quoted

CONTROLS = r"(?:</?s>|\[/?INST\])"
TURN = r"(?s)<s>([^\n]*)\n(\[INST\] )?(.*?) (?:</s>|\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROLS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROLS})", "$1$2")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def fold(events: DataFrame, *, conversation: str = "conv_id", sequence: str = "seq", role: str = "role", text: str = "text", kind: str | None = None, message: str | None = None) -> DataFrame:
    """Final messages: ``conv``, ``at`` (order within the conversation), ``role``, ``text``."""
    e = events.select(
        F.col(quoted(conversation)).alias("conv"),
        F.col(quoted(sequence)).alias("seq"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"),
        (F.coalesce(F.col(quoted(kind)), F.lit("message")) if kind else F.lit("message")).alias("kind"),
        (F.col(quoted(message)).cast("string") if message else F.lit(None).cast("string")).alias("message"),
    )
    order = Window.partitionBy("conv").orderBy("seq", "role", "text")
    e = e.withColumn("n", F.row_number().over(order).cast("long"))
    e = e.withColumn("key", F.coalesce(F.concat(F.lit("m"), "message"), F.concat(F.lit("#"), F.col("n").cast("string"))))
    own = Window.partitionBy("conv", "key")
    e = e.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(own))
    parts = F.array_sort(F.collect_list(F.when(F.col("n") >= F.coalesce("reset", F.lit(0)), F.struct("n", "text"))))
    changed = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("n")))
    messages = e.groupBy("conv", "key").agg(F.min("n").alias("at"), F.min_by("role", "n").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), changed.alias("changed"))
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("cut", F.max("changed").over(before))
    return messages.where(F.col("cut").isNull() | (F.col("cut") < F.col("at"))).select("conv", "at", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """``conv``, ``formatted`` and ``loss`` (code-point ranges of the assistant's escaped texts)."""
    mine = F.col("role") == "assistant"
    head = F.concat(F.lit("<s>"), escape_role(F.col("role")), F.when(mine, F.lit("\n")).otherwise(F.lit("\n[INST] ")))
    m = messages.select("conv", "at", mine.alias("mine"), head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.select("conv", "at", "mine", F.char_length("head").alias("skip"), F.char_length("body").alias("size"), F.concat("head", "body", F.when(F.col("mine"), F.lit(" </s>")).otherwise(F.lit(" [/INST]"))).alias("turn"))
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.col("skip")
    m = m.withColumn("start", start)
    turns = F.array_sort(F.collect_list(F.struct("at", "turn")))
    loss = F.array_sort(F.collect_list(F.when(F.col("mine"), F.struct("start", (F.col("start") + F.col("size")).alias("end")))))
    return m.groupBy("conv").agg(F.array_join(F.transform(turns, lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of ``role`` and ``text``."""
    roles, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(i)) for i in (1, 3))
    return F.zip_with(roles, bodies, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
