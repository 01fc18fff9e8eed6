"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds one event a row: conversation, sequence number, kind, message id,
role, text. Events of a conversation are sorted by sequence number (ties: by
role, text, kind, then message id) and folded into final messages:

* ``message``     opens a message (a null or unknown kind does so too),
* ``delta``       appends its text to the message,
* ``edit``        replaces what the message has so far,
* ``regenerate``  empties the message; later deltas build it anew.

An event with a message id belongs to the first message that was opened under
that id, however many others were opened since; one without an id, or with an
id that opened nothing, belongs to the message opened last.
Events before any ``message`` open one with their own role. Then each message
is rendered as ``<s>[INST] role [/INST]text</s>``. Inside roles and texts ``&``,
``<`` and ``[`` are written as entities, so no control string can occur there,
and reading back is exact for every text.

Defined results: null texts and roles are empty; repeated rows are turns of
their own; a null conversation id is one conversation; an empty log gives no
rows. A rendered conversation is one value of one row, so one conversation must
fit in a task; different conversations never meet in a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table

OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: What is escaped, and as what; ``&`` first when writing, last when reading.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def fold(log: DataFrame) -> DataFrame:
    """Messages (conv, ord, role, text) of a log (conv, seq, kind, message, role, text); a log may lack ``message``."""
    rows = log.select(
        "conv",
        "seq",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message").alias("kind"),
        (F.col("message").cast("string") if "message" in log.columns else F.lit(None).cast("string")).alias("message"),
    )
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy("seq", "role", "text", "kind", "message")))
    opens = F.when(F.col("kind") == "message", F.col("at"))
    last = F.coalesce(F.max(opens).over(Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    named = F.when((F.col("kind") != "message") & F.col("message").isNotNull(), F.min(opens).over(Window.partitionBy("conv", "message")))
    rows = rows.withColumns({"last": last, "named": named}).withColumn("ord", F.coalesce("named", "last"))
    messages = rows.groupBy("conv", "ord").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("events"))
    # only what follows the last edit or regeneration of a message is in it
    reset = F.coalesce(F.array_max(F.transform(F.filter("events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["at"])), F.lit(0))
    messages = messages.withColumn("reset", reset)
    kept = F.filter("events", lambda e: (e["at"] >= F.col("reset")) & (e["kind"] != "regenerate"))
    return messages.select("conv", "ord", F.col("events")[0]["role"].alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def streamed(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv, turn, role, text) as a chat service would have written it.

    An assistant's turn begins with a draft that is thrown away, then its text
    comes in three deltas; any other turn is opened with a draft, which an edit
    corrects only after the next turn has been opened.
    """
    at = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    rows = turns.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("message", at)
    text, draft, third = F.col("text"), F.reverse("text"), F.ceil(F.char_length("text") / 3).cast("int")
    event = lambda step, kind, said: F.struct((F.col("message") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))
    part = lambda i: F.substring(text, third * i + 1, third)
    spoken = F.array(event(0, "message", draft), event(1, "regenerate", F.lit("")), *(event(i + 2, "delta", part(i)) for i in range(3)))
    written = F.array(event(0, "message", draft), event(9, "edit", text))
    return rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", spoken).otherwise(written))).select("conv", "e.seq", "e.kind", "message", "role", F.col("e.said").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv, formatted, loss_spans): one row per conversation; the spans are the assistants' texts in code points of ``formatted``."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(ROLE_END))
    turns = messages.withColumn("body", escaped(F.col("text"))).withColumn("head", head)
    before = Window.partitionBy("conv").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + F.lit(len(CLOSE))
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("start", start).withColumn("end", start + F.char_length("body"))
    listed = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ord", "head", "body", "start", "end", (F.col("role") == "assistant").alias("loss")))).alias("t"))
    return listed.select(
        "conv",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a rendered conversation holds."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r" \[/INST\]", 2))
    return F.transform(cut, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text that the loss spans cover, unescaped."""
    return F.array_join(F.transform(spans, lambda x: unescaped(F.substr(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")


def op10_chat(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = render(fold(streamed(turns.unionByName(probe)))).withColumn("turns", read_back(F.col("formatted")))
    out = out.withColumn("loss", under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS erole,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS etext FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(22 + length(erole) + length(etext))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
