"""Chat formatting: event logs folded into final messages, rendered with a reversible template.

Template, one chunk a message: `<s>[INST] role [/INST]` newline, text, `</s>` newline. Inside a role or
a text every backslash is doubled and every control string (`<s>`, `</s>`, `[INST]`, `[/INST]`) gets a
backslash after its first character, so none is left in it; removing one backslash of each pair
restores the text. Loss falls on the texts of assistant messages.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(c, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, opened, msg, role, text) of events (conv_id, seq, kind, msg, role, text).

    In seq order, kind `message` opens message msg; `delta` appends to it; `edit` replaces what it holds
    so far; `regenerate` empties it and withdraws every message opened after it and before this event.
    Events of a message that is not open are ignored, as are other kinds; a second `message` for an open
    msg starts it again in its place. `opened` is a message's first seq, its rank in the conversation.
    Window functions over the conversation, which Spark sorts and spills: only a message, never a whole
    conversation, is held at once. One shuffle, on conv_id.
    """
    e = events.where(F.col("conv_id").isNotNull() & F.col("kind").isin("message", "delta", "edit", "regenerate")).select("conv_id", "seq", "kind", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of = Window.partitionBy("conv_id", "msg")
    so_far = of.orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("opened", F.min(F.when(F.col("kind") == "message", F.col("seq"))).over(so_far)).where("opened is not null")
    e = e.withColumn("role", F.last(F.when(F.col("kind") == "message", F.col("role")), True).over(so_far))
    e = e.withColumn("reset", F.count(F.when(F.col("kind") != "delta", 1)).over(so_far))
    e = e.withColumn("back", F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later))
    # withdrawn: a regenerate after this message opened goes back to an older one
    gone = F.max(F.when((F.col("kind") == "message") & (F.col("seq") == F.col("opened")) & (F.col("back") < F.col("opened")), True)).over(of)
    e = e.withColumn("gone", gone).withColumn("resets", F.max("reset").over(of)).where("gone is null and reset = resets")
    part = F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    m = e.groupBy("conv_id", "opened", "msg").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(part)).alias("parts"))
    return m.select("conv_id", "opened", "msg", "role", F.concat_ws("", F.transform("parts", lambda x: x["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, chunk) in order within each partition: a conversation's chunks, end to end, are its
    formatted text. Dealt by conv_id, which is free after `fold_events`."""
    chunk = F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST]\n"), escape(F.col("text")), F.lit("</s>\n"))
    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "opened", "msg").select("conv_id", chunk.alias("chunk"))


def digest(rendered: DataFrame) -> DataFrame:
    """Read back from the formatted text: one row a conversation. A stream over each partition's
    sorted chunks; what is held is one message and two running hashes."""

    def read(batches):
        conv, state, out = None, None, []

        def done():
            return (conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        for batch in batches:
            for c, chunk in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state:
                        out.append(done())
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "loss_chars": 0}
                role, text = (_ESCAPED.sub(r"\1", x) for x in _CHUNK.fullmatch(chunk).groups())
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["chars"] += len(chunk)
                if role == "assistant":
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
            if out:
                yield _digests(out)
                out = []
        if state:
            yield _digests([done()])

    return rendered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id and formatted, the whole text with its loss spans: (start, length) in code points of the
    escaped assistant texts. For conversations that fit one row."""
    m = fold_events(events).select("conv_id", "opened", "msg", "role", F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST]\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("opened", "msg", "role", "head", "body"))).alias("t"))
    text = F.concat_ws("", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit("</s>\n"))))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + 5).alias("at"),
            F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return rows.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log: one `message` a row, in turn order (ties by role, then text)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.where("conv_id is not null").select("conv_id", F.row_number().over(w).cast("long").alias("seq"), F.lit("message").alias("kind"), F.row_number().over(w).cast("long").alias("msg"), "role", "text")


def op4_chat_format(spark, sf_dir) -> DataFrame:
    """All conversations and the planted one, -7. Turns that the table itself has under that number are turns of the same conversation: all
    stand in order of turn, then role, then text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(render(fold_events(as_events(rows.unionByName(own)))))


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS et,
  regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS er FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 10 + 9 + 5) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
