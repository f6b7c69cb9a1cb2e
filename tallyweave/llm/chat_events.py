"""Chat reconstruction from event logs, then rendering.

Events of a conversation, ordered by ``seq``:

- ``start``       begins a message (``message_id``, ``role``)
- ``delta``       appends ``payload`` to it
- ``edit``        replaces its content so far by ``payload``
- ``regenerate``  empties it, and drops every message that began after it and before this event

Defined results: events redelivered as equal rows count once; equal ``seq`` are ordered by kind, then payload; a
message begins with its first event, whatever its kind; a null payload is empty, a null role ``unknown``; events
without conversation, message or seq are passed over; a conversation whose messages were all dropped renders as an
empty text; unknown kinds change nothing but still begin a message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import table

DELTA_CHARS = 48


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, role, content, first_seq, dropped): one shuffle, by conversation."""
    rows = events.select("conv_id", "seq", "kind", "message_id", "role", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.filter(F.col("conv_id").isNotNull() & F.col("message_id").isNotNull() & F.col("seq").isNotNull()).repartition("conv_id")
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), "payload")
    per_message = rows.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_set(event)).alias("log"),
        F.min("seq").alias("first_seq"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
    )
    resets = F.filter("log", lambda e: e["kind"].isin("edit", "regenerate"))
    last = F.when(F.size(resets) > 0, F.element_at(resets, -1))
    # what counts: a resetting edit's own payload and every delta after it
    kept = F.filter("log", lambda e: (e["kind"] == "delta") & (F.col("last").isNull() | (e > F.col("last"))) | (e["kind"] == "edit") & (e == F.col("last")))
    built = per_message.withColumn("last", last).withColumn("content", F.array_join(F.transform(kept, lambda e: e["payload"]), ""))
    regenerated = F.struct("first_seq", F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"])).alias("at"))
    message = F.struct("first_seq", "message_id", F.coalesce("role", F.lit("unknown")).alias("role"), "content")
    per_conv = built.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("all"), F.filter(F.collect_list(regenerated), lambda r: r["at"].isNotNull()).alias("cuts"))
    each = per_conv.select("conv_id", "cuts", F.explode("all").alias("m"))
    dropped = F.exists("cuts", lambda r: (r["first_seq"] < F.col("m.first_seq")) & (F.col("m.first_seq") < r["at"]))
    return each.select("conv_id", "m.message_id", "m.role", "m.content", "m.first_seq", dropped.alias("dropped"))


def rendered(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_dropped, chat): the surviving messages in order, each between role markers."""
    m = messages(events)
    turn = F.struct("first_seq", "message_id", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "content", F.lit("<|im_end|>\n")).alias("turn"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("dropped"), turn)))
    return m.groupBy("conv_id").agg(
        F.count_if(~F.col("dropped")).alias("n_messages"),
        F.count_if("dropped").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda t: t["turn"]), "").alias("chat"),
    )


def conversation_log(turns: DataFrame) -> DataFrame:
    """An event log that ends in the given turns: text in deltas, some of it first drafted, edited or regenerated.

    Turn t has the seqs from t * 10**7. Every third conversation has a later message that a regeneration of its first
    turn's successor takes back; every fifth turn has a draft that is edited away, every seventh one that is regenerated.
    """
    t = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    base = F.col("turn") * 10_000_000
    mark = F.col("conv_id") + F.col("turn")
    chars = F.char_length("text")
    size = F.lit(DELTA_CHARS)

    def event(seq, kind, payload):  # noqa: ANN001, ANN202
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))

    draft = F.concat(F.lit("draft "), F.substring("text", 1, 20))
    pieces = F.when(
        chars > 0,
        F.transform(F.sequence(F.lit(0), F.ceil(chars / size).cast("int") - 1), lambda k: event(base + 10 + k, "delta", F.substring(F.col("text"), k * size + 1, size))),
    ).otherwise(F.array())
    log = F.concat(
        F.array(event(base, "start", F.lit(None))),
        F.when(mark % 5 == 0, F.array(event(base + 1, "delta", draft), event(base + 2, "edit", F.lit("")))).otherwise(F.array()),
        F.when(mark % 7 == 0, F.array(event(base + 3, "delta", draft), event(base + 4, "regenerate", F.lit(None)))).otherwise(F.array()),
        pieces,
    )
    own = t.select("conv_id", F.col("turn").alias("message_id"), "role", F.explode(log).alias("e"))
    end = t.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text")).filter("conv_id % 3 = 0")
    late = F.array(
        F.struct((F.col("turn") + 1000).alias("message_id"), F.lit("user").alias("role"), event(base + 9_000_000, "start", F.lit(None)).alias("e")),
        F.struct((F.col("turn") + 1000).alias("message_id"), F.lit("user").alias("role"), event(base + 9_000_001, "delta", F.lit("never mind")).alias("e")),
        F.struct(F.col("turn").alias("message_id"), F.col("role").alias("role"), event(base + 9_000_002, "regenerate", F.lit(None)).alias("e")),
        F.struct(F.col("turn").alias("message_id"), F.col("role").alias("role"), event(base + 9_000_003, "delta", F.col("text")).alias("e")),
    )
    after = end.select("conv_id", F.explode(late).alias("x")).select("conv_id", "x.message_id", "x.role", "x.e")
    return own.unionByName(after).select("conv_id", "e.seq", "e.kind", "message_id", "role", "e.payload")


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(conversation_log(table(spark, sf_dir, "conversations")))


OP8_SQL = """
SELECT conv_id, count(*) AS n_messages, (CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
"""
