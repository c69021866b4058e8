"""Chat writes as table operations: a log of writes applied to conversations and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a title that are kept, and the roles of messages.
TITLE, ROLES = 200, ("user", "assistant", "system")


def applied(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages after a log of writes (seq, at, kind, conv_id, message_id, role, content, title).

    Kinds: create, rename, message, verify (``content`` is the check of ``message_id``), delete. A conversation begins
    with the first create after its last delete; creating one that is there does nothing, nor does a message that is there
    already or has a role that is none of ``ROLES``, so a log may be applied again. Its title is that of its create or the
    last one given since, cut to ``TITLE`` characters; it is updated by its create and its last rename or message;
    deleting one takes its messages along. Writes to a conversation that is not there do nothing. Each is a count or a
    last value by key, so tasks combine before anything is shuffled.
    """
    gone = log.where("kind = 'delete'").groupBy("conv_id").agg(F.max("seq").alias("gone"))
    made = log.where("kind = 'create'").select("conv_id", "seq").join(gone, "conv_id", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    alive = made.groupBy("conv_id").agg(F.min("seq").alias("since"))
    rows = log.where("kind <> 'delete'").join(alive, "conv_id").where((F.col("seq") == F.col("since")) | (F.col("seq") > F.col("since")) & (F.col("kind") != "create"))
    rows = rows.where((F.col("kind") != "message") | F.col("role").isin(*ROLES))
    first = rows.where("kind = 'message'").groupBy("conv_id", "message_id").agg(F.min("seq").alias("seq"))
    rows = rows.where("kind <> 'message'").unionByName(rows.where("kind = 'message'").join(first, ["conv_id", "message_id", "seq"]))
    titled = F.col("kind").isin("create", "rename") & F.col("title").isNotNull()
    conversations = rows.groupBy("conv_id").agg(
        F.coalesce(F.nullif(F.max_by(F.left("title", F.lit(TITLE)), F.when(titled, F.col("seq"))), F.lit("")), F.lit("New chat")).alias("title"),
        F.max(F.when(F.col("kind") != "verify", F.col("at"))).alias("updated_at"), F.sum((F.col("kind") == "message").cast("long")).alias("n_messages"),
    )
    checks = rows.where("kind = 'verify'").groupBy("conv_id", "message_id").agg(F.max_by("content", "seq").alias("verification"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "seq"))
    messages = rows.where("kind = 'message'").select("conv_id", "message_id", place.alias("place"), "role", "content")
    return conversations, messages.join(checks, ["conv_id", "message_id"], "left").withColumn("verification", F.coalesce("verification", F.lit("{}")))


def saved_settings(rows: DataFrame) -> DataFrame:
    """(key, scope, project, value) after writes (seq, key, scope, project, value): the last of each key, scope and project."""
    return rows.groupBy("key", "scope", "project").agg(F.max_by("value", "seq").alias("value"))
