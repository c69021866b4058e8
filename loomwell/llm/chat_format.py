r"""Chat formatting with typed content parts.

A turn is an array of parts, each of a kind: ``text``, ``image``, ``audio`` or ``document``. A visitor (one branch a
kind, see ``visit``) flattens the parts in order: a text part gives its escaped text, any other kind gives a
placeholder such as ``<|image|>``, an attachment reference, and the number of tokens that the placeholder stands for.
The k-th placeholder of a conversation belongs to the k-th attachment.

A formatted turn is ``<|turn|>role<|body|>content<|end|>``. All control strings begin with ``<|``. Inside texts and
roles every ``<``, any number of backslashes, ``|`` gets one backslash more, so no text can hold a control string, and
taking one backslash away gives the text back. The loss mask is kept as segments: the formatted text is the
concatenation of the segments' texts, and the flag ``loss`` is set on assistant text only.

Turns are first put together in blocks of 64 turn numbers and the blocks then by conversation, so that a task that
ends a conversation gets few rows even for a very long one. Built-in functions only.

Defined results: a null text or role is an empty one; a null part, or one of unknown kind, gives nothing; turns are
ordered by (turn, role, content), a null turn first, so ties and repeated rows have one order and all stay; rows with
a null ``conv_id`` form one conversation; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import table

#: Turn numbers in a block.
BLOCK = 64
#: Tokens for which a placeholder stands: an image has one for each 28 x 28 tile, audio 25 a second, a document 1024 a page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
ATTACHMENT = "struct<kind:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def visit(part: Column) -> Column:
    """One part as struct(text, is_text, attachment)."""
    cost = {
        "image": F.ceil(_or0(part["width"]) / TILE) * F.ceil(_or0(part["height"]) / TILE),
        "audio": F.ceil(_or0(part["seconds"]) * AUDIO_RATE),
        "document": _or0(part["pages"]) * PAGE_TOKENS,
    }
    seen = F.when(
        part["kind"] == "text",
        F.struct(escape(F.coalesce(part["text"], F.lit(""))).alias("text"), F.lit(True).alias("is_text"), F.lit(None).cast(ATTACHMENT).alias("attachment")),
    )
    for kind, tokens in cost.items():
        attachment = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.greatest(F.lit(1), tokens).cast("bigint").alias("tokens"))
        seen = seen.when(part["kind"] == kind, F.struct(F.lit(f"<|{kind}|>").alias("text"), F.lit(False).alias("is_text"), attachment.alias("attachment")))
    return seen


def text_parts(text: Column) -> Column:
    """Parts of a turn that has only text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint")))))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, segments, attachments, formatted, n_attachment_tokens)."""
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(F.transform("parts", visit), lambda p: p.isNotNull()).alias("seen"))
    role, assistant = escape(F.col("role")), F.col("role") == "assistant"
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    formatted = seen.select(
        "conv_id",
        "turn",
        "role",
        F.concat(
            F.array(segment(F.concat(F.lit("<|turn|>"), role, F.lit("<|body|>")), F.lit(False))),
            F.transform(F.coalesce("seen", F.array()), lambda p: segment(p["text"], assistant & p["is_text"])),
            F.array(segment(F.lit("<|end|>"), F.lit(False))),
        ).alias("segments"),
        F.transform(F.filter(F.coalesce("seen", F.array()), lambda p: p["attachment"].isNotNull()), lambda p: p["attachment"]).alias("attachments"),
    )
    joined = lambda name: F.flatten(F.transform("got", lambda t: t[name])).alias(name)
    blocks = (
        formatted.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "segments", "attachments"))).alias("got"))
        .select("conv_id", "block", joined("segments"), joined("attachments"))
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "segments", "attachments"))).alias("got")).select("conv_id", joined("segments"), joined("attachments"))
    return whole.select(
        "*",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The formatted text back as array<struct<role, text>>; placeholders stay in the text as they are."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p.startswith("<|turn|>"))
    body = lambda p: F.split(F.substring(p, 9, 2147483647), r"<\|body\|>", 2)
    return F.transform(F.transform(pieces, body), lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and conversation -1, whose texts look like control strings."""
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = {
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS erole, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>' || erole || '<|body|>' || etext || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
QUERIES = {"op4_chat_format": op4_chat_format}
