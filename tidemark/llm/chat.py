r"""Chat formatting of turns with typed content parts.

A message's content is an array of parts, each a text, an image, an audio clip or a document. A visitor
flattens them in order: texts are escaped, every other part leaves a placeholder, and what it refers to is
recorded with the number of tokens that the placeholder will take once expanded.

A turn is `<|turn|>role<|says|>body<|end|>` and a line feed. Inside roles and texts, `\` is doubled and a `\`
goes behind the first character of any control string, ours or another template's; so no text can close a
turn, open one or fake a placeholder, and unescape() gives back the very text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
#: First characters of control strings, each before the rest of one.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
#: Pixels on a side of an image's patch, an audio clip's tokens for each second, and a page's tokens.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType()),
])


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    values = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields)))


def expanded(part: Column) -> Column:
    """Tokens of a placeholder: a part whose size is unknown takes one."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    size = F.when(part["type"] == "image", patches).when(part["type"] == "audio", F.ceil(part["seconds"] * PER_SECOND)).when(part["type"] == "document", part["pages"].cast("long") * PER_PAGE)
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def visit(content: Column) -> tuple[Column, Column]:
    """The flat body, and what its placeholders stand for in order: (kind, uri, tokens). Null parts, and null content, give nothing."""
    parts = F.filter(F.coalesce(content, F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise(F.lit("other"))
    body = F.array_join(F.transform(parts, lambda p: F.when(is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))), "")
    attached = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(kind(p).alias("kind"), p["uri"].alias("uri"), expanded(p).alias("tokens")))
    return body, attached


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each conv_id of turns(conv_id, turn, role, content): formatted, loss_spans (code points, from and
    before, of each trained turn's body), attachments and placeholder_tokens.

    Turns go by `turn`, nulls first; ties by role and body. A null role is empty; a null conv_id is a conversation
    of its own. Repeated rows are turns each. An empty table gives no rows; other columns are not read. A
    conversation is one row of output, so it must fit a task, as its text must.
    """
    body, attached = visit(F.col("content"))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), attached.alias("attached"))
    said = said.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS)))
    size = F.length("head") + F.length("body") + len(CLOSE)
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.xxhash64("attached"))
    said = said.withColumn("n", F.row_number().over(by)).withColumn("at", (F.sum(size.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head")).cast("long"))
    row = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("role") == trained, F.struct(F.col("at").alias("from"), (F.col("at") + F.length("body")).alias("before"))).alias("span"), "attached")
    listed = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select(
        "conv_id",
        F.array_join(F.col("rows")["turn"], "").alias("formatted"),
        F.filter(F.col("rows")["span"], lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("rows")["attached"]).alias("attachments"),
        F.aggregate(F.flatten(F.col("rows")["attached"]), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("placeholder_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds; placeholders stay as they are in text."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda t: F.substring_index(F.substring(t, F.lit(len(OPEN) + 1), F.length(t)), SAYS, 1)
    text = lambda t: F.substring(t, F.length(F.substring_index(t, SAYS, 1)) + len(SAYS) + 1, F.length(t))
    return F.transform(turns, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(text(t)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["from"] + 1).cast("int"), (s["before"] - s["from"]).cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from each formatted conversation, as counts and SHA-256."""
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: What op2's query returns over conversations and conversation -1, for DuckDB.
DIGESTS_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS body,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS name FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(name) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
