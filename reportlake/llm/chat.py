"""Chat formatting with typed content parts.

A message holds typed parts: text, image, audio or document. A visitor, one CASE over the kind of a part,
turns each into its piece of the output in order: escaped text, or a placeholder that stands for an attachment.
Attachments are recorded in the same order with their turn, reference and expanded token count, so the n-th
placeholder belongs to the n-th attachment. DataFrame operations only.

The template is `<|begin|>` then, for each turn, `<|turn|>ROLE<|text|>BODY<|stop|>`, then `<|end|>`. Inside roles
and texts `&`, `<` and `[` become `&amp;`, `&lt;` and `&lsqb;`, so neither this template's control strings nor
any other that starts with `<` or `[` survives in a text, and unescaping gives the text back exactly. read_parts() gives the
typed parts of a body back: a placeholder is a part, the same characters in a text are text.

Defined results: a null text or null parts give an empty body, a null role an empty role; turns go by turn
number, null first, then role, then body; repeated rows are turns of their own; null conv_ids form one conversation.
Other columns are ignored. An empty table gives an empty result. A part of an unknown kind, or of none, is
flattened to its text.
One conversation becomes one string, so a conversation is as large as a row may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, TURN, TEXT, STOP, END = "<|begin|>", "<|turn|>", "<|text|>", "<|stop|>", "<|end|>"
#: Type of a message's parts.
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that an attachment expands to: an image a token for each patch of so many pixels square, audio so many a second, a document so many a page.
PATCH, A_SECOND, A_PAGE = 28, 25, 256


def escape(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in (("[", "&lsqb;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """Parts of a message that is just this text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast("array<struct<kind:string,text:string>>")


def visit(part: Column, fields: set[str]) -> Column:
    """A part's piece of the output and, for attachments, its reference and expanded token count."""
    get = lambda name, kind: part[name] if name in fields else F.lit(None).cast(kind)
    kind = part["kind"]
    up = lambda x: F.ceil(F.coalesce(x, F.lit(0)))
    patches = up(get("width", "int") / PATCH) * up(get("height", "int") / PATCH)
    tokens = F.when(kind == "image", patches).when(kind == "audio", up(get("seconds", "double") * A_SECOND)).when(kind == "document", F.coalesce(get("pages", "int"), F.lit(0)) * A_PAGE)
    attached = kind.isin("image", "audio", "document")
    piece = F.when(attached, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    return F.struct(piece.alias("piece"), F.coalesce(attached, F.lit(False)).alias("attached"), kind.alias("kind"), get("uri", "string").alias("uri"), tokens.cast("long").alias("tokens"))


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation of turns(conv_id, turn, role, parts): formatted, n_turns, loss_spans, attachments, attachment_tokens.

    loss_spans: start and end in code points of each body whose role is in loss_roles.
    """
    fields = {f.name for f in turns.schema["parts"].dataType.elementType.fields}
    role = F.coalesce(F.col("role"), F.lit(""))
    seen = F.transform(F.coalesce(F.col("parts"), F.array().cast(turns.schema["parts"].dataType)), lambda p: visit(p, fields))
    rows = turns.select("conv_id", "turn", role.alias("role"), seen.alias("seen"))
    rows = rows.withColumn("body", F.array_join(F.transform("seen", lambda p: p["piece"]), ""))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head", head)
    size = F.length("head") + F.length("body") + len(STOP)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("place", F.row_number().over(order))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(BEGIN)
    rows = rows.withColumn("start", before + F.length("head")).withColumn("stop", F.col("start") + F.length("body"))
    attached = F.transform(F.filter("seen", lambda p: p["attached"]), lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["tokens"].alias("tokens")))
    each = F.struct("place", F.concat("head", "body", F.lit(STOP)).alias("text"), F.col("role").isin(*loss_roles).alias("loss"), "start", "stop", attached.alias("attached"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("end")))
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda x: x["text"]), ""), F.lit(END)).alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))).alias("attachment_tokens"),
    )


def _turns(text: Column, turn) -> Column:
    """turn(role, body) of each turn of a formatted conversation, both still escaped."""
    pieces = F.filter(F.split(text, r"<\|turn\|>"), lambda p, i: i > 0)
    return F.transform(pieces, lambda p: turn(F.substring_index(p, TEXT, 1), F.substring_index(F.substring_index(p, TEXT, -1), STOP, 1)))


def read_parts(text: Column) -> Column:
    """Turns of a formatted conversation with their parts: array<struct<role, parts: array<struct<kind, text>>>>; an attachment's text is null."""
    mark = r"<\|(?:image|audio|document)\|>"
    holds = lambda b: F.filter(F.split(b, f"(?={mark})|(?<=<\\|(?:image|audio|document)\\|>)"), lambda x: x != "")
    kind = lambda x: F.when(F.startswith(x, F.lit("<|")), F.substring_index(F.substring(x, 3, 1 << 30), "|>", 1))
    part = lambda x: F.struct(F.coalesce(kind(x), F.lit("text")).alias("kind"), F.when(kind(x).isNull(), unescape(x)).alias("text"))
    return _turns(text, lambda role, body: F.struct(unescape(role).alias("role"), F.transform(holds(body), part).alias("parts")))


def read_back(text: Column) -> Column:
    """Turns of a formatted conversation, unescaped: array<struct<role, text>>."""
    return _turns(text, lambda role, body: F.struct(unescape(role).alias("role"), unescape(body).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")
