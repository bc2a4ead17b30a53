"""Chat formatting of typed content parts, in SQL functions only.

A turn is written as <|start|>role<|says|>content<|end|> and a newline. In roles and texts a backslash becomes two and "<|" becomes
"<\\|", so control strings never occur inside them, and undoing it is exact. A part that is not text becomes the placeholder
<|kind:i|>, i being its place in the turn; its reference and the tokens it expands to are recorded as an attachment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, SAYS, END = "<|start|>", "<|says|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of a non-text part: an image has one a tile of 28 x 28 pixels, audio 25 a second, a document 600 a page.
TILE, A_SECOND, A_PAGE = 28, 25, 600


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (x.split(":") for x in PART[7:-1].split(","))}
    return F.array(F.struct(*(none | {"kind": F.lit("text").alias("kind"), "text": text.alias("text")}).values()))


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a turn's parts in order; each part is visited once, by its kind.

    A null list is empty, a null kind is text, a null text is empty; an unknown kind is kept as a placeholder of no tokens.
    """
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    tiles = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / TILE)
    cost = lambda p: (
        F.when(kind(p) == "image", tiles(p["width"]) * tiles(p["height"]))
        .when(kind(p) == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * A_SECOND))
        .when(kind(p) == "document", F.coalesce(p["pages"], F.lit(0)) * A_PAGE)
        .otherwise(0)
        .cast("long")
    )
    shown = lambda p, i: F.when(kind(p) == "text", escaped(p["text"])).otherwise(
        F.concat(F.lit("<|"), F.regexp_replace(kind(p), "[^A-Za-z0-9_]", "_"), F.lit(":"), i.cast("string"), F.lit("|>"))
    )
    content = F.coalesce(F.array_join(F.transform(parts, shown), ""), F.lit(""))
    seen = F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("kind"), p["ref"].alias("ref"), cost(p).alias("tokens")))
    return content, F.coalesce(F.filter(seen, lambda a: a["kind"] != "text"), F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>"))


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) of rows (conv_id, turn, role, parts).

    loss_spans holds (start, length) in code points of each content of the trained role, in order. Rows are ordered by turn
    (nulls first), equal turns by role and content; repeated rows are kept; a null role is empty; a null conv_id is a conversation
    of its own. An empty table gives no rows. A conversation is one result row, so its text must fit in a row.
    """
    content, attachments = visit(F.col("parts"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("attached"))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SAYS))
    rows = rows.withColumn("piece", F.concat(head, "content", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("attached"))
    upto = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"nth": F.row_number().over(order), "at": upto - F.length("piece") + F.length(head)})
    span = F.when(F.col("role") == trained, F.struct(F.col("at").alias("start"), F.length("content").cast("long").alias("length")))
    both = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "piece", span.alias("span"), "turn", "attached"))).alias("all")
    )
    seen = F.flatten(F.transform("all", lambda r: F.transform(r["attached"], lambda a: F.struct(r["turn"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return both.select(
        "conv_id",
        F.array_join(F.transform("all", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        seen.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns, structs of role and text, read back from a formatted conversation; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|start\|>"), lambda p: p != "")
    role = lambda p: unescaped(F.substring_index(p, SAYS, 1))
    text = lambda p: unescaped(F.substring_index(F.substring_index(p, SAYS, -1), END.strip(), 1))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    piece = lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, piece), "")
