"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor (one
`transform` over the parts) turns each into its place in the message: text stays,
every other kind becomes a placeholder, with an attachment entry (its
order, kind, reference and the tokens that it expands to). Text is escaped after
neighbouring parts are joined, so no two parts make a control string together.

Template of a turn: `<|im_start|>` role, line end, content, `<|im_end|>`, line end.
Escape: between `<` and `|`, any run of backslashes gets one more, so text never
holds a control string and unescaping takes that one away again. In roles,
backslashes and line ends are escaped too.

The loss mask is a list of spans [start, stop) in characters of the formatted
string: the content of each assistant turn, as escaped.

Defined results: null texts, roles and parts count as empty; a part of an
unknown or null kind is kept as text; sizes that are null count as zero; turns
go by turn number (null first), then role and content, so ties and repeated rows
have one order; a null conversation id is a conversation; empty input gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that attachments expand to: image patches of 14 x 14 pixels, audio frames a second, tokens a page.
PATCH, FRAMES_A_SECOND, TOKENS_A_PAGE = 14, 25, 512
PARTS = "array<struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    held = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\0"))
    return F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast("array<struct<kind: string, text: string>>")


def _has(df: DataFrame, parts: str, field: str) -> bool:
    return field in df.schema[parts].dataType.elementType.fieldNames()


def visit(df: DataFrame, parts: str = "parts") -> DataFrame:
    """df and: content string, attachments array<struct<place, kind, uri, tokens>>, in the order of the parts."""
    number = lambda p, f, t: F.coalesce(p[f].cast(t), F.lit(0).cast(t)) if _has(df, parts, f) else F.lit(0).cast(t)
    word = lambda p, f: F.coalesce(p[f], F.lit("")) if _has(df, parts, f) else F.lit("")
    up = lambda x: F.ceil(x).cast("long")
    other = list(PLACEHOLDERS)

    # while the parts are joined, a placeholder is a null character and its number, and a null character of a text is one and a z
    def shown(p: Column) -> Column:
        out = F.replace(word(p, "text"), F.lit("\0"), F.lit("\0z"))
        for number_, kind in enumerate(PLACEHOLDERS):
            out = F.when(p["kind"] == kind, F.lit(f"\0{number_}")).otherwise(out)
        return out

    def marked(text: Column) -> Column:
        for number_, mark in enumerate(PLACEHOLDERS.values()):
            text = F.replace(text, F.lit(f"\0{number_}"), F.lit(mark))
        return F.replace(text, F.lit("\0z"), F.lit("\0"))

    def entry(p: Column) -> Column:
        tokens = (
            F.when(p["kind"] == "image", up(number(p, "width", "double") / PATCH) * up(number(p, "height", "double") / PATCH))
            .when(p["kind"] == "audio", up(number(p, "seconds", "double") * FRAMES_A_SECOND))
            .otherwise(number(p, "pages", "long") * TOKENS_A_PAGE)
        )
        return F.struct(p["kind"].alias("kind"), word(p, "uri").alias("uri"), tokens.alias("tokens"))

    held = F.filter(F.coalesce(F.col(parts), F.array().cast(df.schema[parts].dataType)), lambda p: p.isNotNull())
    media = F.transform(F.filter(held, lambda p: F.coalesce(p["kind"].isin(other), F.lit(False))), entry)
    placed = F.transform(media, lambda a, i: F.struct(i.alias("place"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    return df.withColumn("content", marked(escape(F.array_join(F.transform(held, shown), "")))).withColumn("attachments", placed)


def format_chats(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """One row for each conversation: formatted string, loss_spans array<struct<start, stop>>, attachments, expanded_tokens long."""
    named = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(parts).alias("parts"))
    shown = visit(named, "parts").withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    # where a turn begins: the characters of the turns before it
    before = W.partitionBy("conv").orderBy("turn", "role", "content", "attachments").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("head") + F.length("content") + F.lit(len(END) + 1)
    placed = shown.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.length("content")).alias("stop")))
    one = F.struct("turn", "role", "content", "attachments", "start", "head", span.alias("span"))
    turns = placed.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END + "\n")))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x.isNotNull())
    media = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))),
        )
    )
    return turns.select(
        F.col("conv").alias(conv),
        F.array_join(written, "").alias("formatted"),
        loss.alias("loss_spans"),
        media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, span by span."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")))), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, F.lit(r"<\|im_end\|>\n"), -1)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(F.substr(piece, F.lit(len(START) + 1)), "\n", 1)
        body = F.substr(piece, F.length(head) + F.lit(len(START) + 2))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(whole, turn)


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    back = chats.select(conv, "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(conv, "formatted", "turns", said.alias("said"), "under").select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
