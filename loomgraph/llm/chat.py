"""Chat formatting with Spark expressions only.

A formatted conversation is, for each run of turns of one role::

    <turn>ROLE<says>TEXT<also>TEXT</turn>\\n

In roles and texts a backslash becomes two and ``<`` becomes ``\\l``, so every
``<`` of the output begins a control string and the output can be parsed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, ALSO, END = "<turn>", "<says>", "<also>", "</turn>\n"
CHUNK = 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """After both replacements ``<`` stands for a backslash and the reverse; they are exchanged at once."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("<")), F.lit("\\l"), F.lit("\\"))
    return F.translate(marked, "<\\", "\\<")


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of all earlier elements of an array, in two levels so that long arrays aren't copied for each element."""
    none = F.struct(F.array().cast("array<long>").alias("starts"), F.lit(0).cast("long").alias("total"))
    push = lambda acc, n: F.struct(F.concat(acc["starts"], F.array(acc["total"])).alias("starts"), (acc["total"] + n).alias("total"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) + block - 1) / block) - 1), lambda k: F.slice(lengths, (k * block + 1).cast("int"), F.lit(block)))
    sums = F.when(F.size(lengths) > 0, F.transform(blocks, lambda b: F.aggregate(b, none, push))).otherwise(F.array().cast("array<struct<starts:array<long>,total:long>>"))
    bases = F.aggregate(sums, none, lambda acc, b: push(acc, b["total"]))["starts"]
    return F.flatten(F.zip_with(bases, sums, lambda base, b: F.transform(b["starts"], lambda s: s + base)))


def merged(turns: Column) -> Column:
    """Sorted turns to runs (role, texts) of adjacent turns of one role: the first turn of each run, then the slice up to the next."""
    begins = lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"])
    firsts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), begins)
    bounds = F.zip_with(firsts, F.concat(F.slice(firsts, F.lit(2), F.size(firsts)), F.array(F.size(turns))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(bounds, lambda x: F.struct(F.get(turns, x["a"])["role"].alias("role"), F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to one row for each conversation:
    conv_id, formatted, and loss, an array of (start, chars) in code points of
    ``formatted``, one for each text of ``loss_role``, in order.

    Turns are ordered by (turn, role, text), null turns first; rows repeated in
    full are turns of their own.  A null text or role counts as empty; a null
    conv_id is a conversation of its own; an empty table gives no rows; other
    columns are not read.  Turns are first merged in chunks of ``CHUNK`` turn
    numbers, each in time in proportion to its turns, so a long conversation is put together by many tasks; its one output
    row must fit Spark's limit of 2 GB.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("role", "text")))
    chunks = rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chunks = chunks.select("conv_id", "chunk", merged(F.col("turns")).alias("runs"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "runs"))).alias("chunks"))
    whole = whole.select("conv_id", F.flatten(F.transform("chunks", lambda c: c["runs"])).alias("runs"))
    runs = F.col("runs")

    def pieces(run: Column, i: Column) -> Column:
        """(text, loss) of a run; runs of one role on both sides of a chunk's end belong together."""
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no, role = F.lit(False), run["role"]
        begins = (i == 0) | (F.get(runs, i - 1)["role"] != role)
        ends = (i == F.size(runs) - 1) | (F.get(runs, i + 1)["role"] != role)
        head = F.array(piece(F.when(begins, F.concat(F.lit(TURN), escaped(role), F.lit(SAYS))).otherwise(F.lit(ALSO)), no))
        texts = F.flatten(F.transform(run["texts"], lambda t, k: F.concat(F.when(k > 0, F.array(piece(F.lit(ALSO), no))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")), F.array(piece(escaped(t), role == loss_role)))))
        tail = F.array(piece(F.when(ends, F.lit(END)).otherwise(F.lit("")), no))
        return F.concat(head, texts, tail)

    whole = whole.select("conv_id", F.flatten(F.transform(runs, pieces)).alias("pieces"))
    whole = whole.select("conv_id", "pieces", F.transform("pieces", lambda p: F.length(p["text"]).cast("long")).alias("lengths"))
    spans = F.arrays_zip("pieces", "lengths", running(F.col("lengths")).alias("starts"))
    spans = F.transform(F.filter(spans, lambda s: s["pieces"]["loss"]), lambda s: F.struct(s["starts"].alias("start"), s["lengths"].alias("chars")))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss"))


def cut_out(text: Column, spans: Column, many: int = 128) -> Column:
    """The spans (start, chars) of a text, in order: first the stretch of ``many`` spans, then each from its stretch, so that
    a long text isn't walked through for each span."""
    last = lambda group: F.element_at(group, -1)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / many).cast("int")), lambda k: F.slice(spans, k * many + 1, F.lit(many)))
    stretch = lambda g: F.substring(text, (g[0]["start"] + 1).cast("int"), (last(g)["start"] + last(g)["chars"] - g[0]["start"]).cast("int"))
    parts = F.transform(groups, lambda g: F.struct(stretch(g).alias("text"), g.alias("spans")))
    texts = F.transform(parts, lambda p: F.transform(p["spans"], lambda s: F.substring(p["text"], (s["start"] - p["spans"][0]["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return F.when(F.size(spans) > 0, F.flatten(texts)).otherwise(F.array().cast("array<string>"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, the (role, text) of each turn, and ``loss_texts``, both unescaped, read from the output alone."""
    runs = F.filter(F.split("formatted", TURN), lambda r: r != "")
    turns = F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(F.substring_index(F.substring_index(r, END, 1), SAYS, -1), ALSO),
        lambda text: F.struct(unescaped(F.substring_index(r, SAYS, 1)).alias("role"), unescaped(text).alias("text")),
    )))
    loss = F.transform(cut_out(F.col("formatted"), F.col("loss")), unescaped)
    return formatted.withColumns({"turns": turns, "loss_texts": loss})
