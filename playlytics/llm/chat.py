"""Chat formatting: quoted passages are linked to the messages they come from, and conversations are set in reply order.

A line that begins with ``>`` is quoted; the number of marks is its level. Lines of one level that follow each other are a
passage, and a quoted line without words parts it into paragraphs. Passages, their paragraphs and their lines are normalised (lower-case words between single spaces) and hashed, and so are the own words
of every message: whole, by paragraph and by line. A passage comes from the first message of its conversation that states it,
if that is an earlier turn. A message replies to the message from which most of its quoted words of the lowest linked level come
(of several the latest). Following the replies up gives its thread; conversations are ordered by thread and turn, so that
a reply stands after what it answers, and quotes are taken out, with the line that introduces them.

Messages without a linked quote begin a thread, and a quote that is found nowhere is taken out as well. Statements are
combined per conversation and hash before they meet quotes, so a passage that all messages share makes one row; threads are found by
pointer jumping on the linked turns only, in a logarithmic number of rounds. A conversation is never gathered: the result
has one row per message, and its order is a range sort.

Null and empty texts are empty messages. Messages with a null conversation or turn are linked to nothing. Rows that repeat a
turn share its reply. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlytics.llm.common import materialise

_MARKS = r"^(\s*>)+"
_QUOTED = r"^\s*>"
_INTRODUCES = r"(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _GAP, " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    lines = _lines(text)

    def own(line: Column, i: Column) -> Column:
        following = F.coalesce(F.get(lines, i + 1).rlike(_QUOTED), F.lit(False))
        return ~line.rlike(_QUOTED) & ~(line.rlike(_INTRODUCES) & following)

    return F.btrim(F.array_join(F.filter(lines, own), "\n"), F.lit(" \t\r\n"))


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _passages(quoting: DataFrame) -> DataFrame:
    """(conv, turn, level, key, words) of all quoted passages, their paragraphs and their lines. Passages lie within one message."""
    along = Window.partitionBy("row").orderBy("pos")
    lines = quoting.select("row", "conv", "turn", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(_QUOTED))
    lines = lines.select("row", "conv", "turn", "pos", quote_level(F.col("line")).alias("level"), F.regexp_replace("line", _MARKS, "").alias("line"))
    begins = (F.lag("level").over(along) == F.col("level")) & (F.lag("pos").over(along) == F.col("pos") - 1)
    numbered = lines.withColumn("begins", (~F.coalesce(begins, F.lit(False))).cast("int"))
    numbered = numbered.withColumn("passage", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    whole = numbered.groupBy("row", "conv", "turn", "passage", "level").agg(joined.alias("line"))
    # lines with words that follow each other: a reply may quote some paragraphs of a message, broken into other lines
    worded = numbered.where(_normal(F.col("line")) != "")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("row", "level").orderBy("pos"))
    paragraph = worded.withColumn("run", run).groupBy("row", "conv", "turn", "run", "level").agg(joined.alias("line"))
    units = [df.select("conv", "turn", "level", "line") for df in (whole, paragraph, numbered)]
    both = units[0].unionByName(units[1]).unionByName(units[2])
    unit = both.select("conv", "turn", "level", _normal(F.col("line")).alias("normal")).where("normal <> ''").distinct()
    return unit.select("conv", "turn", "level", F.md5(F.col("normal").cast("binary")).alias("key"), F.size(F.split("normal", " ")).alias("words"))


def _statements(messages: DataFrame) -> DataFrame:
    """(conv, key, first): the first turn of a conversation that states a text, a paragraph or a line."""
    own = own_text(F.col("text"))
    units = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    keys = F.transform(F.filter(F.transform(units, _normal), lambda u: u != ""), lambda u: F.md5(u.cast("binary")))
    said = messages.select("conv", "turn", F.explode(F.array_distinct(keys)).alias("key"))
    return said.groupBy("conv", "key").agg(F.min("turn").alias("first"))


def _replies(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv, turn, up): the turn that each message replies to."""
    involved = messages.join(quoting.select("conv").distinct(), "conv", "left_semi")
    met = _passages(quoting).join(_statements(involved), ["conv", "key"]).where("first < turn")
    shares = met.groupBy("conv", "turn", "level", "first").agg(F.sum("words").alias("words"))
    order = F.struct(F.col("level"), (-F.col("words")).alias("words"), (-F.col("first")).alias("late"))
    best = shares.groupBy("conv", "turn").agg(F.min(order).alias("best"))
    return best.select("conv", "turn", (-F.col("best.late")).alias("up"))


def _threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, up, thread, depth): the first turn of each reply's thread and the number of replies up to it."""
    jumps = materialise(replies.select("*", F.col("up").alias("thread"), F.lit(1).cast("bigint").alias("depth")), "replies")
    while True:
        ahead = jumps.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        longer = jumps.join(ahead, ["conv", "thread"], "left").select(
            "conv",
            "turn",
            "up",
            F.coalesce("further", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("further").isNotNull().alias("moved"),
        )
        longer = materialise(longer, "replies")
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return jumps


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, thread, turn, role, depth, reply_to, n_quoted, text, formatted) of every message, in reply order."""
    rows = messages.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    placed = rows.where("conv is not null and turn is not null")
    quoting = placed.where(F.exists(_lines(F.col("text")), lambda line: line.rlike(_QUOTED)))
    quoting = materialise(quoting.select("conv", "turn", "text", F.monotonically_increasing_id().alias("row")), "quoting")
    if quoting.isEmpty():
        none = F.lit(None).cast(messages.schema["turn"].dataType)
        linked = rows.select("*", none.alias("up"), F.col("turn").alias("thread"), F.lit(0).cast("bigint").alias("depth"))
    else:
        threads = _threads(_replies(placed, quoting))
        linked = rows.join(threads, ["conv", "turn"], "left")
        linked = linked.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    quoted = F.size(F.filter(_lines(F.col("text")), lambda line: line.rlike(_QUOTED)))
    done = linked.select("conv", "thread", "turn", "role", "depth", "up", quoted.alias("n_quoted"), own_text(F.col("text")).alias("text"))
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"))
    done = done.withColumn("formatted", F.concat(head, F.col("text"), F.lit("\n<|end|>")))
    return done.orderBy("conv", "thread", "turn", "role", "text").withColumnsRenamed({"conv": "conv_id", "up": "reply_to"})
