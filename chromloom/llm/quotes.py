"""Chat formatting by quotation linking.

Messages may quote earlier ones with '>' marks, nested to any depth. Each message is parsed into its own text and its
quoted passages; the words of passages are normalised and hashed, whole and by paragraph and line, and so are the own
texts of all messages. A quoted passage belongs to the latest earlier message of the conversation with the same hash.
A message answers the message that its outermost linked level quotes at most length; without a link it answers the one
before it. Following the answers gives each message's root and depth, and (root, depth, turn) an order in which every
message comes after the one it answers.

Looking up the latest earlier turn takes two levels, stretches of CHUNK turns and rows of a stretch, so that neither a
very long conversation nor a line that is common in one is a single task's work; roots are found by pointer doubling.
Conversations are built from messages numbered in sorted ranges, in rows of bounded size that depend on the messages alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import written

CHUNK = 2_048
MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")


def unit_hash(text: str) -> tuple[int, int] | None:
    """(hash, length) of a passage's words, lower-cased and joined by one space; None without words."""
    words = " ".join(text.lower().split())
    return (xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass")) - 2**63, len(words)) if words else None


def units_of(lines: list[str]) -> set[tuple[int, int]]:
    """The hashes of a passage, of its paragraphs and of its lines."""
    paragraphs = re.split(r"\n[ \t]*\n", "\n".join(lines))
    return {u for t in ("\n".join(lines), *paragraphs, *lines) if (u := unit_hash(t))}


def parse_message(text: str | None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """(own text, units as (passage, level, hash, length)); level 0 and passage 0 are the own text, passages count from 1."""
    own, passages, level = [], [], 0
    for line in (text or "").split("\n"):
        marks = MARKS.match(line)
        depth = marks.group().count(">") if marks else 0
        if not depth:
            own.append(line)
        elif depth == level:
            passages[-1][1].append(line[marks.end() :])
        else:
            passages.append((depth, [line[marks.end() :]]))
        level = depth
    units = [(0, 0, *u) for u in sorted(units_of(own))]
    for k, (depth, lines) in enumerate(passages, 1):
        units += [(k, depth, *u) for u in sorted(units_of(lines))]
    if not passages:
        return text or "", units
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), units


def _parsed(messages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [parse_message(t) for t in f["__text"]]
            yield f.drop(columns="__text").astype("Int64").assign(units=[[dict(zip(("passage", "level", "hash", "length"), u, strict=True)) for u in d[1]] for d in done])

    return messages.mapInPandas(run, "__conv long, __turn long, units array<struct<passage: long, level: long, hash: long, length: long>>")


def latest_before(rows: DataFrame, keys: list[str], is_source: Column) -> DataFrame:
    """rows (keys, turn, ...) that are no sources, with src: the largest turn of a source with the same keys before it, or null."""
    rows = rows.withColumns({"__src": F.when(is_source, F.col("turn")), "__chunk": F.floor(F.col("turn") / CHUNK)})
    tops = rows.groupBy(*keys, "__chunk").agg(F.max("__src").alias("__top"))
    tops = tops.select(*keys, "__chunk", F.max("__top").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    inside = F.max("__src").over(Window.partitionBy(*keys, "__chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__inside", inside).filter(~is_source).join(tops, [*keys, "__chunk"]).withColumn("src", F.coalesce("__inside", "__carried")).drop("__src", "__chunk", "__inside", "__carried")


def roots_of(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) from replies (conv, turn, reply_to: an earlier turn or null), one row a message.

    Pointer doubling: each round looks up only the messages that have not reached their root.
    """
    start = written(replies.select("conv", "turn", F.coalesce("reply_to", "turn").alias("root"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("reply_to").isNull().alias("final")))
    done, open_ = start.filter("final"), start.filter("not final")
    for _ in range(64):
        if open_.isEmpty():
            return done.drop("final")
        ahead = done.unionByName(open_).select("conv", F.col("turn").alias("root"), F.col("root").alias("__next"), F.col("depth").alias("__more"), F.col("final").alias("__final"))
        then = written(open_.drop("final").join(ahead, ["conv", "root"]).select("conv", "turn", F.col("__next").alias("root"), (F.col("depth") + F.col("__more")).alias("depth"), F.col("__final").alias("final")))
        done, open_ = done.unionByName(then.filter("final")), then.filter("not final")
    raise RuntimeError("replies form a loop")


def link_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Adds content, reply_to, by_quote, root_turn, depth, n_quotes, n_linked and chat to messages.

    content is the message without its quotes; chat is content between role markers. n_quotes counts quoted passages,
    n_linked those with a source. Null texts count as empty. Rows without a conversation or turn are formatted but answer
    nothing (reply_to null, root_turn their turn, depth 0). Rows that repeat (conversation, turn) are one message, whose
    quotes are taken together, and keep a row each. An empty table gives an empty result. Columns of messages with the
    names added are replaced.
    """
    added = ["content", "reply_to", "by_quote", "root_turn", "depth", "n_quotes", "n_linked", "chat"]
    messages = messages.drop(*added)
    parsed = written(_parsed(messages.select(F.col(conv_col).cast("long").alias("__conv"), F.col(turn_col).cast("long").alias("__turn"), F.col(text_col).alias("__text"))))
    known = parsed.filter("__conv is not null and __turn is not null").withColumnsRenamed({"__conv": "conv", "__turn": "turn"})
    units = known.select("conv", "turn", F.explode("units").alias("u")).select("conv", "turn", "u.*")
    sources = units.filter("level = 0").select("conv", "turn", "hash", F.lit(0).cast("long").alias("passage"), F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("length")).distinct()
    quoted = units.filter("level > 0").distinct()
    asked = quoted.select("conv", "hash").distinct()
    linked = latest_before(sources.join(asked, ["conv", "hash"], "left_semi").unionByName(quoted), ["conv", "hash"], F.col("level") == 0)
    by_passage = linked.groupBy("conv", "turn", "passage").agg(F.max(F.when(F.col("src").isNotNull(), F.struct((-F.col("level")).alias("l"), "length", "src"))).alias("best"))
    by_message = by_passage.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("best").alias("n_linked"), F.max("best").alias("best"))
    turns = known.select("conv", "turn").distinct()
    doubled = turns.withColumn("of", F.explode(F.array(F.lit(0), F.lit(1))))
    before = latest_before(doubled, ["conv"], F.col("of") == 0).select("conv", "turn", F.col("src").alias("previous"))
    replies = written(before.join(by_message, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("best.src", "previous").alias("reply_to"), F.col("best").isNotNull().alias("by_quote"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))
    placed = replies.join(roots_of(replies), ["conv", "turn"]).withColumnsRenamed({"conv": "__conv", "turn": "__turn", "root": "root_turn"})

    content = F.pandas_udf(lambda texts: texts.map(lambda t: parse_message(t)[0]), "string")
    out = messages.withColumns({"__conv": F.col(conv_col).cast("long"), "__turn": F.col(turn_col).cast("long"), "content": content(F.coalesce(F.col(text_col), F.lit("")))}).join(placed, ["__conv", "__turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *messages.columns,
        "content",
        "reply_to",
        F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("root_turn", "__turn").alias("root_turn"),
        F.coalesce("depth", zero).alias("depth"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce(F.col(role_col), F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n")).alias("chat"),
    )


MESSAGE = ("turn", "depth", "role", "reply_to", "by_quote", "n_quotes", "n_linked", "content")


def build_conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", max_messages: int = 256, max_chars: int = 1_000_000) -> DataFrame:
    """(conv_id, root_turn, first_depth, first_turn, n_messages, messages, chat) of messages as link_conversations() gives them.

    A conversation is all messages that come from one root, in the order (depth, turn), so that each follows the one that
    it answers; chat is their formatted text without quotes. Messages are numbered in sorted ranges, and a conversation of
    any length goes on in another row after every max_messages messages and wherever its text passes a multiple of
    max_chars; its rows ordered by (first_depth, first_turn) are the whole. So the rows depend on the messages alone, not on
    how they are partitioned. Messages without conversation or turn are a row each. Repeated rows stay. An empty table
    gives an empty result.
    """
    types = {"role": "string", "by_quote": "boolean", "content": "string", "chat": "string"}
    own = {"conv_id": F.col(conv_col).cast("long"), "turn": F.col(turn_col).cast("long"), "role": F.col(role_col).cast("string")}
    names = ["conv_id", "root_turn", *MESSAGE, "chat"]
    rows = linked.select(*(own.get(n, F.col(n).cast(types.get(n, "long"))).alias(n) for n in names))
    keys = ["conv_id", "root_turn", "depth", "turn", "chat", "reply_to", "n_quotes", "n_linked"]
    # in its low 33 bits the id has a row's place in its partition, above these the partition's number
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part, size = F.shiftright("at", 33).cast("int"), F.coalesce(F.length("chat"), F.lit(0)).cast("long")
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.sum(size)).collect())  # two numbers for each range
    before = list(zip([p for p, _, _ in sizes], accumulate([0, *(n for _, n, _ in sizes)]), accumulate([0, *(c for _, _, c in sizes)]), strict=False))
    offsets = linked.sparkSession.createDataFrame(before, "part int, rows_before long, chars_before long")
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a sorted range, in one task as it is
    numbered = placed.withColumn("part", part).withColumn("chars", F.coalesce(F.sum(size).over(within), F.lit(0))).join(F.broadcast(offsets), "part")
    numbered = numbered.select(*names, (F.col("at").bitwiseAND(F.lit(2**33 - 1)) + F.col("rows_before")).alias("n"), (F.col("chars") + F.col("chars_before")).alias("c"))
    message = F.struct("n", F.struct(*MESSAGE).alias("message"), "chat")
    known, alone = F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("conv_id").isNull() | F.col("turn").isNull()
    first = numbered.filter(known).groupBy("conv_id", "root_turn").agg(F.min("n").alias("n0"), F.min("c").alias("c0"))
    cut = [F.floor((F.col("n") - F.col("n0")) / max_messages).alias("by_messages"), F.floor((F.col("c") - F.col("c0")) / max_chars).alias("by_chars")]
    blocks = numbered.filter(known).join(first, ["conv_id", "root_turn"]).select("conv_id", "root_turn", *cut, message.alias("m"))
    whole = blocks.groupBy("conv_id", "root_turn", "by_messages", "by_chars").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("conv_id", "root_turn", "ms")
    every = whole.unionByName(numbered.filter(alone).select("conv_id", "root_turn", F.array(message).alias("ms")))
    return every.select(
        "conv_id", "root_turn", F.col("ms")[0]["message"]["depth"].alias("first_depth"), F.col("ms")[0]["message"]["turn"].alias("first_turn"), F.size("ms").cast("long").alias("n_messages"),
        F.col("ms.message").alias("messages"), F.array_join(F.col("ms.chat"), "").alias("chat"),
    )
