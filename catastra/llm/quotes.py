"""Operator 10: conversations without quotations, ordered by the replies that quotations show."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, plain_names, running_totals, salted_join, staged, without

PREFIX = re.compile(r"[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"\b(?:wrote|schrieb|écrit|escribió)\s*:\Z")
PARSED = "struct<own:string,units:array<struct<h:long,words:int>>,quoted:array<struct<h:long,words:int,level:int>>>"


def normal(s: str) -> str:
    return " ".join(s.lower().split())


def unit(s: str) -> dict:
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace"))
    return {"h": h - (1 << 64) if h >> 63 else h, "words": s.count(" ") + 1}


def units(lines: list[str]) -> list[dict]:
    """The passage as a whole, its paragraphs and its lines, each once."""
    whole = normal(" ".join(lines))
    found = {whole} | {n for x in lines if (n := normal(x))}
    paragraph: list[str] = []
    for x in [*lines, ""]:
        if x.strip():
            paragraph.append(x)
        else:
            found.add(normal(" ".join(paragraph)))
            paragraph = []
    return [unit(s) for s in sorted(found - {""})]


def parse(text: str | None) -> dict:
    """A message's own text, the units it offers to others, and the units that it quotes with their level."""
    own, blocks = [], []
    for line in (text or "").split("\n"):
        m = PREFIX.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
            if line.strip() and blocks and blocks[-1]:
                blocks.append(None)
            continue
        if own and WROTE.search(own[-1].rstrip()):
            own.pop()
        body = line[m.end() :]
        if blocks and blocks[-1] and blocks[-1][0] == level:
            blocks[-1][1].append(body)
        else:
            blocks.append((level, [body]))
    quoted = [u | {"level": b[0]} for b in blocks if b for u in units(b[1])]
    return {"own": "\n".join(own).strip("\n") if blocks else (text or ""), "units": units(own), "quoted": quoted}


def link_quotations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", far_words: int = 8) -> DataFrame:
    """messages with content (the text without quotations), reply_conversation and reply_turn (what it answers), depth, thread and position.

    Lines that begin with > are quoted, as deep as they have such marks. Each block of one level is a passage: its
    whole, its paragraphs and its lines, in lower case with blanks folded, are hashed and joined to the same units of
    the messages' own texts. Of each unit the earliest message that offers it counts: earlier in the same conversation,
    or else, from far_words words on, earlier by (conversation, turn) anywhere. A message answers the one that most words of its shallowest
    passages come from (ties: the latest). thread is the conversation of the message that a chain of answers begins
    with, depth the length of the chain; position counts a thread's messages from 0 in order of (conversation, turn), so
    answers follow what they answer.

    Aggregating before joining leaves one row for each unit, so a passage quoted or offered by any number of messages
    makes no pairs. Null and empty texts have empty content and neither quote nor are quoted; rows that share
    conversation and turn are one message for links, and both stay; rows with a null conversation or turn stay, unlinked. Columns of messages named like
    a result are replaced.
    """

    @F.pandas_udf(PARSED)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=["own", "units", "quoted"])

    results = ["content", "reply_conversation", "reply_turn", "depth", "thread", "position"]
    keep, names, (conversation, turn, text) = plain_names(without(messages, results), conversation, turn, text)
    work = staged(keep.withColumn("_p", of(F.col(text).cast("string"))).withColumn("_c", F.col(conversation)).withColumn("_t", F.col(turn)))
    quoted = staged(work.select("_c", "_t", F.explode("_p.quoted").alias("q")).select("_c", "_t", "q.*").filter("_c is not null and _t is not null").groupBy("_c", "_t", "h").agg(F.max("words").alias("words"), F.min("level").alias("level")))
    wanted = staged(quoted.groupBy("h").agg(F.count(F.lit(1)).alias("count")))
    offered = work.select("_c", "_t", F.explode("_p.units").alias("u")).select("_c", "_t", "u.h").filter("_c is not null and _t is not null")
    near = staged(offered.groupBy(F.col("_c").alias("oc"), "h").agg(F.min("_t").alias("ot")))  # a row for each unit of a conversation
    near = staged(salted_join(near, wanted.select("h"), "h", "oc", "left_semi", hot_keys(near.groupBy("h").count())))
    far = near.groupBy("h").agg(F.min(F.struct("oc", "ot")).alias("o")).select("h", F.col("o.oc").alias("fc"), F.col("o.ot").alias("ft"))
    found = quoted.join(near, (quoted.h == near.h) & (quoted._c == near.oc) & (near.ot < quoted._t), "left").select(quoted["*"], "oc", "ot")
    found = salted_join(found, far, "h", "_c", "left", hot_keys(wanted))
    use_far = F.col("oc").isNull() & (F.col("words") >= far_words) & ((F.col("fc") < F.col("_c")) | ((F.col("fc") == F.col("_c")) & (F.col("ft") < F.col("_t"))))
    found = found.select("_c", "_t", "words", "level", F.when(use_far, F.col("fc")).otherwise(F.col("oc")).alias("oc"), F.when(use_far, F.col("ft")).otherwise(F.col("ot")).alias("ot")).filter("oc is not null")
    votes = found.groupBy("_c", "_t", "oc", "ot").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    links = staged(votes.groupBy("_c", "_t").agg(F.max(F.struct((-F.col("level")).alias("l"), "words", "oc", "ot")).alias("b")).select("_c", "_t", F.col("b.oc").alias("pc"), F.col("b.ot").alias("pt")))

    # pointer doubling: after k rounds, `up` is the ancestor 2**k steps up, or the first message of the chain
    chain = staged(links.withColumn("depth", F.lit(1).cast("long")))
    while True:
        above = chain.select(F.col("_c").alias("pc"), F.col("_t").alias("pt"), F.col("pc").alias("gc"), F.col("pt").alias("gt"), F.col("depth").alias("more"))
        step = chain.join(above, ["pc", "pt"], "left")
        moved = staged(step.select("_c", "_t", F.coalesce("gc", "pc").alias("pc"), F.coalesce("gt", "pt").alias("pt"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("gc").isNotNull().alias("on")))
        chain = moved.drop("on")
        if not moved.filter("on").limit(1).count():
            break
    roots = chain.select("_c", "_t", F.col("pc").alias("thread"), "depth")
    out = work.join(links, ["_c", "_t"], "left").join(roots, ["_c", "_t"], "left")
    out = out.select(*keep.columns, F.col("_p.own").alias("content"), F.col("pc").alias("reply_conversation"), F.col("pt").alias("reply_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("thread", "_c").alias("thread"), F.lit(1).cast("long").alias("_one"), F.xxhash64(text).alias("_tie"))
    ranked, _, _ = running_totals(out, ["thread", conversation, turn, "_tie"], "_one")
    first = staged(ranked.groupBy("thread").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("count")))
    alone = first.filter("thread is null").first()  # rows without a conversation; they stand first
    first = first.filter("thread is not null")
    joined = salted_join(ranked, first.drop("count"), "thread", "_rank", "left", hot_keys(first.select("thread", "count")))
    position = F.col("_rank") - F.coalesce("_first", F.lit(alone["_first"] if alone else 0))
    return joined.select(*keep.columns, *results[:-1], position.alias("position")).toDF(*names, *results)
