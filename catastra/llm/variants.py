"""Operator 12: spelling variants, by merging the light subtrees of the words' trie with one character skipped or replaced."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, staged
from .sharding import half_bytes

#: Of Latin-1 bytes: letters stay, A-Z in lower case; all others end a run.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
SLICE = 1 << 22
#: A task sends its counts on when it holds so many words.
HELD_WORDS = 1 << 19
#: Words whose prefixes are hashed together have about so many characters.
GROUP_CHARS = 1 << 20


def noisy_words(docs: DataFrame, id: str = "doc_id", text: str = "text", one_in: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the letter runs of all texts, with a slip of the pen in one of `one_in`.

    Runs are of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where one_in divides the CRC-32 of `<id>:<run>`, the
    run loses the character at that CRC modulo its length. Results of least_chars characters and least_count
    occurrences in all texts are words. Null and empty texts have none; a null id is empty. Repeated rows count each.
    """

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for k in range(b.num_rows):
                data = (b.column(1)[k].as_py() or "").encode("latin-1", "replace").translate(FOLD)
                start, runs, at = zlib.crc32(f"{b.column(0)[k].as_py() or ''}:".encode()), Counter(), 0
                while at < len(data):
                    end = data.find(b" ", at + SLICE)
                    end = len(data) if end < 0 else end
                    runs.update(data[at:end].split())
                    at = end
                for run, many in runs.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % one_in == 0:
                        p = h % len(run)
                        run = run[:p] + run[p + 1 :]
                    if len(run) >= least_chars:
                        held[run] += many
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """(id, at, prefix, letter): for each of words(id, word) the edges on its path in the trie: at characters, hashed to prefix, then letter; '' at the word's end."""

    def paths(batches):
        import pyarrow as pa

        def group(ids: list, texts: list):
            sizes = np.array([len(t) for t in texts], np.int64)
            joined = "".join(texts)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[np.arange(len(codes)) - np.repeat(starts, sizes)], dtype=np.uint64)))
            first = np.repeat(starts, sizes + 1)
            at = np.arange(len(first)) - np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)))[:-1], sizes + 1)
            end = at == np.repeat(sizes, sizes + 1)
            prefix = (sums[first + at] - sums[first]) ^ (at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            letter = np.array([*joined, ""])[np.where(end, len(joined), first + at)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes + 1)), pa.array(at.astype(np.int32)), pa.array(prefix.view(np.int64)), pa.array(letter.tolist(), pa.string())], names=["id", "at", "prefix", "letter"])

        for b in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                chars += len(t)
                if chars >= GROUP_CHARS:
                    yield group(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield group(ids, texts)

    return words.select("id", "word").mapInArrow(paths, "id long, at int, prefix long, letter string")


def light_edges(words: DataFrame) -> DataFrame:
    """(id, at, letter, heavy): of each word of words(id, word) the edges that leave the heavy path of the trie, with the letter that the heavy path goes on with.

    The heavy child of a prefix is the one with most words below it. A word leaves heavy paths at most log2(words) times,
    since the words below at least double with each. Prefixes are hashed: two that share a hash share a heavy letter,
    which costs nothing but balance, as any one letter for a prefix will do.
    """
    edges = trie_edges(words)
    children = edges.groupBy("prefix", "letter").agg(F.count(F.lit(1)).alias("many"))
    most = F.max(F.struct(F.when(F.col("letter") == "", 0).otherwise(F.col("many")).alias("many"), "letter"))
    forks = staged(children.groupBy("prefix").agg(most["letter"].alias("heavy"), F.count(F.lit(1)).alias("kinds"), F.sum("many").alias("count")).filter("kinds > 1").drop("kinds"))
    hot = hot_keys(forks.select("prefix", "count"))
    return salted_join(edges, forks.drop("count"), "prefix", "id", hot=hot).filter("letter != heavy").select("id", "at", "letter", "heavy")


def one_edit_links(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of words(id, word, n), distinct: (a, b), structs (id, n, word) of every two that differ by one inserted character, and (members), arrays of those that differ by one replaced character at one place.

    Two words part at a fork of the trie, and at least one of them leaves it by a light edge. There each light word goes
    on with its letter skipped, or replaced by the heavy one, or with the heavy one before it; where it comes out at
    a word, they are near. Light words of one fork that are alike but for their letters meet by what remains of them.
    So every word is merged into others once for each light edge on its path, and never by a heavy one. A pair with
    an inserted character is found once: of a run of equal letters only the last is skipped. A set with
    a replaced one has a word for each letter at most.
    """
    me = F.struct("id", "n", "word")
    here = light_edges(words).join(words, "id")
    size = F.length("word")
    before, after, rest = F.col("word").substr(F.lit(1), F.col("at")), F.col("word").substr(F.col("at") + 2, size), F.col("word").substr(F.col("at") + 1, size)
    skipped = F.concat(before, after)
    here = staged(here.select("at", "letter", skipped.alias("skipped"), F.concat(before, "heavy", after).alias("replaced"), F.concat(before, "heavy", rest).alias("inserted"), after.substr(1, 1).alias("next"), me.alias("me")))
    known = words.select(F.col("word").alias("probe"), me.alias("other"))
    inner = F.col("letter") != ""
    probe = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("probe"))
    probes = F.array_compact(F.array(probe("link", "inserted"), F.when(inner & (F.col("next") != F.col("letter")), probe("link", "skipped")), F.when(inner, probe("set", "replaced"))))
    met = staged(here.select("at", "skipped", "me", F.explode(probes).alias("p")).select("at", "skipped", "me", "p.*").join(known, "probe"))
    links = met.filter("kind = 'link'").select(F.col("me").alias("a"), F.col("other").alias("b"))
    heavy = met.filter("kind = 'set'").select("at", "skipped", F.col("other").alias("member"))
    light = here.filter(inner).select("at", "skipped", F.col("me").alias("member"))
    # a member for each letter at one place: no more than the alphabet has
    sets = light.unionByName(heavy).groupBy("at", "skipped").agg(F.collect_set("member").alias("members")).filter("size(members) > 1").select("members")
    return links, sets


def ranked(member: Column) -> Column:
    """Orders by largest n, then by code points."""
    return F.struct((-member["n"]).alias("less"), member["word"].alias("word"), member["id"].alias("id"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), distinct words of any characters with their frequencies.

    n_near counts the words that differ by exactly one inserted, deleted or replaced character; form is the most frequent of
    them (ties: the least in code-point order), if it occurs at least twice as often; root is where the forms lead
    to, the word itself without one. Rows with a null word or n go; an empty table gives an empty result.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null and n is not null").withColumn("id", F.monotonically_increasing_id()))
    links, sets = one_edit_links(words)
    one = F.lit(1).cast("long").alias("many")
    pairs = links.select(F.col("a.id").alias("id"), one, ranked(F.col("b")).alias("best")).unionByName(links.select(F.col("b.id").alias("id"), one, ranked(F.col("a")).alias("best")))
    others = F.array_min(F.transform(F.filter("members", lambda x: x["id"] != F.col("m.id")), ranked))
    alike = sets.select("members", F.explode("members").alias("m")).select(F.col("m.id").alias("id"), (F.size("members") - 1).cast("long").alias("many"), others.alias("best"))
    near = pairs.unionByName(alike).groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))
    leads = -F.col("best.less") >= 2 * F.col("n")
    out = staged(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"), F.when(leads, F.col("best.id")).alias("up")))

    # pointer doubling; frequencies double along a chain, so it has no more than 64 words
    chain = staged(out.filter("up is not null").select("id", "up", F.col("form").alias("root")))
    while True:
        above = chain.select(F.col("id").alias("up"), F.col("up").alias("upper"), F.col("root").alias("above"))
        moved = staged(chain.join(above, "up", "left").select("id", F.coalesce("upper", "up").alias("up"), F.coalesce("above", "root").alias("root"), F.col("upper").isNotNull().alias("on")))
        chain = moved.drop("on")
        if not moved.filter("on").limit(1).count():
            break
    return out.join(chain.select("id", "root"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(one_in: int = 97, least_chars: int = 5, least_count: int = 3) -> str:
    """DuckDB SQL for the op12 query over documents."""
    table = "[" + ", ".join(f"{x}::bigint" for x in half_bytes()) + "]"
    step = lambda c: f"xor({c} >> 4, list_extract({table}, ({c} & 15) + 1))"
    return f"""
with recursive runs as (select doc_id, run, count(*) as many from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents) group by 1, 2),
bytes as (select *, hex(coalesce(doc_id::varchar, '') || ':' || run) as h from runs),
crc as (select run, many, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)), lambda a, x: {step(step("xor(a, x)"))}), 4294967295) as h from bytes),
slips as (select case when h % {one_in} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, many from crc),
words as (select word, sum(many)::bigint as n from slips where length(word) >= {least_chars} group by word having sum(many) >= {least_count}),
shorter as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as d from (select word, unnest(range(0, length(word))) as i from words)),
dropped as (select distinct s.word as a, w.word as b from shorter s join words w on w.word = s.d),
near as (select a.word as a, b.word as b from shorter a join shorter b on a.i = b.i and a.d = b.d and a.word <> b.word
         union all select a, b from dropped union all select b, a from dropped),
best as (select a, count(*) as n_near, arg_min(b, (-n, b)) as form, max(n) as form_n from near join words on word = b group by a),
formed as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end::bigint as form_n from words left join best on a = word),
walk as (select word, word as at, form as next from formed union all select walk.word, f.word, f.form from walk join formed f on f.word = walk.next)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from formed f join walk on walk.word = f.word and walk.next is null"""
