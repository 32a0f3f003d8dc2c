"""Operator 1: quality rules by repetition coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, plain_names, windows, without

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STRIP = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepetitionRules:
    """Most of a text's word characters that may lie inside n-grams found twice or more, by n; and inside repeated lines."""

    ngram_chars: dict[int, float] = field(default_factory=lambda: {3: 0.60, 4: 0.55, 5: 0.50, 6: 0.45, 8: 0.40, 10: 0.35})
    line_chars: float = 0.30
    min_words: int = 20
    max_repeat_words_pct: int = 30
    base_window: int = 8


def covered(h: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether an n-word window over it occurs twice or more."""
    inside = np.zeros(len(h), bool)
    w = windows(h, n)
    if len(w) < 2:
        return inside
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return inside
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, rules: RepetitionRules) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    buf = np.frombuffer(data, np.uint8)
    blank = BLANK[buf]
    step = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    words = data.split()
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # only compared inside this text
    total = int(chars.sum())
    lines = [x for x in (text or "").split("\n") if x.strip(STRIP)]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    if len(lines) > 1:
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_line_chars += len(x)
            seen.add(x)
    line_share = dup_line_chars / max(1, sum(map(len, lines)))
    repeat = int(covered(h, rules.base_window).sum())
    shares = [float(chars[covered(h, n)].sum()) / total if total else 0.0 for n in rules.ngram_chars]
    base_failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_words_pct * len(words)
    bad = line_share > rules.line_chars or any(s > most for s, most in zip(shares, rules.ngram_chars.values(), strict=True))
    return (len(words), total, int(SYMBOLS[buf].sum()), dup_lines, repeat, base_failed, not base_failed and not bad, line_share, max(shares, default=0.0))


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, max_ngram_share double"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def repetition_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """docs with the measures named in FIELDS.

    Each text is measured whole, alone in its row, so there is no shuffle. Null and empty texts have no words and are
    not kept. Repeated rows and ids are measured each for itself. Columns of docs named like a measure are replaced.
    """
    rules = rules or RepetitionRules()

    @F.pandas_udf(FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, rules) for t in texts], columns=NAMES)

    keep, names, (text,) = plain_names(without(docs, [n for n in NAMES if n.lower() != text.lower()]), text)
    return keep.withColumn("_q", of(F.col(text).cast("string"))).select(*keep.columns, *[F.col(f"_q.{n}") for n in NAMES]).toDF(*names, *NAMES)


def keep_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of docs that repetition_quality keeps, with the columns of docs."""
    rules = rules or RepetitionRules()

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t, rules)[6] for t in texts], dtype=bool)

    return docs.filter(ok(F.col(text).cast("string")))


def oracle(rules: RepetitionRules | None = None) -> str:
    """DuckDB SQL for repetition_quality over documents."""
    rules = rules or RepetitionRules()
    lengths = sorted({*rules.ngram_chars, rules.base_window})
    window = lambda n: " || ' ' || ".join("g" if k == 0 else f"lead(g, {k}) over w" for k in range(n))
    shares = {n: f"coalesce(a.c{n} / a.chars, 0.0)" for n in rules.ngram_chars}
    return rf"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
words as (select rid, unnest(w) as g, generate_subscripts(w, 1) as i from (select rid, regexp_extract_all(t, '{WORD}') as w from docs)),
grams as (select rid, i, length(g) as n_chars, {", ".join(f"{window(n)} as g{n}" for n in lengths)} from words window w as (partition by rid order by i)),
twice as (select rid, i, n_chars, {", ".join(f"g{n} is not null and count(*) over (partition by rid, g{n}) > 1 as d{n}" for n in lengths)} from grams),
inside as (select rid, n_chars, {", ".join(f"bool_or(d{n}) over (partition by rid order by i rows between {n - 1} preceding and current row) as x{n}" for n in lengths)} from twice),
a as (select rid, count(*) as n_words, sum(n_chars)::bigint as chars, count(*) filter (where x{rules.base_window}) as repeats, {", ".join(f"coalesce(sum(n_chars) filter (where x{n}), 0)::double as c{n}" for n in rules.ngram_chars)} from inside group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) as line from docs),
full_lines as (select rid, line from lines where regexp_matches(line, '{WORD}')),
l as (select rid, count(*) - count(distinct line) as dups, (sum(length(line)) - (select sum(length(x)) from (select distinct unnest(list(line)) as x)))::double / sum(length(line)) as share from full_lines group by rid),
m as (select d.doc_id, coalesce(a.n_words, 0)::bigint as n_words, coalesce(a.chars, 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(l.dups, 0)::bigint as n_dup_lines,
  coalesce(a.repeats, 0)::bigint as n_repeat_words, coalesce(a.n_words, 0) < {rules.min_words} or 100 * a.repeats > {rules.max_repeat_words_pct} * a.n_words as base_failed, coalesce(l.share, 0.0)::double as dup_line_share,
  greatest({", ".join(shares.values())})::double as max_ngram_share, {" or ".join(f"{s} > {rules.ngram_chars[n]}" for n, s in shares.items())} as bad from docs d left join a using (rid) left join l using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and dup_line_share <= {rules.line_chars} and not bad as kept, dup_line_share, max_ngram_share from m"""
