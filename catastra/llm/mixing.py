"""Operator 3: mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, partitions, plain_names, staged, without

#: A Poisson count of a larger mean is the sum of several independent ones of at most this mean.
MEAN_AT_ONCE = 16.0
#: Beyond this many, a count of mean MEAN_AT_ONCE has a probability under 2**-53.
LARGEST = 100
SALTS = 32


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest; the same in every engine and every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """A row for each source: its bytes, target weight, mean copies of a document, and the Poisson distribution to invert.

    Weights come from `weights` (missing sources: 0), or else are in proportion to bytes ** power.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("_bytes"))
    if weights is None:
        raw = F.floor(F.pow(F.col("_bytes").cast("double"), F.lit(power)) * 1e6) if power != 0.5 else F.floor(F.sqrt(F.col("_bytes").cast("double")) * 1e6)
    else:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0)
        raw = F.floor(raw * 1e12)
    sizes = staged(sizes.withColumn("_raw", raw.cast("long")))
    all_, sum_ = sizes.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum("_raw"), F.lit(0))).first()  # two numbers
    rate = F.round(F.lit(epochs) * F.lit(all_) * (F.col("_raw") / F.lit(max(sum_, 1))) / F.col("_bytes"), 9)
    out = sizes.withColumn("_rate", rate)
    out = out.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MEAN_AT_ONCE)).cast("int")).withColumn("_mean", F.col("_rate") / F.col("_draws"))
    first = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST)), first, step, lambda acc: acc["c"])
    return out.select("_source", "_rate", "_draws", cdf.alias("_cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 42, id: str = "doc_id", source: str = "source", text: str = "text", shuffle: bool = True) -> DataFrame:
    """Each row of docs as often as its own Poisson count says, in a global random order; with copy (from 1) and shuffle_key.

    The mean count of a source is its target share of (epochs x all bytes) over its own bytes, so that the expected
    bytes of each source meet its weight. The count inverts the Poisson distribution at a hash of the id, so the same
    row gets the same count on every run and machine; rows that share an id share the count. Null sources form one
    source, named ''. Null and empty texts count one byte. An empty docs gives an empty result. Columns of docs named
    copy or shuffle_key are replaced.

    The table of sources is broadcast if it has at most BROADCAST_ROWS rows; beyond, each source is split in SALTS
    salted parts and joined by shuffle.
    """
    out, names, (id, source, text) = plain_names(without(docs, ["copy", "shuffle_key"]), id, source, text)
    table = staged(rates(out, source, text, weights, power, epochs))
    columns = out.columns
    out = out.withColumn("_source", F.coalesce(F.col(source), F.lit("")))
    if table.count() <= BROADCAST_ROWS:
        out = out.join(F.broadcast(table), "_source")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"])
    # numbers are drawn before they are looked up, so that each digest is made once
    numbers = F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), lambda j: uniform(seed, j, F.col(id)))
    many = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter("_cdf", lambda c: c <= u)))
    out = out.withColumn("_n", many).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    out = out.withColumn("shuffle_key", (uniform(seed, F.lit("shuffle"), F.col(id), F.col("copy")) * float(2**52)).cast("long")).select(*columns, "copy", "shuffle_key")
    if not shuffle:
        return out.toDF(*names, "copy", "shuffle_key")
    # keys are even over [0, 2**52), so a formula cuts their range and no sample of them is drawn
    n = partitions(docs.sparkSession)
    return out.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col("shuffle_key") / F.lit(float(2**52)) * n)).cast("int")).sortWithinPartitions("shuffle_key", id).toDF(*names, "copy", "shuffle_key")


def oracle(epochs: float = 1.0, seed: int = 42) -> str:
    """DuckDB SQL for mix_sources over documents with power 0.5, whose rows also give _rate's effect only through the copies."""
    u = lambda *p: f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(p)})), 1, 13))::bigint / 4503599627370496.0)"
    return f"""
with sizes as (select coalesce(source, '') as s, sum(strlen(coalesce(text, '')) + 1)::bigint as b from documents group by 1),
raw as (select *, floor(sqrt(b::double) * 1e6)::bigint as r from sizes),
rate as (select s, round({epochs!r} * (sum(b) over ())::double * (r::double / (sum(r) over ())::double) / b, 9) as rate from raw),
parts as (select s, rate, greatest(1, ceil(rate / {MEAN_AT_ONCE}))::int as draws from rate),
terms as (select s, rate, draws, rate / draws as m, k.k from parts, range(0, {LARGEST + 1}) k(k)),
mass as (select s, draws, k, case when m = 0 then (case when k = 0 then 1.0 else 0.0 end) else exp(-m + k * ln(m) - lgamma(k + 1.0)) end as p from terms),
cdf as (select s, draws, k, sum(p) over (partition by s order by k) as c from mass),
drawn as (select d.doc_id as id, d.source as src, j.j as j, {u("j.j::varchar", "coalesce(d.doc_id::varchar, '')")} as u, coalesce(d.source, '') as s
          from documents d join parts p on p.s = coalesce(d.source, ''), range(0, 1000) j(j) where j.j < p.draws),
counts as (select id, j, count(*) filter (where c.c <= drawn.u) as n from drawn join cdf c on c.s = drawn.s group by id, j),
copies as (select id, sum(n)::int as n from counts group by id)
select d.*, k.k::int as copy, ({u("'shuffle'", "coalesce(d.doc_id::varchar, '')", "k.k::varchar")} * 4503599627370496.0)::bigint as shuffle_key
from documents d join copies c on c.id = d.doc_id, range(1, 1000) k(k) where k.k <= c.n"""
