"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's mean repetition rate is its target share of the budget over its size. Each document's count inverts the Poisson
distribution with that mean at numbers seeded by the hash of its id; the document is exploded by its count, and the
copies are dealt out by a second hash, in whose order each partition is sorted: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import ensure_checkpoint_dir

#: Sources up to this number are broadcast; the bound is checked by a count. More are joined on salted keys.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 32
#: A greater mean is the sum of equal parts up to this mean, each inverted at a number of its own: sums of Poisson counts are Poisson.
PART_MEAN = 32.0
#: Terms of a part's distribution function; at a mean of 32 the rest beyond 128 is below 1e-30.
TERMS = 128


def unit_hash(key: Column, seed: str) -> Column:
    """A number above 0 and below 1 from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str = "source", size: Column | None = None, weights: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """One row per source (null is one too): source, size, rate.

    size sums ``size`` (code points of text unless given, at least 1 a document, so that empty ones can be drawn too).
    Without weights a source's target is the square root of its size. ``weights`` fixes targets; sources it leaves out
    get none. budget is the mixture's size, the input's unless given. No rows, no sources.
    """
    each = F.greatest(F.coalesce(size if size is not None else F.length("text"), F.lit(0)), F.lit(1)).cast("bigint")
    ensure_checkpoint_dir(docs.sparkSession)
    # written once: the sum of targets, the size check and the join read these few rows again, not the documents
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(each).alias("size")).checkpoint()
    # targets are whole numbers, so that their sum does not depend on the order of rows
    if weights is None:
        target = F.floor(F.sqrt(F.col("size").cast("double")) * 1000).cast("bigint")
    elif weights:
        parts = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, round(w * 1_000_000))])
        target = F.coalesce(F.element_at(parts, F.col("source")).cast("bigint"), F.lit(0))
    else:
        target = F.lit(0)
    sums = sums.withColumn("target", target)
    total = sums.agg(F.sum("target").cast("double").alias("targets"), F.sum("size").cast("double").alias("sizes"))
    spent = F.lit(float(budget)) if budget is not None else F.col("sizes")
    joined = sums.crossJoin(F.broadcast(total))  # one row on the right
    return joined.select("source", "size", F.when(F.col("targets") > 0, spent * F.col("target") / F.col("targets") / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_sums(rate: Column) -> tuple[Column, Column]:
    """(parts, sums): how many equal parts the mean has, and P(N <= k) for k = 0 .. TERMS - 1 of one part."""
    parts = F.greatest(F.ceil(rate / PART_MEAN), F.lit(1)).cast("bigint")
    mean = rate / parts
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums")),
        lambda a, i: F.struct((a["term"] * mean / i).alias("term"), F.array_append(a["sums"], F.element_at(a["sums"], -1) + a["term"] * mean / i).alias("sums")),
    )
    return parts, state["sums"]


def mix_sources(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, budget: float | None = None, seed: str = "mix", max_broadcast: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """The columns of ``docs`` with _rate, _replica (from 0) and _order: a number in [0, 1) by which copies are globally shuffled.

    A null key counts as the empty string, a null source as a source of its own. Rows with equal keys get equal counts.
    Documents whose count is 0 are not drawn; that is the method's thinning of sources with too much. Input columns
    named like the three new ones are replaced, others keep their values whatever their names. An empty table gives no
    rows. Copies come in partitions by ranges of _order, sorted within.
    """
    docs = docs.drop("_rate", "_replica", "_order")
    rates = source_rates(docs, source, None if "text" in docs.columns else F.lit(1), weights, budget)
    parts, sums = poisson_sums(F.col("rate"))
    tables = rates.select("source", "rate", parts.alias("parts"), sums.alias("sums"))
    # input rows travel as one struct, so that no name of theirs meets one of ours
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("name"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("ident"))
    if rates.limit(max_broadcast + 1).count() <= max_broadcast:
        joined = packed.join(F.broadcast(tables), F.col("name").eqNullSafe(F.col("source")))
    else:
        # a hot source is spread over SALTS keys, each rate is repeated as often; null becomes a key of its own
        named = lambda c: F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c.cast("string"), F.lit("")))
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).withColumn("name", named(F.col("name")))
        many = tables.withColumn("name", named(F.col("source"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(many, ["name", "salt"])
    # of each part the least k with P(N <= k) > u: as many sums as lie at or below u
    drawn = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("parts")), lambda j: unit_hash(F.concat_ws(":", j.cast("string"), F.col("ident")), seed))
    n = F.aggregate(drawn, F.lit(0).cast("bigint"), lambda a, u: a + F.size(F.filter("sums", lambda p: p <= u)))
    counted = joined.select("row", "ident", "rate", n.alias("n"))
    copies = counted.where("n > 0").select("row", "ident", "rate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("replica"))
    ordered = copies.withColumn("order", unit_hash(F.concat("ident", F.lit(":"), F.col("replica").cast("string")), seed + "-order"))
    # the order is uniform by construction, so equal ranges are equal parts and no sampling pass is needed
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionById(ranges, F.floor(F.col("order") * ranges).cast("int")).sortWithinPartitions("order", "ident", "replica")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("rate").alias("_rate"), F.col("replica").alias("_replica"), F.col("order").alias("_order"))


#: The same in DuckDB, for a table with doc_id, text and source; {docs} names it.
MIX_SQL = """
with sized as (select *, greatest(coalesce(length(text), 0), 1)::BIGINT as _size from {docs}),
sums as (select source, sum(_size)::BIGINT as size, floor(sqrt(sum(_size)::DOUBLE) * 1000)::BIGINT as target from sized group by source),
total as (select sum(target)::DOUBLE as targets, sum(size)::DOUBLE as sizes from sums),
rates as (select source, sizes * target / targets / size as rate from sums, total),
drawn as (
  select d.* exclude (_size), r.rate,
    list_transform(range(1, greatest(ceil(r.rate / 32.0), 1)::BIGINT + 1), lambda j:
      (('0x' || substr(md5('mix:' || j::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) as us
  from sized d join rates r on d.source is not distinct from r.source),
cdf as (
  select rate, list(upto order by k) as sums
  from (select rate, k, sum(p) over (partition by rate order by k rows unbounded preceding) as upto
    from (select rate, k, exp(-m + k * ln(m) - lgamma(k + 1)) as p
        from (select distinct rate, rate / greatest(ceil(rate / 32.0), 1) as m from rates) r, range(0, 128) t(k)))
  group by rate),
counted as (
  select d.* exclude (us), list_sum(list_transform(d.us, lambda u: len(list_filter(c.sums, lambda p: p <= u))))::BIGINT as n
  from drawn d join cdf c on c.rate = d.rate)
select *, (('0x' || substr(md5('mix-order:' || coalesce(doc_id::VARCHAR, '') || ':' || replica::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE as order_key
from (select * exclude (n), unnest(range(0, n)) as replica from counted where n > 0)
"""
