"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

The expected number of copies of a document is its preference times a factor of its source, and ``most`` at the most. The
factor is the one at which the expected words of the source are its target. The whole part of that number
is certain. For the rest, documents are ranked by the odds of a random number over the odds of their inclusion
probability, and the first ones in that order are taken until their words come nearest the words that are left. The
random number is a hash of the document, so reruns agree.

Preferences count in steps of a quarter of a power of two, so a source has a bounded number of levels, and its factor follows
from their words alone.

No window holds a source. Documents are counted into ``BUCKETS`` ranges of their rank; only the one range
of a source in which the sample ends is sorted, and a document is taken if it ranks no later than the cut found there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD
from millrace.session import materialize

#: Ranges of the rank of a source.
BUCKETS = 4096

#: Levels of preference between a number and its double.
STEPS = 4

#: The name of a column, or a function of the column of sizes.
Preference = str | Callable[[Column], Column] | None


def by_length(size: Column) -> Column:
    """Texts of under 100 words count half of those of up to 399, and longer ones twice."""
    return F.when(size < 100, F.lit(0.5)).when(size < 400, F.lit(1.0)).otherwise(F.lit(2.0))


def word_count(text: str = "text") -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources in code-point order, null last, have the ``weights`` in turn and share all words by weight. Targets stop
    at ``most`` times the size of their source; what is above is shared again by weight among the others. With the
    sources in order of the share at which they stop, those that stop are the first ones, so running sums
    find the share of the others. One row per source is sorted, in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ceiling = F.lit(float(most)) * F.col("source_size")
    stops = totals.withColumn("weight", turn).withColumn("stop", ceiling / F.col("weight"))
    before = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shares = stops.withColumn("share", left / open_weight)
    level = F.max(F.when(F.col("stop") > F.col("share"), F.col("share"))).over(everything)
    target = F.least(ceiling, F.coalesce(level * F.col("weight"), ceiling))
    return shares.select("source", "source_size", target.alias("target"))


def factors(sources: DataFrame, levels: DataFrame, most: float = 3.0) -> DataFrame:
    """``sources`` with the ``factor`` of their preferences and ``rest``, the words that are left to the sample.

    ``levels`` has ``source, preference, size``, the words of each level. The most preferred levels are the first to
    stop at ``most`` copies, so running sums over the levels of a source find the factor of the others; it is null
    where all stop.
    """
    named = levels.withColumnRenamed("source", "__source")
    out = sources.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    order = W.partitionBy("source").orderBy(F.col("preference").desc())
    stopped = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    liked = F.sum(F.col("preference") * F.col("size")).over(order.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("share", F.try_divide(F.col("target") - stopped, liked))
    open_share = F.when(F.col("share") * F.col("preference") < most, F.col("share"))
    out = out.withColumn("factor", F.max(open_share).over(W.partitionBy("source")))
    sure = F.sum(F.floor(_expected(most)) * F.col("size"))
    summed = out.groupBy("source", "source_size", "target", "factor").agg(sure.alias("sure"))
    return summed.select("source", "source_size", "target", "factor", (F.col("target") - F.col("sure")).alias("rest"))


def _expected(most: float) -> Column:
    """Expected copies of a row with ``source_size, factor, preference``."""
    copies = F.coalesce(F.least(F.lit(float(most)), F.col("factor") * F.col("preference")), F.lit(float(most)))
    return F.when(F.col("source_size") > 0, copies).otherwise(F.lit(0.0))


def _ranked(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``rows`` with what is known of their source and their place in the sampling order: ``bucket``, ``odds``, ``tie``."""
    named = sources.withColumnRenamed("source", "__source")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    out = out.withColumn("expected", _expected(most)).withColumn("certain", F.floor("expected"))
    out = out.withColumn("chance", F.col("expected") - F.col("certain"))
    digits = F.substring(F.md5(F.concat(F.lit("42:"), F.col("tie")).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
    inclusion = F.col("chance") / (1 - F.col("chance"))
    out = out.withColumn("odds", F.when(F.col("chance") > 0, u / (1 - u) / inclusion).otherwise(F.lit(1e300)))
    return out.withColumn("bucket", F.floor(BUCKETS * (F.col("odds") / (1 + F.col("odds")))))


def _cuts(ranked: DataFrame) -> DataFrame:
    """Per source the range in which its sample ends, and the last place taken in it (null: none).

    A source whose rows are all certain has no sample and no range.
    """
    ranked = ranked.where("chance > 0")
    ranges = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy("bucket")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ranges.withColumn("before", before).where("before <= rest and rest < before + words")
    ends = ends.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "before")
    inside = ranked.join(
        ends, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket"))
    ).drop("__source", "__bucket")
    order = W.partitionBy("source").orderBy("odds", "tie", "size").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(order)
    place = F.struct("odds", "tie", "size")
    chosen = inside.withColumn("upto", upto).withColumn("place", F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), place))
    return chosen.groupBy("source", "bucket").agg(F.max("place").alias("cut")).withColumnRenamed("bucket", "cut_bucket")


def _rows(docs: DataFrame, preference: Preference) -> DataFrame:
    tie = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.struct("*").alias("doc"), "source", word_count().alias("size"), tie.alias("tie"))
    if preference is None:
        return rows.withColumn("preference", F.lit(1.0))
    liked = (F.col(f"doc.`{preference}`") if isinstance(preference, str) else preference(F.col("size"))).cast("double")
    rows = rows.withColumn("preference", F.when((liked > 0) & (liked < float("inf")), liked).otherwise(F.lit(1.0)))
    return rows.withColumn("preference", F.pow(F.lit(2.0), F.round(STEPS * F.log2("preference")) / STEPS))


def plan(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Targets, factors and cuts of all sources, one row each, written to the shared folder."""
    levels = materialize(rows.groupBy("source", "preference").agg(F.sum("size").alias("size")), "levels")
    sources = materialize(factors(source_targets(levels, weights, most), levels, most), "targets")
    cuts = _cuts(_ranked(rows, sources, most)).withColumnRenamed("source", "__source")
    return materialize(
        sources.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "cuts"
    )


def take(rows: DataFrame, planned: DataFrame, most: float) -> DataFrame:
    """``rows`` with ``source_size, target, copies, taken``. The plan is joined by Spark's choice: it broadcasts it if its
    written size is small, and else splits the large sources."""
    ranked = _ranked(rows, planned, most)
    sampled = (F.col("bucket") < F.col("cut_bucket")) | (
        (F.col("bucket") == F.col("cut_bucket")) & (F.struct("odds", "tie", "size") <= F.col("cut"))
    )
    extra = F.when(F.coalesce(sampled, F.lit(False)) & (F.col("chance") > 0), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("certain") + extra).cast("bigint")
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, preference: Preference = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` counts words of the whole text. ``preference`` multiplies the expected copies of a document (null, not above
    0, or not finite: 1); all of a source are scaled together to its target. Null and empty texts have size 0 and take no words. A null source is a source. Rows without id
    are ranked by a digest of their text. Repeated rows share a place in the order and stand beside each other. A source
    without words has target 0. An empty table gives an empty one.
    """
    wanted = list(dict.fromkeys(["doc_id", *([preference] if isinstance(preference, str) else [])]))
    rows = _rows(docs.select(*[F.col(f"`{c}`") for c in [*wanted, "text", "source"] if c in docs.columns]), preference)
    rows = materialize(rows.select(F.col("doc.doc_id").alias("doc_id"), "source", "size", "tie", "preference"), "sizes")
    out = take(rows, plan(rows, weights, most), most)
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, preference: Preference = None) -> DataFrame:
    """The rows of ``docs`` that are in the mix, with all their columns, and behind them ``copies``, ``size``,
    ``source_size``, ``target`` and ``taken``; one of these whose name ``docs`` has already gets an underscore behind it.

    Decided as in ``mix``.
    """
    rows = _rows(docs, preference)
    sizes = materialize(rows.select("source", "size", "tie", "preference"), "sizes")
    out = take(rows, plan(sizes, weights, most), most).where("copies > 0")
    added = {}
    for name in ("copies", "size", "source_size", "target", "taken"):
        free = name
        while free.lower() in {c.lower() for c in docs.columns}:
            free += "_"
        added[name] = free
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns], *[F.col(c).alias(free) for c, free in added.items()])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS tie
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
stops AS (SELECT *, 3.0::DOUBLE * source_size AS ceiling, 3.0::DOUBLE * source_size / weight AS stop FROM weighted),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
  FROM stops WINDOW o AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(ceiling, coalesce(max(CASE WHEN stop > share THEN share END) OVER () * weight, ceiling)) AS target
  FROM shares),
liked AS (
  SELECT *, CASE WHEN size < 100 THEN 0.5 WHEN size < 400 THEN 1.0 ELSE 2.0 END::DOUBLE AS preference FROM sized),
levels AS (SELECT source, preference, sum(size)::BIGINT AS words FROM liked GROUP BY source, preference),
level_shares AS (
  SELECT l.source, t.source_size, t.target, l.preference, l.words,
         (t.target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY preference DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(preference * words) OVER (PARTITION BY l.source ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS share
  FROM levels l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
level_factors AS (
  SELECT *, max(CASE WHEN share * preference < 3 THEN share END) OVER (PARTITION BY source) AS factor FROM level_shares),
level_copies AS (
  SELECT *, CASE WHEN source_size > 0 THEN coalesce(least(3.0::DOUBLE, factor * preference), 3.0) ELSE 0 END AS expected FROM level_factors),
planned AS (
  SELECT source, preference, source_size, target, floor(expected) AS certain, expected - floor(expected) AS chance,
         target - sum(floor(expected) * words) OVER (PARTITION BY source) AS rest
  FROM level_copies),
expected AS (
  SELECT s.doc_id, s.size, s.tie, s.source, p.source_size, p.target, p.certain, p.chance, p.rest,
         (('0x' || substr(md5('42:' || tie), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM liked s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source AND s.preference = p.preference),
odds AS (
  SELECT *, CASE WHEN chance > 0 THEN u / (1 - u) / (chance / (1 - chance)) ELSE 1e300 END AS odds FROM expected),
ordered AS (
  SELECT *, 2 * sum(CASE WHEN chance > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY floor(4096 * (odds / (1 + odds))), odds, tie, size
                                ROWS UNBOUNDED PRECEDING) - size AS middle2
  FROM odds)
SELECT doc_id, size, source_size, target,
       (certain + CASE WHEN chance > 0 AND middle2 <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       (size * (certain + CASE WHEN chance > 0 AND middle2 <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
