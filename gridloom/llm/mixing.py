"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight. Within a source, keys in ascending order are
prefix-summed to the source's token budget. Whole epochs come before the fractional selection. Main path: DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import cut

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Keys are first summed in so many ranges a source; only the range in which the budget ends is put in order.
RANGES = 8192
#: Ranges are even in the logarithm of the key between these; whatever lies outside is in the first or last one.
LOG_KEYS = (-16.0, 6.0)
#: Characters of markup and noise; their share lowers a document's quality weight.
NOISE = "#$%&*@^~|<>{}[]\\_="


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """In [0.05, 1]: one minus eight times the share of noise characters, less for texts under fifty words."""
    n = F.greatest(F.length(text), F.lit(1))
    noise = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / n
    clean = F.greatest(F.lit(0.1), 1 - 8 * noise)
    return F.coalesce(clean * F.least(F.lit(1.0), 0.5 + size / 100), F.lit(0.05))


def uniform(key: Column, salt: Column) -> Column:
    """In (0, 1), from 52 bits of MD5 of the key and the salt, so that reruns and other engines agree."""
    hexed = F.substring(F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), salt)), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size: a row a source) plus ``target``.

    Sources by code point, null last, weigh as ``cycle`` repeats, and share the total; a target stops at
    ``most_epochs`` times its source, the excess is shared anew by weight. In the end every open source has the same
    target per unit of weight, so sorting by the level at which a source fills and summing once gives it exactly.
    The table has one row a source, whatever the documents number; its windows run over all sources in one task, which is
    right while sources are counted in thousands.
    """
    place = W.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    ranked = sizes.withColumn("_weight", F.element_at(weights, ((F.row_number().over(place) - 1) % len(cycle) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (F.lit(float(most_epochs)) * F.col("source_size")))
    level = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    ranked = ranked.withColumns({
        "_share": (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))),
    })
    # The level is that of the first source, in the order of filling, whose cap lies at or above its share: shares rise
    # up to there and fall from there on.
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_cap") >= F.col("_share") * F.col("_weight"), F.col("_share"))).over(whole))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight")))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(documents: DataFrame, ranges: int = RANGES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each input row.

    ``taken`` counts the words that the mix takes, repeats included: whole epochs of the source first, then documents in
    the order of their keys until the rest of the budget (rounded down to a word) is used; the document at its end is
    taken in part. A source's taken words so equal its target, rounded down. No window runs over a source: keys
    are summed by range, and only the documents of the one range in which a source's budget ends are sorted.

    Null text: size 0. Null source: a source, last in order. Null doc_id: drawn like any key. Repeated rows: each is
    a row of its own; equal keys are ordered by doc_id, then size. Empty table: no rows. Other columns are ignored.
    """
    size = word_count(F.col("text"))
    drawn = documents.select("doc_id", "source", size.alias("size"), "text")
    u = uniform(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")))
    drawn = drawn.select("doc_id", "source", "size", (-F.log(u) / quality_weight(F.col("text"), F.col("size"))).alias("_key"))
    place = F.floor((F.log("_key") - LOG_KEYS[0]) / (LOG_KEYS[1] - LOG_KEYS[0]) * ranges)
    drawn = cut(drawn.withColumn("_range", F.least(F.greatest(place, F.lit(0)), F.lit(ranges - 1)).cast("int")), "mix")

    by_range = drawn.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    by_source = by_range.groupBy("source").agg(F.sum("_words").alias("source_size"))
    goal = targets(by_source)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("_epochs", epochs)
    goal = goal.withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))

    # At most RANGES rows a source are in order here.
    up_to = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = by_range.withColumn("_before", F.coalesce(F.sum("_words").over(up_to), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ends = ends.alias("a").join(goal.alias("b"), same).select("a.source", "a._range", "_words", "_before", "source_size", "target", "_epochs", "_rest")
    state = F.when(F.col("_before") + F.col("_words") <= F.col("_rest"), 2).when(F.col("_before") < F.col("_rest"), 1).otherwise(0)
    ends = ends.withColumn("_state", state)

    on = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d._range") == F.col("e._range"))
    rows = drawn.alias("d").join(ends.alias("e"), on)
    rows = rows.select("d.doc_id", "d.source", "d.size", "d._key", "source_size", "target", "_epochs", "_rest", "_before", "_state")
    running = W.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    last = rows.filter("_state = 1").withColumn("_sofar", F.col("_before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_sofar")))
    names = ["doc_id", "source", "size", "source_size", "target"]
    whole = rows.filter("_state <> 1").select(*names, (F.col("_epochs") * F.col("size") + F.when(F.col("_state") == 2, F.col("size")).otherwise(0)).alias("taken"))
    return whole.unionByName(last.select(*names, (F.col("_epochs") * F.col("size") + part).alias("taken")))
