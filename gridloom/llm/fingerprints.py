"""Document fingerprints by closed syncmers.

A text is a sequence of units: its words, and the single characters of words over LONG_WORD, so that text without spaces has units too.
Of each run of K units, the hashes of its inner runs of S units are compared; the run is an anchor if the smallest stands
first or last. Whether a run is one depends on its own units alone, so texts that share a passage share its
anchors, wherever it stands. Texts under FINE characters also have anchors over characters, as a few words have few runs; two texts
are compared by words, and by characters too where both have these, so any two texts have a kind in common.

A fingerprint keeps anchors with their places. Texts are matched by place: shared anchors count if they are displaced by
about as much as the middle one, so a passage that moved as a whole counts, and scattered coincidences do not.
Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, S = 5, 2
#: Of anchors over characters.
FINE_K, FINE_S, FINE = 8, 3, 512
LONG_WORD = 24
#: A fingerprint keeps its smallest hashes: so many, and one of each further KEPT_OF.
KEPT, KEPT_OF = 64, 16
#: Shared anchors match if their displacements differ from the middle one by so many units, or by this share of the longer text.
REACH, REACH_SHARE = 16, 8
#: Rows a range of doc_id, at most about.
ROWS_A_RANGE = 50_000
SPACE = r"[\x20\x09-\x0D]+"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words; one of more than LONG_WORD characters is given as its characters."""
    plain = F.filter(F.split(text, SPACE), lambda u: u != "")
    cut = F.flatten(F.transform(plain, lambda u: F.when(F.length(u) > LONG_WORD, F.split(u, "")).otherwise(F.array(u))))
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]{%d}" % (LONG_WORD + 1))), F.filter(cut, lambda u: u != "")).otherwise(plain)


def anchors(text: Column, k: int = K, s: int = S, fine: bool = False) -> Column:
    """array<struct<hash: long, place: int>>: each closed syncmer and where it begins, in units (characters if ``fine``).

    A text of fewer than ``k`` units is one anchor at 0, a text without units has none; null is empty.
    """
    text = F.coalesce(text, F.lit(""))
    units = F.filter(F.split(text, ""), lambda u: u != "") if fine else words_of(text)
    hashes = F.transform(units, lambda u: F.xxhash64(u))
    wide = k - s + 1

    def of(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)])) if s > 1 else h

        def pick(g: Column) -> Column:
            def one(i: Column) -> Column:
                ends = F.least(F.get(g, i), F.get(g, i + (wide - 1)))
                middle = [F.get(g, i + j) for j in range(1, wide - 1)]
                closed = ends <= (F.least(*middle) if len(middle) > 1 else middle[0]) if middle else F.lit(True)
                return F.when(closed, F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash"), i.cast("int").alias("place")))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - k), one), lambda a: a.isNotNull())

        whole = F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("place")))
        none = F.array().cast("array<struct<hash:bigint,place:int>>")
        return F.when(F.size(h) >= k, _bind(inner, pick)).when(F.size(h) > 0, whole).otherwise(none)

    return _bind(hashes, of)


def sketch(found: Column, kept: int = KEPT, kept_of: int = KEPT_OF) -> Column:
    """struct<hashes: array<long>, places: array<int>>: the smallest distinct hashes of anchors, ascending, and where each stands first."""

    def distinct(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (x["hash"] != F.get(a, i - 1)["hash"]))

    def smallest(a: Column) -> Column:
        few = F.slice(a, F.lit(1), F.lit(kept) + F.floor(F.greatest(F.size(a) - kept, F.lit(0)) / kept_of).cast("int"))
        return _bind(few, lambda x: F.struct(F.transform(x, lambda y: y["hash"]).alias("hashes"), F.transform(x, lambda y: y["place"]).alias("places")))

    return _bind(F.sort_array(found), lambda a: _bind(distinct(a), smallest))


def fingerprint(text: Column) -> Column:
    """struct<words, fine>: the sketches of a text's anchors over words and, if it has fewer than FINE characters, over characters."""
    short = F.length(F.coalesce(text, F.lit(""))) < FINE
    return F.struct(sketch(anchors(text)).alias("words"), sketch(anchors(F.when(short, text), FINE_K, FINE_S, fine=True)).alias("fine"))


def printed(print_: Column) -> Column:
    """Hashes and places in hexadecimal: ``hash@place`` of words, then, after a bar, of characters."""

    def side(x: Column) -> Column:
        return F.array_join(F.zip_with(x["hashes"], x["places"], lambda h, p: F.concat(F.hex(h), F.lit("@"), F.hex(p))), ",")

    return F.concat(side(print_["words"]), F.lit("|"), side(print_["fine"]))


def _alike(a: Column, b: Column, kept: int) -> Column:
    """Of the smallest anchors of both sketches together, the share that stands in both at matching places."""
    # A sketch of fewer than ``kept`` is complete, so so many smallest of the union are known.
    k = F.greatest(F.lit(kept), F.least(F.size(a["hashes"]), F.size(b["hashes"])))
    both = F.slice(F.array_sort(F.array_union(a["hashes"], b["hashes"])), F.lit(1), k)

    def share(every: Column) -> Column:
        shared = F.array_intersect(every, F.array_intersect(a["hashes"], b["hashes"]))
        place = lambda x, h: F.get(x["places"], (F.array_position(x["hashes"], h) - 1).cast("int"))
        moved = F.transform(shared, lambda h: place(b, h) - place(a, h))
        reach = F.greatest(F.lit(REACH), F.floor(F.greatest(F.array_max(a["places"]), F.array_max(b["places"])) / REACH_SHARE))

        def near(m: Column) -> Column:
            middle = F.get(m, F.floor(F.size(m) / 2).cast("int"))
            return F.size(F.filter(m, lambda x: F.abs(x - middle) <= reach)) / F.greatest(F.size(every), F.lit(1))

        return F.when(F.size(shared) > 0, _bind(F.array_sort(moved), near)).otherwise(0.0)

    return _bind(both, share)


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Of two fingerprints, in [0, 1]: by words, or by characters where both have these and it is larger; two texts without words are alike."""
    fine = F.when((F.size(a["fine"]["hashes"]) > 0) & (F.size(b["fine"]["hashes"]) > 0), _alike(a["fine"], b["fine"], kept)).otherwise(0.0)
    none = F.size(a["words"]["hashes"]) + F.size(b["words"]["hashes"]) == 0
    return F.when(none, 1.0).otherwise(F.greatest(_alike(a["words"], b["words"], kept), fine))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(int(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def _range(key: Column, sub: Column, bounds: list[int]) -> Column:
    """Which range a row belongs to, ascending by (key, sub). A key that is a bound several times is split by ``sub``, a hash."""
    times = Counter(bounds)
    unique = sorted(times)
    begin, at = [0], 1  # below the first bound
    for b in unique:
        begin.append(at)
        at += times[b] + 1 if times[b] > 1 else 1
    place = _bucket(key, unique)
    table = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), place)
    hot = [0, *(times[b] if times[b] > 1 else 0 for b in unique)]
    if not any(hot):
        return table(begin)
    here = key == table([0, *unique])
    split = F.floor((F.shiftright(sub, 32) + F.lit(1 << 31)) * table(hot) / float(1 << 32)).cast("int")
    return table(begin) + F.when(table(hot) > 0, F.when(here, split).otherwise(table(hot))).otherwise(0)


def compare_edited(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each input row.

    The edited text of a document has its last n_chars // 4 code points replaced by the first as many (or all) of the
    next document's: the next row by doc_id, of equal ones by the hash of the text; after the last comes the first.
    Rows are dealt into ranges of doc_id, each with a copy of the next range's first row, so texts are shuffled
    once and no task orders more than its ranges.

    Null text: empty. A null doc_id comes before all others. Repeated rows follow one another. A single row is its own
    next. Empty table: no rows. Other columns are ignored; an input column n_chars is not read.
    """
    spark = documents.sparkSession
    # Below every id; ids at that bound itself only share its place in the order.
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", key)
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // ROWS_A_RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("_key", shares, 100 * ranges).alias("b")).first()["b"] or []
    docs = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_range", _range(F.col("_key"), F.col("_hash"), bounds))
    # A row a range.
    first = sorted((r["_range"], r["k"]["_key"], r["k"]["_hash"]) for r in docs.select("_range", "_key", "_hash").groupBy("_range").agg(F.min(F.struct("_key", "_hash")).alias("k")).collect())
    links = [(*first[(i + 1) % len(first)][1:], first[i][0]) for i in range(len(first))]
    ends = F.broadcast(spark.createDataFrame(links, "_key long, _hash long, _before int"))

    own = F.struct(F.col("_range").cast("int").alias("at"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("at"), F.lit(True).alias("copy"))
    rows = docs.withColumn("_print", fingerprint(F.col("text"))).join(ends, ["_key", "_hash"], "left")
    rows = rows.withColumn("_place", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.select("doc_id", "text", "_key", "_hash", "_print", F.col("_place.at").alias("_at"), F.col("_place.copy").alias("_copy"))
    order = W.partitionBy("_at").orderBy("_copy", "_key", "_hash")
    rows = rows.withColumns({"_next": F.lead("text").over(order), "_next_print": F.lead("_print").over(order)}).filter("not _copy")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_print", "_next_print")
    rows = rows.withColumn("_edited_print", fingerprint(F.col("_edited")))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        printed(F.col("_print")).alias("fingerprint"),
        printed(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
