"""URL filter: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests confirm.

Rules are few shapes: so many labels of the host, so many characters of the path. Each shape is one expression of a URL and
one join with the rules of that shape, by a short prefix of the expression's hash; a row meets one row of the rules at most, so rows are neither
multiplied nor gathered, and pages are not shuffled while the rules are small enough to be sent to all.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (rule, verdict). A rule is a host and a path joined; its path begins at the first slash.
BASE_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The method's own rules, asked where no base rule fits; they go through the same expressions.
OWN_RULES = tuple((f"{name}.example.{top}/", "block") for name in ("spam-farm", "cheap-pills", "casino-win", "casino-bonus", "free-money") for top in ("com", "net", "org"))
PREFIX_BITS = 32
#: Rule sets of up to so many bytes go to all executors; larger ones are joined by a shuffle on the hash prefix.
BROADCAST_BYTES = 8 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the
    end. Null or no ``://``: both empty."""
    tail = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BITS // 4)


def rule_table(like: DataFrame, rules: Sequence[tuple[str, str]], own: Sequence[tuple[str, str]]) -> dict[tuple[int, int], DataFrame]:
    """By shape (labels, path characters): a row a short hash, with the rules under it. Of a rule given twice with two verdicts,
    block stays; of one that is both given and the method's own, the given one."""
    shapes: dict[tuple[int, int], dict[str, tuple[int, str]]] = {}
    for rank, listed in ((1, rules), (0, own)):
        for rule, verdict in listed:
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"not a rule: {rule!r} {verdict!r}")
            at = rule.index("/")
            rows = shapes.setdefault((rule[:at].count(".") + 1, len(rule) - at), {})
            if rule not in rows or (rows[rule][0] == rank and verdict == "block"):
                rows[rule] = rank, verdict
    out = {}
    for shape, rows in sorted(shapes.items()):
        made = like.sparkSession.createDataFrame([(rank, rule, verdict) for rule, (rank, verdict) in sorted(rows.items())], "_rank int, _rule string, _rule_verdict string")
        made = made.withColumn("_digest", _digest(F.substring_index("_rule", "/", 1), F.expr("substring(_rule, instr(_rule, '/'))")))
        listed = F.collect_list(F.struct("_rank", F.length("_rule").alias("_size"), "_rule", "_rule_verdict", "_digest"))
        out[shape] = made.groupBy(_short(F.col("_digest")).alias("_short")).agg(listed.alias("_listed"))
    return out


def _confirmed(listed: Column, digest: Column) -> Column:
    return F.filter(listed, lambda r: r["_digest"] == digest)


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = BASE_RULES, own: Sequence[tuple[str, str]] = OWN_RULES) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``; one row for each input row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins, of equally long ones the last by
    code point. Each URL has an expression for each shape of rule: its last so many labels, its path's first so many characters; so
    expressions a URL are bounded by the rule set, not by the URL. An expression meets the rules of its shape by a hash prefix of
    PREFIX_BITS; the whole SHA-256 confirms. Where no given rule fits, ``rule`` is null and the verdict is that of the
    longest of the method's own rules, or allow.

    Null or broken URLs have empty host and path and are allowed. Repeated rows and ties stay rows of their own; an empty
    table gives an empty one. Input columns named like an output column are replaced; others pass through.
    """
    # Input columns are numbered meanwhile, so that no working column can have the name of one.
    named = [F.col(f"_in{k}").alias(c) for k, c in enumerate(pages.columns) if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.toDF(*[f"_in{k}" for k in range(len(pages.columns))])
    at = next(k for k, c in enumerate(pages.columns) if c.lower() == url_col.lower())
    host, path = host_path(F.col(f"_in{at}"))
    rows = rows.withColumns({"_host": host, "_path": path})
    labels = F.size(F.split("_host", r"\."))
    fits = []
    small = sum(len(rule) + 100 for rule, _ in (*rules, *own)) <= BROADCAST_BYTES
    for k, ((n, size), table) in enumerate(rule_table(pages, rules, own).items()):
        has = (labels >= n) & (F.length("_path") >= size)
        rows = rows.withColumn(f"_digest{k}", F.when(has, _digest(F.substring_index("_host", ".", -n), F.substring("_path", 1, size))))
        table = table.withColumnRenamed("_listed", f"_listed{k}")
        rows = rows.withColumn("_short", _short(F.col(f"_digest{k}"))).join(F.broadcast(table) if small else table, "_short", "left").drop("_short")
        fits.append(_confirmed(F.col(f"_listed{k}"), F.col(f"_digest{k}")))
    none = F.array().cast("array<struct<_rank:int,_size:int,_rule:string,_rule_verdict:string,_digest:string>>")
    best = F.array_max(F.concat(none, *[F.coalesce(f, none) for f in fits]))
    judged = rows.withColumn("_best", best)
    return judged.select(
        *named,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best._rank") == 1, F.col("_best._rule")).alias("rule"),
        F.coalesce(F.col("_best._rule_verdict"), F.lit("allow")).alias("verdict"),
    )
