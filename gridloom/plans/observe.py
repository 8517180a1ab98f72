"""Flag rates from the pass that writes the flags: counts are observed while the rows go by, and no second pass is made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.jobs import elapsed

#: Counters of the observed sketch. Two for each key fit with room to spare, so up to MOST keys are counted exactly; more are an error, never an estimate.
COUNTERS = 1 << 17
MOST = COUNTERS // 4


@dataclass
class Report:
    """What was observed, once the action on the watched table is done."""

    observation: Observation = field(default_factory=lambda: Observation("flags"))
    seconds: float | None = None

    def totals(self) -> tuple[int, int]:
        """(samples, flagged)"""
        got = self.observation.get
        return got["n"], got["flagged"]

    def rates(self) -> list[tuple[str | None, int, int]]:
        """(key as text, samples, flagged) for each key; ValueError if there were more than MOST keys."""
        got, counts = self.observation.get, {}
        for x in got["by_key"] or []:
            said = x["item"]
            counts.setdefault(None if said[1] == "-" else said[2:], [0, 0])[said[0] == "t"] += x["count"]
        if sum(map(sum, counts.values())) != got["n"] or len(counts) > MOST:
            raise ValueError(f"more than {MOST} keys")
        return sorted(((k, sum(v), v[1]) for k, v in counts.items()), key=lambda x: (x[0] is None, x[0] or ""))

    def table(self, spark: SparkSession) -> DataFrame:
        """(key, n, flagged, percent)"""
        rows = [(k, n, f, 100.0 * f / n) for k, n, f in self.rates()]
        return spark.createDataFrame(rows, "key string, n long, flagged long, percent double")


def watched(flags: DataFrame, key: str = "baseline", flag: str = "flag") -> tuple[DataFrame, Report]:
    """``flags`` as it is, and a report of it that the first action on it fills. A flag is a boolean or a number; null is no flag."""
    report = Report()
    hit = F.coalesce(F.col(flag).cast("int") != 0, F.lit(False))
    said = F.concat(F.when(hit, "t").otherwise("f"), F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    marked = flags.withColumn("_said", said)
    seen = marked.observe(report.observation, F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("flagged"), F.expr(f"approx_top_k(_said, {COUNTERS // 2}, {COUNTERS})").alias("by_key"))
    return seen.drop("_said"), report


def write_flags(flags: DataFrame, path: str, key: str = "baseline", flag: str = "flag") -> Report:
    """Writes ``flags`` as Parquet; the report knows the rates by ``key`` and the seconds of that write."""
    seen, report = watched(flags, key, flag)
    _, report.seconds = elapsed(lambda: seen.write.parquet(path))
    return report
