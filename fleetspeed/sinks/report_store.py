"""Stored speed reports: versioned, written month by month and read by month.

``data/write=<n>/year_month=<m>`` holds the rows of a month as write ``n`` left them, and
``versions/version=<n>`` which write owns each month.  A write puts down the months it changes and then
their owners, in one file, which makes it visible at once: readers of earlier versions are not
disturbed, and a write that fails leaves nothing visible.  Reads open only the directories of the
months asked for.  Writes of one store are made one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions.timekeys import month_text
from fleetspeed.operators import reports
from fleetspeed.schema import SPEED_COLUMNS, SPEED_SCHEMA

_VERSIONS = "year_month string, write long, version long"


@dataclass(frozen=True)
class ReportStore:
    spark: SparkSession
    path: str

    # Versions

    def _all_versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _VERSIONS)

    def versions(self) -> list[int]:
        """Numbers of the versions, from the directories alone."""
        return sorted(r["version"] for r in self._all_versions().select("version").distinct().collect())

    def owners(self, version: int | None = None) -> dict[str, int]:
        """The write that owns each month, in the latest or a given version: an entry a month."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise ValueError(f"no version {version} in {self.path}")
        if version is None:
            return {}
        rows = self._all_versions().where(F.col("version") == version).collect()
        return {r["year_month"]: r["write"] for r in rows}

    def _publish(self, owners: dict[str, int]) -> int:
        number = (self.versions() or [-1])[-1] + 1
        rows = self.spark.createDataFrame([(*o, number) for o in sorted(owners.items())], _VERSIONS)
        rows.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/versions")
        return number

    # Writes

    def _write(self, rows: DataFrame) -> tuple[int, list[str]]:
        """Rows put down as a new write, and its months."""
        number = max(self.owners().values(), default=-1) + 1
        target = f"{self.path}/data/write={number}"
        rows.select(*SPEED_COLUMNS).hint("rebalance", "year_month").write.mode("overwrite").partitionBy("year_month").parquet(target)
        months = self.spark.read.schema(SPEED_SCHEMA).parquet(target).select("year_month").distinct()
        return number, sorted(r["year_month"] for r in months.collect())

    def replace_months(self, report: DataFrame) -> int:
        """The months of a report take the place of what was stored for them; gives the new version."""
        number, months = self._write(report)
        return self._publish(self.owners() | dict.fromkeys(months, number))

    def upsert(self, changes: DataFrame) -> int:
        """Rows by route and month over what is stored: only months with changes are read and written.

        Of several changes of one route and month any may win; number them and use ``reports.upsert`` first.
        """
        changed = changes.select(*SPEED_COLUMNS).dropDuplicates(list(reports.KEY))
        months = sorted(r["year_month"] for r in changed.select("year_month").distinct().collect())
        stored = self._rows(self.owners(), months)
        kept = stored.join(changed, list(reports.KEY), "left_anti")
        return self.replace_months(kept.unionByName(changed)) if months else self._publish(self.owners())

    def restore(self, version: int) -> int:
        """An earlier version becomes the latest one again."""
        return self._publish(self.owners(version))

    # Reads

    def _rows(self, owners: dict[str, int], months: list[str] | None = None) -> DataFrame:
        chosen = sorted((w, m) for m, w in owners.items() if months is None or m in months)
        if not chosen:
            return self.spark.createDataFrame([], SPEED_SCHEMA)
        base = f"{self.path}/data"
        paths = [f"{base}/write={w}/year_month={m}" for w, m in chosen]
        return self.spark.read.schema(SPEED_SCHEMA).option("basePath", base).parquet(*paths).select(*SPEED_COLUMNS)

    def read(self, first: str | None = None, last: str | None = None, version: int | None = None) -> DataFrame:
        """Reports of all months or of an inclusive ``yyyy-MM`` range."""
        owners = self.owners(version)
        months = [m for m in owners if (first is None or m >= first) and (last is None or m <= last)]
        return self._rows(owners, months)

    def point(self, line_id: int, year: int, month: int) -> DataFrame:
        """One route in one month; no row means no data."""
        return self.monthly(year, month).where(F.col("line_id") == line_id)

    def monthly(self, year: int, month: int) -> DataFrame:
        return self.read(month_text(year, month), month_text(year, month))

    def in_range(self, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
        return self.read(month_text(*first), month_text(*last))

    def comparison(self, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
        """Line, month, speed and its display band over a range."""
        return reports.comparison(self.in_range(first, last), first, last)
