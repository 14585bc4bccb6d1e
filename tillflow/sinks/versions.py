"""Tables kept as committed versions: readers never see a write that did not end.

A write goes to a folder of its own. Once it stands, one row in the table of commits
names it, and that row is one file, so it is there or not. A version that is written
again (a micro-batch after a failure) replaces itself. Nothing is renamed, which
object stores cannot do, and nothing old is touched before the new version counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "version BIGINT, kind STRING"
#: A part adds to the versions before it, a whole table replaces them.
PART, WHOLE = "part", "whole"


@dataclass(frozen=True)
class Versions:
    """A folder of versions in one file format; ``schema`` is that of their rows.

    Columns named in ``partitions`` stand last in the schema and become folders.
    """

    path: str
    schema: str
    fmt: str = "parquet"
    options: tuple[tuple[str, str], ...] = ()
    partitions: tuple[str, ...] = ()

    def _folder(self, version: int, kind: str) -> str:
        return f"{self.path}/data/version={version}/kind={kind}"

    def write(self, rows: DataFrame, version: int, kind: str = PART) -> None:
        """Write ``rows`` as a version and commit it; a repeated call replaces itself."""
        folder = self._folder(version, kind)
        writer = rows.write.mode("overwrite").format(self.fmt).options(**dict(self.options))
        writer.partitionBy(*self.partitions).save(folder)
        commit = rows.sparkSession.range(1).select(
            F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind")
        )
        # One row, one file: the commit is there or not.
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version}-{kind}")

    def commits(self, spark: SparkSession) -> list[tuple[int, str]]:
        """Committed versions that count: the last whole table and the parts after it."""
        try:
            found = spark.read.schema(_COMMITS).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        except AnalysisException:  # nothing has been committed yet
            return []
        every = found.select("version", "kind")
        last = every.filter(F.col("kind") == WHOLE).agg(F.max("version")).first()[0]
        if last is None:
            return sorted(map(tuple, every.collect()))
        parts = every.filter((F.col("kind") == PART) & (F.col("version") > last))
        return [(last, WHOLE), *sorted(map(tuple, parts.collect()))]

    def next_version(self, spark: SparkSession) -> int:
        return max((version for version, _ in self.commits(spark)), default=-1) + 1

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of all versions that count, each with its ``version``."""
        return self._load(spark, self.commits(spark))

    def read_version(self, spark: SparkSession, version: int) -> DataFrame:
        """Rows of one committed part."""
        return self._load(spark, [(version, PART)])

    def read_last(self, spark: SparkSession) -> DataFrame:
        """Rows of the last version alone."""
        return self._load(spark, self.commits(spark)[-1:])

    def _load(self, spark: SparkSession, commits: list[tuple[int, str]]) -> DataFrame:
        schema = f"{self.schema}, version BIGINT, kind STRING"
        if not commits:
            return spark.createDataFrame([], schema).drop("kind")
        reader = spark.read.format(self.fmt).schema(schema).options(**dict(self.options))
        folders = [self._folder(*commit) for commit in commits]
        return reader.option("basePath", f"{self.path}/data").load(folders).drop("kind")

    def latest(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """For each key the row of its last version."""
        rows = self.read(spark)
        values = [c for c in rows.columns if c not in (*keys, "version")]
        last = F.max_by(F.struct(*values), "version").alias("last")
        return rows.groupBy(*keys).agg(last).select(*keys, *[f"last.{c}" for c in values])

    def compact(self, spark: SparkSession, keys: list[str]) -> None:
        """Fold the versions into a whole table under the last one's number."""
        commits = self.commits(spark)
        if len(commits) > 1:
            self.write(self.latest(spark, keys), commits[-1][0], WHOLE)
