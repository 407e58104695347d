"""Partial aggregates kept by day, each day replaced as a whole.

A commit writes the days it changes as a new version beside the old ones
(``data/day=.../version=N``) and then a manifest that names the version of every
day. Only the manifest makes a version count, so a commit that is cut short
changes nothing, and running it again with the same token changes nothing after it
has succeeded. Readers open exactly the folders the manifest names.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsense.sources.files import delete, read_text, replace_text

DAY = "day"
TOKENS_KEPT = 1000         # tokens of earlier commits that the manifest remembers, per writer the last one


@dataclass
class DayStore:
    """``schema``: the columns of a partial, without the day. ``merge`` adds up
    rows of several commits (columns of ``schema`` and the day) into the rows that
    the store keeps, for each day on its own."""
    spark: SparkSession
    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]

    def __post_init__(self):
        self.path = self.path.rstrip("/")

    def manifest(self) -> dict:
        """``{"version": N, "days": {day: version}, "tokens": {writer: last token}}``."""
        text = read_text(self.spark, f"{self.path}/manifest")
        return json.loads(text) if text else {"version": 0, "days": {}, "tokens": {}}

    def days(self) -> list[_dt.date]:
        return sorted(map(_dt.date.fromisoformat, self.manifest()["days"]))

    def read(self, first: _dt.date | None = None, last: _dt.date | None = None) -> DataFrame:
        """The partials of the days from ``first`` to ``last`` (all without them)."""
        named = self.manifest()["days"]
        return self._read({d: v for d, v in named.items()
                           if (first is None or d >= first.isoformat()) and (last is None or d <= last.isoformat())})

    def _folder(self, day: str, version: int) -> str:
        return f"{self.path}/data/{DAY}={day}/version={version}"

    def _read(self, named: dict[str, int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(DAY, T.DateType())])
        if not named:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())]))
                .option("basePath", f"{self.path}/data")
                .parquet(*[self._folder(d, v) for d, v in sorted(named.items())]).select(*schema.fieldNames()))

    def commit(self, partials: DataFrame, token: tuple[str, int] | None = None) -> list[_dt.date]:
        """Merge ``partials`` (columns of the schema and ``day``) into their days;
        returns these days. Other days are neither read nor written.

        ``token`` is (writer, number): a number not above the writer's last one
        has been committed and is left out.
        """
        now = self.manifest()
        if token is not None and now["tokens"].get(token[0], -1) >= token[1]:
            return []
        days = sorted(r[0] for r in partials.select(DAY).where(F.col(DAY).isNotNull()).distinct().collect())
        version = now["version"] + 1
        if days:
            before = {d.isoformat(): now["days"][d.isoformat()] for d in days if d.isoformat() in now["days"]}
            names = [*self.schema.fieldNames(), DAY]
            merged = self.merge(self._read(before).unionByName(partials.where(F.col(DAY).isNotNull()).select(*names)))
            (merged.select(*names).withColumn("version", F.lit(version)).hint("rebalance", DAY)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(DAY, "version").parquet(f"{self.path}/data"))
        tokens = dict(list(now["tokens"].items())[-TOKENS_KEPT:])
        if token is not None:
            tokens.pop(token[0], None)
            tokens[token[0]] = token[1]
        self._announce({"version": version, "days": now["days"] | {d.isoformat(): version for d in days},
                        "tokens": tokens, "before": {d.isoformat(): now["days"].get(d.isoformat()) for d in days}})
        # what the manifest before this one named may still be read; what that one had replaced goes
        self._sweep(now)
        return days

    def _announce(self, manifest: dict) -> None:
        replace_text(self.spark, f"{self.path}/manifest", json.dumps(manifest))

    def _sweep(self, manifest: dict) -> None:
        for day, version in (manifest.get("before") or {}).items():
            if version is not None:
                delete(self.spark, self._folder(day, version))
