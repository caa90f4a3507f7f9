"""Tables that are kept in a shared folder and change together, one version at a time.

A commit writes the new parts of every table first, under names of their own, and one
manifest last, which names the parts of each table.  Readers go by the newest manifest, so
they see all changes of a commit or none; a commit that fails leaves files that nothing names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lorebase.operators.shared import delete_path


@dataclass(frozen=True)
class Part:
    """Files of one write: their folder below the store's, and their schema."""

    path: str
    schema: str


@dataclass(frozen=True)
class Version:
    """What a manifest says: parts by table, and single values such as counts."""

    number: int = 0
    tables: dict[str, list[Part]] = field(default_factory=dict)
    facts: dict[str, float] = field(default_factory=dict)

    def with_parts(self, **new: Part | list[Part]) -> Version:
        """The next version, with a part added to a table (Part) or all its parts replaced (list)."""
        tables = dict(self.tables)
        for name, part in new.items():
            tables[name] = part if isinstance(part, list) else [*tables.get(name, []), part]
        return Version(self.number + 1, tables, dict(self.facts))


class Conflict(Exception):
    """Another commit of the same version was first."""


class Store:
    """The tables below one folder of a store that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self, number: int | None = None) -> list[tuple[int, str, str]]:
        where = f"{self.path}/manifests/{'*' if number is None else f'{number:012d}'}"
        try:
            rows = self.spark.read.schema("number long, token string, body string").json(where)
            newest = rows.orderBy(rows["number"].desc(), "token").limit(2)
            return [tuple(r) for r in newest.collect()]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def current(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number; version 0 has no tables."""
        found = self._manifests(number)
        if not found:
            if number:
                raise ValueError(f"no version {number} in {self.path}")
            return Version()
        body = json.loads(found[0][2])
        tables = {name: [Part(**p) for p in parts] for name, parts in body["tables"].items()}
        return Version(found[0][0], tables, body["facts"])

    def write(self, name: str, df: DataFrame) -> Part:
        """Files of ``df``, which no version names yet."""
        path = f"parts/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{path}")
        return Part(path, df.schema.json())

    def read(self, version: Version, name: str) -> DataFrame | None:
        """A table of a version, or None if it has no part; parts may lack columns of later ones."""
        by_schema: dict[str, list[str]] = {}
        for part in version.tables.get(name, []):
            by_schema.setdefault(part.schema, []).append(f"{self.path}/{part.path}")
        if not by_schema:
            return None
        read = [self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in by_schema.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)

    def commit(self, version: Version) -> Version:
        """Make ``version`` the newest.  Its manifest is one file, which the write moves in place at its end.

        Of two writers of one number the one of the smaller token stays, and the other raises.
        """
        token = uuid.uuid4().hex
        body = json.dumps({"tables": {n: [vars(p) for p in parts] for n, parts in version.tables.items()}, "facts": version.facts})
        row = self.spark.createDataFrame([(version.number, token, body)], "number long, token string, body string")
        try:
            row.coalesce(1).write.json(f"{self.path}/manifests/{version.number:012d}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_ALREADY_EXISTS":
                raise Conflict(f"version {version.number} is there") from e
            raise
        if self._manifests(version.number)[0][1] != token:
            raise Conflict(f"version {version.number} is there")
        return version

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the newest ``keep`` and every part that none of the kept ones names; their folders.

        Parts that a writer has written but not committed yet would go too: sweep when nothing writes.
        """
        newest = self.current().number
        kept = [self.current(n) for n in range(max(1, newest - keep + 1), newest + 1)] if newest else []
        named = {f"{self.path}/{p.path}" for v in kept for parts in v.tables.values() for p in parts}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/parts").select("path")
        folders = {r["path"].rsplit("/", 1)[0] for r in files.selectExpr("regexp_replace(path, '/[^/]*$', '/') AS path").distinct().collect()}
        tail = lambda p: p.split("/parts/", 1)[1]
        orphans = sorted(f for f in folders if tail(f) not in {tail(n) for n in named})
        for folder in orphans:
            delete_path(self.spark, folder)
        for n in range(1, newest - keep + 1):
            delete_path(self.spark, f"{self.path}/manifests/{n:012d}")
        return orphans
