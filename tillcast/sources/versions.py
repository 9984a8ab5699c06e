"""Stored tables in versions: a write becomes visible by its manifest, which comes last.

A table is a folder. Each write makes a new data folder (a segment); a version is a list of
segments, named in a manifest file with the version's number. Readers take the manifest with
the highest number, so a write that fails half-way leaves the version before it as it was,
and readers that have begun keep the segments they know. A manifest is created only where its
number is free: of two writers that meet, the second one finds the new version and goes on from
there. Uploads carry an id, by default a fingerprint of their rows, and an id that the table
already holds is not stored again.

Nothing enters the session's catalog.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\n#end\n"  # closes a manifest; one without it is still being written


class NoSuchVersion(LookupError):
    """The table has no version, or not the one asked for."""


@dataclass(frozen=True)
class Version:
    """What one manifest says."""

    number: int
    segments: tuple[str, ...]
    rows: int
    schema: str
    uploads: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Staged:
    """A written segment that no version names yet."""

    segment: str
    rows: int
    schema: str


def row_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates that are the same for the same rows, whatever their order and files."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    again = F.xxhash64(*[F.col(f"`{c}`") for c in reversed(columns)], F.lit(len(columns)))
    return [F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"),
            F.sum(again.cast("decimal(38,0)")).alias("b")]


def upload_id(sums: dict) -> str:
    """The fingerprint of rows with these ``row_sums``."""
    return f"{sums['n']:x}-{int(sums['a'] or 0):x}-{int(sums['b'] or 0):x}"


def fingerprint(frame: DataFrame) -> str:
    """The same for the same rows; one pass, nothing shuffled but one row per task."""
    return upload_id(frame.agg(*row_sums(frame.columns)).first().asDict())


class VersionedTable:
    """A table below ``root``, on storage that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    # -- reading --------------------------------------------------------------

    def current(self) -> Version | None:
        """The newest whole version, None before the first one."""
        for number in sorted(self._numbers(), reverse=True):
            found = self._manifest(number)
            if found:
                return found
        return None

    def version(self, number: int | None = None) -> Version:
        found = self.current() if number is None else self._manifest(number)
        if found is None:
            raise NoSuchVersion(f"{self.root} has no version {number or ''}".rstrip())
        return found

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.version(number))

    def history(self) -> list[Version]:
        """All whole versions, oldest first."""
        return [v for v in map(self._manifest, sorted(self._numbers())) if v]

    def _rows(self, version: Version) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        if not version.segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}" for s in version.segments])

    # -- writing --------------------------------------------------------------

    def replace(self, frame: DataFrame, upload: str | None = None) -> Version:
        """A version of these rows alone."""
        segment, rows = self._write(frame)
        return self._commit(lambda now: Version(
            self._next(now), (segment,), rows, frame.schema.json(),
            (*(now.uploads if now else ()), *([upload] if upload else []))))

    def append(self, frame: DataFrame | Staged, upload: str | None = None) -> int:
        """Adds an upload's rows, or those of a staged segment; the number stored, 0 if the
        upload is already there."""
        if isinstance(frame, Staged):
            return self._take(frame, upload or fingerprint(self.read_staged(frame)))
        upload = upload or fingerprint(frame)
        now = self.current()
        if now and upload in now.uploads:
            return 0
        return self._take(self.staged(frame), upload)

    def staged(self, frame: DataFrame) -> Staged:
        """The rows in a segment that no version names yet, in the table's columns."""
        now = self.current()
        if now:
            frame = self._fitted(frame, T.StructType.fromJson(json.loads(now.schema)))
        segment, rows = self._write(frame)
        return Staged(segment, rows, frame.schema.json())

    def read_staged(self, part: Staged) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part.schema))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part.segment}")

    def _take(self, part: Staged, upload: str) -> int:
        stored = part.rows

        def grown(now: Version | None) -> Version | None:
            nonlocal stored
            if now and upload in now.uploads:  # another writer has stored it meanwhile
                stored = 0
                return None
            stored = part.rows
            return Version(self._next(now), (*(now.segments if now else ()), part.segment),
                           (now.rows if now else 0) + part.rows, now.schema if now else part.schema,
                           (*(now.uploads if now else ()), upload))

        self._commit(grown)
        return stored

    def compact(self) -> Version:
        """The newest version's rows in one segment; its uploads stay known."""
        now = self.version()
        segment, rows = self._write(self._rows(now))

        def merged(latest: Version) -> Version:
            later = latest.segments[len(now.segments):]
            if latest.segments[:len(now.segments)] != now.segments:
                raise NoSuchVersion(f"{self.root} was replaced while it was compacted")
            return Version(self._next(latest), (segment, *later), latest.rows, latest.schema,
                           latest.uploads)

        return self._commit(merged)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the segments that only versions older than the last ``keep`` name."""
        known = self.history()
        kept = {s for v in known[-keep:] for s in v.segments}
        gone = sorted({s for v in known[:-keep] for s in v.segments} - kept)
        for version in known[:-keep]:
            self._fs().delete(self._path(self._manifest_path(version.number)), False)
        for segment in gone:
            self._fs().delete(self._path(f"{self.root}/{segment}"), True)
        return gone

    @staticmethod
    def _next(now: Version | None) -> int:
        return now.number + 1 if now else 1

    @staticmethod
    def _fitted(frame: DataFrame, schema: T.StructType) -> DataFrame:
        missing = [f.name for f in schema if f.name not in frame.columns]
        if missing:
            raise ValueError(f"upload lacks {', '.join(missing)}")
        return frame.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

    def _write(self, frame: DataFrame) -> tuple[str, int]:
        segment, counted = f"data/{uuid.uuid4().hex}", Observation()
        frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{segment}")
        return segment, counted.get["rows"]

    def _commit(self, change) -> Version | None:
        while True:
            made = change(self.current())
            if made is None or self._create(made):
                return made

    # -- manifests ------------------------------------------------------------

    def _fs(self):
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return self._path(self.root).getFileSystem(conf)

    def _manifest_path(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}"

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        fs = self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [int(n) for n in names if n.isdigit()]

    def _manifest(self, number: int) -> Version | None:
        fs, path = self._fs(), self._path(self._manifest_path(number))
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text.endswith(END):
            return None
        said = json.loads(text.removesuffix(END))
        return Version(said["number"], tuple(said["segments"]), said["rows"], said["schema"],
                       tuple(said["uploads"]))

    def _create(self, version: Version) -> bool:
        """Writes the manifest; False if its number is taken."""
        path = self._path(self._manifest_path(version.number))
        try:
            stream = self._fs().create(path, False)
        except Py4JJavaError as taken:
            if "FileAlreadyExistsException" in str(taken.java_exception.getClass()) or self._fs().exists(path):
                return False
            raise
        try:
            stream.write(bytearray((json.dumps(asdict(version)) + END).encode()))
        finally:
            stream.close()
        return True


def save_versions(spark: SparkSession, tables: dict[str, DataFrame], folder: str,
                  views: bool = False) -> dict[str, VersionedTable]:
    """Each frame as the new version of its table below ``folder``; with ``views`` also as
    temporary views, which end with the session."""
    saved = {}
    for name, frame in tables.items():
        saved[name] = VersionedTable(spark, f"{folder.rstrip('/')}/{name}")
        saved[name].replace(frame)
        if views:
            saved[name].read().createOrReplaceTempView(name)
    return saved


def summary(table: VersionedTable) -> Sequence[tuple[int, int, int, int]]:
    """Number, rows, segments and uploads of every version."""
    return [(v.number, v.rows, len(v.segments), len(v.uploads)) for v in table.history()]
