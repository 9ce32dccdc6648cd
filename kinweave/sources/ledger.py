"""Tables that are appended to, looked up by key, and committed together.

A ledger is a folder of tables. What is appended becomes a run: files sorted by a hash of the
key, each with its range of hashes. When FANOUT runs of a level have come together they are
merged into one of the next, so a table has a number of runs that grows with the logarithm of
its commits. A lookup opens only files whose range holds one of its hashes, and the scan skips
pages by the hash column's index, so it costs what it asks for and not what is there.

A commit is one small file, written last, that lists the files of all tables. Readers take
what the newest whole commit lists: a writer that dies between two tables changes nothing,
and what it wrote is never read. There is one writer at a time; a second one fails at the
commit, whose number is taken.
"""

from __future__ import annotations

import functools
import json
import uuid
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

FANOUT = 8
#: Rows of a file, and of a page that a lookup reads.
ROWS_PER_FILE, ROWS_PER_PAGE = 1_000_000, 1000
#: Up to so many keys are looked up by their hashes; with more, the table is read.
MOST_KEYS = 4096
#: Up to so many hashes are pushed down to the pages.
MOST_PUSHED = 500
#: Commits that stay readable; files that only older ones list are deleted.
KEPT_COMMITS = 20


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class Kept:
    """A table: its columns, the key it is looked up by, and whether a key's newest row replaces the others."""

    schema: str
    key: tuple[str, ...] = ()
    latest: bool = False

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]


@dataclass
class _Run:
    level: int
    files: list[list]  # of [path below the ledger, least hash, greatest hash, rows]


@dataclass
class Snapshot:
    """The tables as one commit has them."""

    ledger: Ledger
    number: int = 0
    facts: dict = field(default_factory=dict)
    runs: dict[str, list[_Run]] = field(default_factory=dict)

    def read(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self.ledger._rows(name, self._files(name))

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a table whose key is in ``keys``, which has the key's columns; null keys find nothing."""
        kept = self.ledger.tables[name]
        asked = keys.select(*kept.key).dropna().distinct()
        hashes = sorted(r[0] for r in asked.select(F.xxhash64(*kept.key)).distinct().limit(MOST_KEYS + 1).collect())
        if len(hashes) > MOST_KEYS:
            return self.ledger._rows(name, self._files(name), lambda rows: rows.join(asked, list(kept.key), "left_semi"))

        def within(low: int, high: int) -> bool:
            at = bisect_left(hashes, low)
            return at < len(hashes) and hashes[at] <= high

        files = [f for f in self._files(name) if within(f[1], f[2])]

        def found(rows: DataFrame) -> DataFrame:
            if len(hashes) <= MOST_PUSHED:
                rows = rows.where(F.col("_h").isin(hashes))
            return rows.join(F.broadcast(asked), list(kept.key), "left_semi")

        return self.ledger._rows(name, files, found)

    def _files(self, name: str) -> list[list]:
        return [f for run in self.runs.get(name, []) for f in run.files]


class Change:
    """What one commit adds. Nothing of it is seen before :meth:`commit`."""

    def __init__(self, base: Snapshot) -> None:
        self.ledger, self.base = base.ledger, base
        self.facts = dict(base.facts)
        self.written: list[tuple[str, str]] = []  # tables and folders
        self.replaced: set[str] = set()

    def append(self, name: str, rows: DataFrame, ranged: bool = False) -> DataFrame:
        """Write rows of a table; returns a scan of them, to be used before the commit.

        Of a ``latest`` table they hold a key once. ``ranged`` deals rows to files by ranges of
        hashes, for which they are made twice; without it only merges do.
        """
        ledger, kept = self.ledger, self.ledger.tables[name]
        key = F.xxhash64(*kept.key) if kept.key else F.lit(0).cast("long")
        marked = rows.select(*kept.columns).withColumn("_h", key).withColumn("_seq", F.lit(self.base.number + 1).cast("long"))
        folder = ledger._write(name, marked if ranged else marked.hint("rebalance"), 0, ranged)
        self.written.append((name, folder))
        return ledger.spark.read.schema(kept.schema).parquet(f"{ledger.path}/{folder}").hint("merge")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Like :meth:`append`, for a table that then has nothing of what it had."""
        self.replaced.add(name)
        return self.append(name, rows, ranged=True)

    def commit(self) -> Snapshot:
        """Merge what has come together and make all of it the newest state."""
        ledger = self.ledger
        runs = {name: list(some) for name, some in self.base.runs.items() if name not in self.replaced}
        for (name, _), files in zip(self.written, ledger._files_of([folder for _, folder in self.written])):
            if files:
                runs.setdefault(name, []).append(_Run(0, files))
        for name in runs:
            runs[name] = self._merged(name, runs[name])
        told = {"facts": self.facts, "tables": {n: [[r.level, r.files] for r in some] for n, some in runs.items()}}
        number = ledger._put(self.base.number + 1, json.dumps(told))
        listed = {f[0].rpartition("/")[0] for some in runs.values() for r in some for f in r.files}
        for folder in {folder for _, folder in self.written} - listed:  # empty, or merged at once
            ledger._delete(folder)
        ledger._clean()
        return Snapshot(ledger, number, self.facts, runs)

    def _merged(self, name: str, runs: list[_Run]) -> list[_Run]:
        level, fanout = 0, max(2, FANOUT)
        while len(some := [r for r in runs if r.level == level]) >= fanout:
            files = [f for r in some for f in r.files]
            rows = self.ledger._newest(name, self.ledger._scan(name, files))
            folder = self.ledger._write(name, rows, level + 1, True, sum(f[3] for f in files))
            self.written.append((name, folder))
            level += 1
            runs = [r for r in runs if r.level != level - 1] + [_Run(level, self.ledger._files_of([folder])[0])]
        return runs


class Ledger:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Kept]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        if int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) < MOST_PUSHED:
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_PUSHED))

    def snapshot(self) -> Snapshot:
        """The newest whole commit, or an empty state."""
        for number in sorted(self._numbers(), reverse=True):
            told = self._get(number)
            if told is not None:
                runs = {n: [_Run(*r) for r in rs] for n, rs in told["tables"].items()}
                return Snapshot(self, number, told["facts"], runs)
        return Snapshot(self)

    def begin(self) -> Change:
        return Change(self.snapshot())

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    # --- rows -----------------------------------------------------------------------------

    def _scan(self, name: str, files: list[list]) -> DataFrame:
        schema = f"{self.tables[name].schema}, _h long, _seq long"
        if not files:
            return self.spark.createDataFrame([], schema)
        # files tell little of the size in memory: what is not asked to be broadcast is not
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f[0]}" for f in files]).hint("merge")

    def _newest(self, name: str, rows: DataFrame) -> DataFrame:
        kept = self.tables[name]
        if not kept.latest:
            return rows
        rest = [c for c in rows.columns if c not in kept.key]
        last = rows.groupBy(*kept.key).agg(F.max_by(F.struct(*rest), "_seq").alias("_row"))
        return last.select(*kept.key, "_row.*").select(*rows.columns)

    def _rows(self, name: str, files: list[list], only=lambda rows: rows) -> DataFrame:
        return self._newest(name, only(self._scan(name, files))).select(*self.tables[name].columns)

    def _write(self, name: str, rows: DataFrame, level: int, ranged: bool, n: int | None = None) -> str:
        """Write rows, of which there are ``n`` about if that is known, in order of their hashes; the folder."""
        folder = f"{name}/{level}-{uuid.uuid4().hex}"
        by = "_h" if self.tables[name].key else "_seq"
        if ranged:
            rows = rows.repartitionByRange(max(1, -(-n // ROWS_PER_FILE)), by) if n else rows.repartitionByRange(by)
        writer = rows.sortWithinPartitions(by).write.option("compression", "zstd").option("parquet.page.row.count.limit", ROWS_PER_PAGE)
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def _files_of(self, folders: list[str]) -> list[list[list]]:
        """The files of each folder with their hashes' range and their rows; empty ones are none."""
        if not folders:
            return []
        parts = [
            self.spark.read.schema("_h long").parquet(f"{self.path}/{f}").select(F.lit(k).alias("k"), F.col("_metadata.file_name").alias("file"), "_h")
            for k, f in enumerate(folders)
        ]
        found: list[list[list]] = [[] for _ in folders]
        for k, file, low, high, n in functools.reduce(DataFrame.union, parts).groupBy("k", "file").agg(F.min("_h"), F.max("_h"), F.count("*")).collect():
            found[k].append([f"{folders[k]}/{file}", low, high, n])
        return [sorted(f) for f in found]

    # --- files ----------------------------------------------------------------------------

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def _list(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._list("_commits") if n.endswith(".json")]

    def _get(self, number: int) -> dict | None:
        """A commit; none if its writer died before its end."""
        fs, path = self._at(f"_commits/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _put(self, number: int, text: str) -> int:
        """Write a commit whose number follows that of its base; the number, later if one is broken."""
        taken = self._numbers()
        if any(k >= number and self._get(k) is not None for k in taken):
            raise Conflict(f"commit {number} is there already")
        number = max([number, *(k + 1 for k in taken)])
        self.note(f"_commits/{number:012d}.json", text)
        return number

    def note(self, name: str, text: str) -> None:
        """Write a small file beside the tables, which must not be there yet."""
        fs, path = self._at(name)
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _clean(self) -> None:
        """Delete commits beyond the last KEPT_COMMITS, and the runs that only they list."""
        numbers = sorted(self._numbers())
        old, new = numbers[:-KEPT_COMMITS], numbers[-KEPT_COMMITS:]
        if not old:
            return
        listed = lambda some: {f[0].rpartition("/")[0] for k in some if (told := self._get(k)) for runs in told["tables"].values() for r in runs for f in r[1]}
        for name in [*(listed(old) - listed(new)), *(f"_commits/{k:012d}.json" for k in old)]:
            self._delete(name)

    def sweep(self) -> int:
        """Delete runs that no commit lists, such as those of a dead writer; how many. No writer may be at work."""
        told = [self._get(k) for k in self._numbers()]
        listed = {f[0].rpartition("/")[0] for t in told if t for runs in t["tables"].values() for r in runs for f in r[1]}
        gone = [f"{name}/{run}" for name in self.tables for run in self._list(name) if f"{name}/{run}" not in listed]
        for folder in gone:
            self._delete(folder)
        return len(gone)
