"""Keyed tables on disk: numbered commits over immutable folders of rows, and the manifest of their coverage.

A commit names the folders that a table is read from: for each year one with all its rows and, after small upserts, later ones with
changed rows only.  It holds each year's count, first and last day and sum of row hashes; an upsert brings those up to date from the rows it
replaces and adds, so coverage and fingerprint need no scan.  Readers see one commit or the next, never a half, and nothing is overwritten.
Writers may run at once: each reads a commit, writes folders and claims the next number; who finds it taken goes on if the years it wrote
are as it read them, else does its merge again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from marketframe.functions.scalars import fingerprint_of, hash_sum, version_key, without_nan
from marketframe.operators.dataquality import validated
from marketframe.operators.relational import checked_keys, in_order, keys_of, last_by_key, refuse_stored, scan, with_keys, without_keys
from marketframe.sources.commits import Commits, Folder
from marketframe.specs import DatasetSpec, spec_of

MANIFEST = "type_name string, first_date date, last_date date, row_count long, code_count long, n_bytes long, fingerprint string, schema_version string, universe_sha string, updated_at timestamp"
COVERAGE = "type_name string, first_date date, last_date date, row_count long, code_count long"
DEFAULT_START = date(2020, 1, 1)
#: Rows of a file, where a year has as many.
FILE_ROWS = 1 << 20
#: A year is written anew once its changed rows are more than one in so many of its rows, or lie in so many folders.
CHANGED_SHARE, CHANGED_FOLDERS = 4, 8
#: How often a writer does its work again because others were faster.
ATTEMPTS = 20
#: Stands for the year in tables that are not kept by year.
WHOLE = -1


class VersionError(ValueError):
    """A table written by another schema version."""


class CommitConflict(RuntimeError):
    """Other writers changed the same years each time."""


@dataclass
class Stats:
    """Of a year's rows: they add up, and what is replaced can be taken off."""

    rows: int = 0
    hashes: int = 0
    first: str | None = None
    last: str | None = None

    def plus(self, other: Stats) -> Stats:
        days = [d for d in (self.first, self.last, other.first, other.last) if d]
        return Stats(self.rows + other.rows, self.hashes + other.hashes, min(days, default=None), max(days, default=None))

    def less(self, other: Stats) -> Stats:
        """Without replaced rows; their days stay, as the rows that replace them have the same keys."""
        return Stats(self.rows - other.rows, self.hashes - other.hashes, self.first, self.last)

    def meets(self, other: Stats) -> bool:
        """Whether keys can be in both: the ranges of days overlap, or a side has rows without a day."""
        if not (self.first and other.first):
            return bool(self.rows and other.rows)
        return self.first <= other.last and other.first <= self.last


@dataclass
class Part:
    """Rows of a year in one folder: all of them (order 0), or changes, the later the higher."""

    year: int
    folder: str
    order: int
    rows: int
    files: int
    bytes: int


@dataclass
class State:
    """What a commit says of a table."""

    parts: list[Part] = field(default_factory=list)
    years: dict[int, Stats] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict) -> State:
        if not raw:
            return cls()
        return cls([Part(**p) for p in raw["parts"]], {int(y): Stats(**s) for y, s in raw["years"].items()}, raw["batches"])

    def of_year(self, year: int) -> list[Part]:
        return [p for p in self.parts if p.year == year]

    def total(self) -> Stats:
        out = Stats()
        for s in self.years.values():
            out = out.plus(s)
        return out


class Table:
    """A dataset under a root folder.  Daily and quarterly Parquet tables are kept by the year of their time column."""

    def __init__(self, spark: SparkSession, root: str, spec: DatasetSpec | str) -> None:
        self.spark, self.spec = spark, spec_of(spec)
        self.root, self.path = root.rstrip("/"), f"{root.rstrip('/')}/{self.spec.name}"
        self.by_year = self.spec.format == "parquet" and self.spec.time_col is not None
        self._stored = T.StructType([*self.spec.schema.fields, T.StructField("_year", T.IntegerType())])
        self.commits, self.folder = Commits(spark, f"{self.path}/_commits"), Folder(spark, self.path)

    # Reading

    def state(self, version: int | None = None) -> tuple[int, State]:
        """(number, state) of a commit, the newest if none is named; (0, empty) if the table was never written."""
        if version is not None:
            return version, State.of(self.commits.state(version))
        number, raw = self.commits.newest()
        return number, State.of(raw)

    def exists(self) -> bool:
        return self.state()[0] > 0

    def _load(self, folder: str, years: Sequence[int], files: Sequence[str] | None = None) -> DataFrame:
        at = f"{self.path}/{folder}"
        if self.spec.format == "csv":
            return self.spark.read.schema(self.spec.schema).option("header", True).csv(at)
        if not self.by_year:
            return self.spark.read.schema(self.spec.schema).parquet(at)
        source = self.spark.read.schema(self._stored)
        df = source.parquet(at) if files is None else source.option("basePath", at).parquet(*(f"{at}/{f}" for f in files))
        return df.where(F.col("_year").isin(list(years))).select(self.spec.columns)

    def _union(self, parts: Sequence[Part], files: dict[str, list[str]] | None) -> DataFrame | None:
        """Rows of some parts, folder by folder; with ``files`` only of those files."""
        out, folders = None, {}
        for p in parts:
            folders.setdefault(p.folder, []).append(p.year)
        for folder, years in sorted(folders.items()):
            if files is not None and folder not in files:
                continue
            df = self._load(folder, years, None if files is None else files[folder])
            out = df if out is None else out.unionByName(df)
        return out

    def _all(self, years: Sequence[int] | None = None, state: State | None = None, files: dict[str, list[str]] | None = None) -> DataFrame:
        """Rows of some years: those of the whole folders whose key is in no later folder, and of each changed key the last."""
        state = self.state()[1] if state is None else state
        parts = [p for p in state.parts if years is None or p.year in years]
        changed = {p.year for p in parts if p.order}
        pieces = [self._union([p for p in parts if p.year not in changed], files)]
        deltas = None
        for order in sorted({p.order for p in parts if p.order}):
            df = self._union([p for p in parts if p.order == order], files)
            if df is not None:
                df = df.withColumn("_order", F.lit(order))
                deltas = df if deltas is None else deltas.unionByName(df)
        base = self._union([p for p in parts if p.year in changed and not p.order], files)
        if deltas is None:
            pieces.append(base)
        else:
            pieces.append(base if base is None else without_keys(base, deltas, self.spec.key))
            several = len({p.order for p in parts if p.order}) > 1
            pieces.append((last_by_key(deltas, self.spec.key, ["_order"]) if several else deltas).select(self.spec.columns))
        out = None
        for df in pieces:
            if df is not None:
                out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], self.spec.schema) if out is None else out

    def _codes(self, state: State, years: Sequence[int] | None = None) -> DataFrame:
        """folder, year, file, code: the codes of each file that the table is read from, kept beside the rows."""
        kinds, parts = "folder string, year int, file string, code string", [p for p in state.parts if years is None or p.year in years]
        if not parts:
            return self.spark.createDataFrame([], kinds)
        held = self.spark.read.schema(kinds).parquet(*(f"{self.path}/_codes/{f}" for f in sorted({p.folder for p in parts})))
        return held.where(F.concat_ws("/", "folder", "year").isin([f"{p.folder}/{p.year}" for p in parts]))

    def files_with(self, codes: Sequence[str] | DataFrame, years: Sequence[int] | None = None, state: State | None = None) -> dict[str, list[str]]:
        """Of each folder the files that hold any of some codes."""
        state = self.state()[1] if state is None else state
        found = scan(self._codes(state, years), codes=codes, code_col="code").select("folder", "year", "file").distinct()
        out: dict[str, list[str]] = {}
        for r in found.collect():  # file names: fewer than Spark lists to read the table
            out.setdefault(r.folder, []).append(f"_year={r.year}/{r.file}")
        return {folder: sorted(files) for folder, files in out.items()}

    def read(self, *, start: date | str | None = None, end: date | str | None = None, codes: Sequence[str] | DataFrame | None = None, columns: Sequence[str] | None = None, days: Sequence[date | str] | None = None, ordered: bool = False, manifest: Manifest | None = None, version: int | None = None) -> DataFrame:
        """Rows of a closed range and of some codes, as of the newest or another commit; FileNotFoundError if never written.

        Codes may be a list, or a table with one column.  Where a year has several files, only those with any of the codes are opened.  With a
        manifest its schema version is checked first; CSV tables are exempt.
        """
        if manifest is not None and self.spec.format != "csv":
            manifest.check_version(self.spec)
        number, state = self.state(version)
        if not number:
            raise FileNotFoundError(self.path)
        first, last = int(str(start)[:4]) if start is not None else None, int(str(end)[:4]) if end is not None else None
        years = None
        if self.by_year and (start is not None or end is not None):  # a row without a day (year 0) is in no range
            years = [y for y in state.years if y and (first is None or y >= first) and (last is None or y <= last)]
        parts = [p for p in state.parts if years is None or p.year in years]
        some = codes is not None and (isinstance(codes, DataFrame) or len(codes) > 0)
        files = self.files_with(codes, years, state) if some and self.by_year and self.spec.code_col and sum(p.files for p in parts) > len(parts) else None
        df = scan(self._all(years, state, files), start=start, end=end, codes=codes, columns=columns, days=days, time_col=self.spec.time_col or "", code_col=self.spec.code_col or "")
        return in_order(df) if ordered else df

    def keys(self) -> DataFrame:
        return keys_of(self._all(), self.spec.key)

    def files(self) -> DataFrame:
        """One row: n_files and n_bytes of what the table is read from now; from the commit alone."""
        parts = self.state()[1].parts
        return self.spark.createDataFrame([(sum(p.files for p in parts), sum(p.bytes for p in parts))], "n_files long, n_bytes long")

    def coverage(self) -> Row:
        """type_name, first_date, last_date, row_count, code_count, n_bytes and fingerprint, without reading the table.

        Codes are counted in their own small table, exactly; a CSV table is small and read."""
        state = self.state()[1]
        total, codes = state.total(), 0
        if self.spec.code_col and self.by_year:
            codes = self._codes(state).agg(F.count_distinct("code")).first()[0]
        elif self.spec.code_col:
            codes = self._all(None, state).agg(F.count_distinct(self.spec.code_col)).first()[0]
        day = lambda d: date.fromisoformat(d) if d else None
        return Row(type_name=self.spec.name, first_date=day(total.first), last_date=day(total.last), row_count=total.rows, code_count=codes, n_bytes=sum(p.bytes for p in state.parts), fingerprint=fingerprint_of(total.hashes, total.rows))

    # Writing

    @property
    def _year(self) -> Column:
        return F.coalesce(F.year(self.spec.time_col), F.lit(0)) if self.by_year else F.lit(WHOLE)

    def _shaped(self, df: DataFrame) -> DataFrame:
        return without_nan(df).select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spec.schema))

    def _stats(self, rows: DataFrame) -> dict[int, Stats]:
        """Of each year, from one pass: a year is one row, however many rows it has."""
        day = F.col(self.spec.time_col).cast("string") if self.spec.time_col else F.lit(None).cast("string")
        found = rows.groupBy(self._year.cast("int").alias("year")).agg(F.count("*").alias("n"), hash_sum(self.spec.columns).alias("h"), F.min(day).alias("first"), F.max(day).alias("last"))
        return {r.year: Stats(r.n, int(r.h), r["first"], r["last"]) for r in found.collect()}

    def _put(self, rows: DataFrame, stats: dict[int, Stats], number: int, order: int) -> list[Part]:
        """Write rows of the years in ``stats`` as a folder of its own.

        Rows are dealt by year and code into files of at most about ``FILE_ROWS`` rows and sorted by code and day in each, so that a
        range of days and a list of codes both leave most files unopened; which file has which codes is written beside them.
        """
        name = f"snapshot-{number:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{name}"
        if self.spec.format == "csv":
            rows.write.option("header", True).csv(at)
        elif not self.by_year:
            rows.write.parquet(at)
        else:
            code = [self.spec.code_col] if self.spec.code_col else []
            files = max(1, *(-(-s.rows // FILE_ROWS) for s in stats.values())) if stats else 1
            df = rows.withColumn("_year", self._year)
            df = df.repartitionByRange(max(len(stats), -(-sum(s.rows for s in stats.values()) // FILE_ROWS)), "_year", *code) if files > 1 else df.hint("rebalance", "_year")
            df.sortWithinPartitions(*dict.fromkeys(["_year", *code, self.spec.time_col])).write.partitionBy("_year").parquet(at)
            if code:
                written = self.spark.read.schema(self._stored).parquet(at)
                held = written.where(F.col(code[0]).isNotNull()).select(F.lit(name).alias("folder"), F.col("_year").alias("year"), F.col("_metadata.file_name").alias("file"), F.col(code[0]).alias("code"))
                held.distinct().coalesce(1).write.parquet(f"{self.path}/_codes/{name}")
        weight = {y: self.folder.weight(f"{name}/_year={y}" if self.by_year else name) for y in stats}
        return [Part(y, name, order, s.rows, *weight[y]) for y, s in stats.items()]

    def _replace_all(self, rows: DataFrame, stats: dict[int, Stats]) -> None:
        number, state = self.state()
        parts = self._put(rows, stats, number + 1, 0)
        if self.spec.format == "csv" and stats:  # text may give values another form: what counts is what is read back
            stats = self._stats(self._load(parts[0].folder, []))
        while not self.commits.claim(number + 1, asdict(State(parts, stats, state.batches))):
            number, state = self.state()

    def write(self, df: DataFrame) -> int:
        """Replace the whole table; an empty one keeps its schema.  Returns its rows."""
        rows = self._shaped(validated(df, self.spec)).persist()
        try:
            stats = self._stats(rows)
            if not self.by_year:
                stats = stats or {WHOLE: Stats()}
            self._replace_all(rows, stats)
            return sum(s.rows for s in stats.values())
        finally:
            rows.unpersist()

    def truncate(self) -> None:
        """No rows any more; the dataset is still known."""
        self._replace_all(self.spark.createDataFrame([], self.spec.schema), {} if self.by_year else {WHOLE: Stats()})

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows whose keys are all new; KeyConflictError names the smallest that is not.  Returns the rows added."""
        return self.upsert(df, conflict="error", batch=batch)

    def upsert(self, df: DataFrame, conflict: str = "replace", dedup: str = "error", batch: tuple[str, int] | None = None) -> int:
        """Merge rows by key (see ``upserted``).  Returns the incoming rows; under 'ignore' those that were new.

        Few rows against their year become a folder of changes; a year is written anew when it has too many (``CHANGED_SHARE``,
        ``CHANGED_FOLDERS``).  Stored rows are read only in years whose days meet the incoming ones.  ``batch``: name and number of a
        stream's batch; one that this table has already taken is passed over, 0 rows.
        """
        rows = self._shaped(validated(without_nan(df), self.spec)).persist()  # looked at several times: keys, years, rows
        try:
            new = checked_keys(rows, self.spec.key, dedup)
            stats = self._stats(new)
            if not stats and not batch:
                return 0
            for _ in range(ATTEMPTS):
                number, state = self.state()
                if batch and state.batches.get(batch[0], -1) >= batch[1]:
                    return 0
                parts, years = self._merged(new, stats, state, number, conflict, dedup == "keep")
                if not years and not batch:
                    return 0
                if self._claimed(number, state, parts, years, batch):
                    added = {y: s.rows - state.years.get(y, Stats()).rows for y, s in years.items()}
                    return sum(added.values()) if conflict == "ignore" else sum(s.rows for s in stats.values())
            raise CommitConflict(f"{self.spec.name}: {ATTEMPTS} attempts")
        finally:
            rows.unpersist()

    def _merged(self, new: DataFrame, stats: dict[int, Stats], state: State, number: int, conflict: str, whole: bool) -> tuple[list[Part], dict[int, Stats]]:
        """Write what the touched years hold after an upsert: (all their parts, their statistics)."""
        if conflict not in ("replace", "ignore", "error"):
            raise ValueError(f"conflict is 'replace', 'ignore' or 'error', not {conflict!r}")
        near = [y for y, s in stats.items() if y in state.years and (not self.by_year or s.meets(state.years[y]))]
        stored = self._all(near, state)
        replaced: dict[int, Stats] = {}
        if near and conflict == "error":
            refuse_stored(stored, new, self.spec.key)
        elif near and conflict == "ignore":
            new = without_keys(new, stored, self.spec.key)
            stats = self._stats(new)
        elif near:
            replaced = self._stats(with_keys(stored, new, self.spec.key))
        years = {y: state.years.get(y, Stats()).less(replaced.get(y, Stats())).plus(s) for y, s in stats.items()}
        small = {y for y, s in stats.items() if self.by_year and not whole and self._is_small(s, state.of_year(y))}
        parts = [p for y in small for p in state.of_year(y)]
        if small:
            parts += self._put(new.where(self._year.isin(list(small))), {y: stats[y] for y in small}, number + 1, number + 1)
        anew = {y: years[y] for y in stats if y not in small}
        if anew:
            old, rest = self._all(list(anew), state), new.where(self._year.isin(list(anew)))
            put = self._put((without_keys(old, rest, self.spec.key) if replaced else old).unionByName(rest), anew, number + 1, 0)
            if self.spec.format == "csv":
                years |= self._stats(self._load(put[0].folder, []))
            parts += put
        return parts, years

    @staticmethod
    def _is_small(incoming: Stats, parts: Sequence[Part]) -> bool:
        base = sum(p.rows for p in parts if not p.order)
        changed = sum(p.rows for p in parts if p.order) + incoming.rows
        return len(parts) <= CHANGED_FOLDERS and changed * CHANGED_SHARE <= base

    def _claimed(self, number: int, state: State, parts: list[Part], years: dict[int, Stats], batch: tuple[str, int] | None) -> bool:
        """Publish new parts of ``years`` on top of the newest commit; False if another writer has changed one of these years."""
        now = state
        while True:
            if any(now.of_year(y) != state.of_year(y) for y in years) or batch and now.batches.get(batch[0], -1) >= batch[1]:
                return False
            following = State([*(p for p in now.parts if p.year not in years), *parts], now.years | years, now.batches | dict([batch] if batch else []))
            if self.commits.claim(number + 1, asdict(following)):
                return True
            number, now = self.state()

    def expire(self, keep: timedelta, now: float | None = None) -> dict[str, int]:
        """Remove commits that were replaced longer than ``keep`` ago, and folders older than that which no commit left names.

        Returns how many of each.  A reader of a commit that is left goes on undisturbed, as does a writer whose folders are younger.
        """
        before = int(((time.time() if now is None else now) - keep.total_seconds()) * 1000)
        left, commits = self.commits.forget(before)
        live, folders = {p["folder"] for raw in left for p in raw["parts"]}, 0
        for f in self.folder.listed():
            if f.name.startswith("snapshot-") and f.name not in live and f.changed < before:
                self.folder.remove(f.name)
                self.folder.remove(f"_codes/{f.name}")
                folders += 1
        return {"commits": commits, "folders": folders}


class Manifest:
    """One entry for each dataset: its coverage, fingerprint and schema version.  Absent is empty; writers may run at once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.commits = spark, Commits(spark, f"{root.rstrip('/')}/_manifest")

    @staticmethod
    def _row(name: str, e: dict) -> Row:
        day = lambda d: date.fromisoformat(d) if d else None
        return Row(type_name=name, **e | {"first_date": day(e["first_date"]), "last_date": day(e["last_date"]), "updated_at": datetime.fromisoformat(e["updated_at"])})

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([self._row(n, e) for n, e in sorted(self.commits.newest()[1].items())], MANIFEST)

    def entry(self, name: str) -> Row | None:
        """One dataset's row, or None."""
        name = spec_of(name).name
        e = self.commits.newest()[1].get(name)
        return None if e is None else self._row(name, e)

    def update(self, table: Table, universe_sha: str | None = None) -> None:
        """Replace one dataset's entry by its coverage now; VersionError if the stored version is newer than the code's."""
        spec, stats = table.spec, None
        while True:
            number, entries = self.commits.newest()
            now = entries.get(spec.name)
            if now is not None and version_key(spec.version) < version_key(now["schema_version"]):
                raise VersionError(f"{spec.name}: version {spec.version} is older than the stored {now['schema_version']}")
            stats = stats or table.coverage().asDict()
            e = {k: str(v) if isinstance(v, date) else v for k, v in stats.items() if k != "type_name"}
            e |= {"schema_version": spec.version, "universe_sha": universe_sha or (now or {}).get("universe_sha"), "updated_at": datetime.now().isoformat()}
            if self.commits.claim(number + 1, entries | {spec.name: e}):
                return

    def delete(self, name: str) -> bool:
        """Forget a dataset; whether it was there."""
        while True:
            number, entries = self.commits.newest()
            if spec_of(name).name not in entries:
                return False
            if self.commits.claim(number + 1, {n: e for n, e in entries.items() if n != spec_of(name).name}):
                return True

    def check_version(self, spec: DatasetSpec) -> None:
        """VersionError if the stored version is another one; no entry passes."""
        now = self.entry(spec.name)
        if now is not None and now.schema_version != spec.version:
            raise VersionError(f"{spec.name}: stored as version {now.schema_version}, read as {spec.version}")

    def is_universe_stale(self, current: str | None, name: str = "Universe") -> bool:
        """Whether the stored universe fingerprint differs; unknown on either side is not stale."""
        now = self.entry(name)
        return bool(current and now is not None and now.universe_sha and now.universe_sha != current)

    def resume_range(self, name: str, latest: date, default: date = DEFAULT_START) -> tuple[date, date]:
        """Closed window still to be loaded; start > end means up to date."""
        now = self.entry(name)
        return (default, latest) if now is None or now.last_date is None else resume(now.last_date, latest)


def resume(last: date, latest: date) -> tuple[date, date]:
    return (latest if last > latest else last) + timedelta(1), latest


def drifted(table: Table) -> bool:
    """Whether the stored files have other columns than the dataset (unreadable ones count as drifted)."""
    folders = {p.folder for p in table.state()[1].parts}
    try:
        return any(set(table.spark.read.parquet(f"{table.path}/{f}").columns) - {"_year"} != set(table.spec.columns) for f in folders)
    except AnalysisException:
        return True


def status(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """Coverage and stored files of every named dataset in one table; those never written have zeros."""
    rows = []
    for name in names:
        t = Table(spark, root, name)
        c, parts = t.coverage(), t.state()[1].parts
        rows.append((c.type_name, c.first_date, c.last_date, c.row_count, c.code_count, sum(p.files for p in parts), sum(p.bytes for p in parts)))
    return spark.createDataFrame(rows, f"{COVERAGE}, n_files long, n_bytes long")
