"""The command surface: verbs with option strings, over projects whose tables lie in a store."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import grouped
from tessera.operators import early, files, formats, groups, index, info, lines, slices, snapshot
from tessera.plans.options import Options, from_arguments
from tessera.sources import config, known, ranges, tree
from tessera.sources.store import BUCKET_BYTES, ChangeList, Conflict, Folder, FormatError, Manifest, Store, placed
from tessera.streaming.watch import BEAT, UPDATE_FILES, UPDATE_QUIET, Watch
from tessera.workers import importable

VERSION = "0.2"
HELP = """Verbs, each with a comma list of projects (* is all) but for the first and the last four:
  init NAME FOLDER        write a project file
  build, update LIST      index all files; only what changed
  search LIST [OPTIONS] REGEX
  files LIST [OPTIONS] [QUERY]
  change LIST PATH...     tell of changed files
  watch LIST              keep change lists, and update when it is quiet
  info LIST               statistics and checks
  interactive LIST [OPTIONS]
  filter [OPTIONS] QUERY  match lines of input
  projects, version, help
Options: i no case, l literal, b without the index, V Visual Studio, C column, CE both columns,
  H and HM highlight, HD don't, S summary, Ln limit, fiRE and feRE paths in and out,
  fp fn fs ff match paths, names, tokens, fuzzily"""

ROWS = ("path", "part_no", "start_line", "content", "mtime", "size")
#: Times that a writer begins anew because another was faster; buckets whose chunks tell where a limited search is cut.
ATTEMPTS, CUT_BUCKETS = 3, 8


def new_version() -> str:
    return f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"


class Engine:
    """Runs verbs; ``execute`` takes the words of a command line and gives lines of text. ``say`` is told how work goes on."""

    def __init__(self, spark: SparkSession, home: str | None = None, say: Callable[[str], None] = lambda line: None, bucket_bytes: int = BUCKET_BYTES, sizes: tuple[int, int] = (ranges.RANGE, ranges.CHUNK)):
        """``sizes``: bytes of a range of a file and of a part, which an index keeps as long as it lives."""
        importable(spark)
        self.spark, self.home, self.say, self.bucket_bytes, self.sizes = spark, home or config.home(), say, bucket_bytes, sizes
        self.watching: list = []

    # --- tables ---------------------------------------------------------------------------

    def _store(self, file: str) -> Store:
        return Store(self.spark, str(Path(file).with_suffix("")) + ".tables", self.bucket_bytes)

    def _changes(self, file: str) -> ChangeList:
        return ChangeList(self.spark, self._store(file).top)

    def _group(self, file: str) -> config.Group:
        return config.parse_config(Path(file).read_text(), str(Path(file).resolve().parent), file)

    def _roots(self, group: config.Group) -> dict[str, list[list[str]]]:
        """Folders of a project's groups, each with the excludes of all groups that have it, if all have some."""
        excludes: dict[str, list[list[str]]] = {}
        for g in group.walk():
            own, at = [], g
            while at is not None:
                own, at = own + at.exclude, at.parent
            for root in g.paths:
                excludes.setdefault(root, []).append(own)
        return {root: own if all(own) else [] for root, own in excludes.items()}

    def _named(self, group: config.Group) -> list[tuple[str, int, int]]:
        return [(f, int(s.st_mtime), s.st_size) for g in group.walk() for f in g.files if Path(f).is_file() and (s := Path(f).stat())]

    def scan(self, file: str) -> DataFrame:
        """``(path, mtime, size)`` of a project's files as they are now. Folders that all groups of a root exclude are not walked."""
        group = self._group(file)
        return self._chosen(group, tree.listings(self.spark, self._roots(group)))

    def _chosen(self, group: config.Group, rows: DataFrame) -> DataFrame:
        if named := self._named(group):
            rows = rows.unionByName(self.spark.createDataFrame(named, tree.SCHEMA))
        return groups.project_files(group, rows)

    def _read(self, rows: DataFrame) -> DataFrame:
        """Contents of listed files, by byte ranges."""
        return ranges.read(rows, *self.sizes).select(*ROWS)

    def _listed(self, store: Store, manifest: Manifest | None = None) -> DataFrame:
        """``(path, mtime, size)`` as the index has it; no contents are read."""
        old = store.read(manifest=manifest)
        return self.spark.createDataFrame([], tree.SCHEMA) if old is None else old.where("part_no = 0").select("path", "mtime", "size")

    def _again(self, once: Callable[[], DataFrame | None]) -> DataFrame | None:
        """Once, and anew from the newest version if another writer publishes meanwhile."""
        for left in reversed(range(ATTEMPTS)):
            try:
                return once()
            except Conflict as e:
                if not left:
                    raise
                self.say(f"{e}; once more")

    # --- verbs ----------------------------------------------------------------------------

    def init(self, name: str, path: str) -> str:
        file = config.projects(name, self.home)[0][1]
        config.new_config(file, path)
        return f"Wrote {file}. Next: update {name}"

    def build(self, file: str) -> None:
        self._again(lambda: self._built(file))

    def _built(self, file: str) -> None:
        store, changes = self._store(file), self._changes(file)
        listed = changes.number()
        work = Folder(self.spark, f"{store.top}/.work-{uuid.uuid4().hex}")
        try:
            now = self._kept(self.scan(file), work, "now")
            total, n = now.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
            self.say(f"{n} files of {total} bytes")
            store.write(new_version(), self._read(now), store.sized(total))
        finally:
            work.delete("")
        changes.forget(listed)

    def _kept(self, rows: DataFrame, work: Folder, name: str) -> DataFrame:
        """Rows in a table, so that all steps see the same ones."""
        rows.write.parquet(f"{work.top}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{work.top}/{name}")

    def update(self, file: str) -> DataFrame:
        """Read only files that are new or changed, and write only the buckets that differ; gives counts of files by status, and of buckets kept and written.

        The old index gives its paths, times and sizes for the comparison, and its contents only for
        buckets that are written anew; of these, large ones are split. Without an index, or with one of
        another format, build one. The
        change list goes once the new index is there, but for what was added to it meanwhile. If another
        writer publishes first, the update starts anew from what that one wrote.
        """
        return self._again(lambda: self._updated(file))

    def _updated(self, file: str) -> DataFrame:
        store, changes = self._store(file), self._changes(file)
        try:
            manifest = store.manifest()
        except FormatError as e:
            self.say(f"{e}: all is built anew")
            manifest = None
        if manifest is None:
            self._built(file)
            return self.spark.createDataFrame([], "status string, n long")
        listed = changes.number()
        work = Folder(self.spark, f"{store.top}/.work-{uuid.uuid4().hex}")
        try:
            now = self._kept(self.scan(file), work, "now")
            old = self._listed(store, manifest)
            diff = self._kept(snapshot.differences(old, now), work, "diff")
            counts = [(r.status, r.n) for r in snapshot.difference_counts(diff).collect()]
            self.say(", ".join(f"{n} {status}" for status, n in sorted(counts)))
            other = diff.where("status <> 'reused'").select("path")
            sizes = old.unionByName(now).join(other, "path", "left_semi").groupBy("path").agg(F.max("size").alias("size"))
            touched = {r.bucket for r in placed(ranges.ranges(sizes, self.sizes[0]), manifest).select("bucket").distinct().collect()}  # at most a row a bucket
            base = Manifest(manifest.number, {b: None if b in touched else v for b, v in manifest.buckets.items()})
            kept = len(base.buckets) - len(touched)
            if touched:
                filled = placed(ranges.ranges(now, self.sizes[0]), base).groupBy("bucket").agg(F.sum("share").alias("n"))
                base = base.split({r.bucket: r.n for r in filled.collect() if r.bucket in touched}, store.target)
                fresh = self._read(now.join(diff.where("status in ('added', 'changed')").select("path"), "path", "left_semi"))
                part = store.read(touched, manifest=manifest)
                if part is not None:
                    fresh = part.select(*ROWS).join(diff.where("status = 'reused'").select("path"), "path", "left_semi").unionByName(fresh)
                store.write(new_version(), fresh, base)
            changes.forget(listed)
        finally:
            work.delete("")
        return self.spark.createDataFrame([*counts, ("buckets kept", kept), ("buckets written", len(base.buckets) - kept)], "status string, n long")

    def change(self, file: str, paths: list[str]) -> None:
        """Add paths that the project's groups accept to its change list. They need not be there any more."""
        full = [(config.normal_path(os.getcwd(), p),) for p in paths]
        new = groups.project_files(self._group(file), self.spark.createDataFrame(full, "path string"))
        if not new.isEmpty():
            changes = self._changes(file)
            changes.write(snapshot.merged_changes(changes.read(), new))

    def changes(self, file: str) -> DataFrame:
        return self._changes(file).read()

    def corpus(self, file: str, query: str | None = None, options: Options = Options()) -> DataFrame:
        """Indexed contents with the change list laid on top; with a query, only chunks that may hold a match."""
        return self.parts(file, query, options)(None, None)

    def parts(self, file: str, query: str | None = None, options: Options = Options()) -> Callable[[str | None, str | None], DataFrame]:
        """The corpus by ranges of paths (see ``early.within``): of changed files only those in the range are read."""
        store = self._store(file)
        manifest = store.manifest()
        rows = store.read(manifest=manifest)
        if rows is None:
            if manifest is None:
                raise ValueError(f"{file} has no index; run update")
            rows = self.spark.createDataFrame([], "path string, part_no int, start_line int, content string, mtime long, size long, chunk_id long")
        elif query is not None and (need := index.wanted(query, options)) is not None:
            rows = slices.pruned(rows, store.read(what="index", manifest=manifest), need)
        rows, changes = rows.select(*ROWS), self.changes(file)
        none = changes.isEmpty()

        def part(begin: str | None, end: str | None) -> DataFrame:
            own = early.within(rows, begin, end)
            if none:
                return own
            told = early.within(changes, begin, end)
            return snapshot.overlaid(own, told, self._read(tree.stats(told)))

        return part

    def search(self, spec: str, query: str, options: Options = Options()) -> DataFrame:
        """Matching lines of several projects in list order, with their printed ``text``."""
        return self._searched(config.projects(spec, self.home), query, options)

    def _searched(self, projects: list[tuple[str, str]], query: str, options: Options) -> DataFrame:
        return self._shown([(n, self.corpus(f, query, options)) for n, f in projects], query, options)

    def _shown(self, chosen: list[tuple[str, DataFrame]], query: str, options: Options) -> DataFrame:
        found = lines.search_projects(chosen, query, options)
        if options.column:
            found = lines.columns(found, query, options)
        return formats.rendered(found, query, options)

    def _first(self, spec: str, query: str, options: Options) -> Iterator[Row]:
        """The first lines up to the limit, by project and by ranges of paths: what comes after the one in which it is reached is not searched."""
        left = options.limit
        for name, file in config.projects(spec, self.home):
            if left:
                found = lambda rows, n: self._shown([(name, rows)], query, replace(options, limit=n)).select("text")  # noqa: E731, B023
                for r in early.first_rows(self.parts(file, query, options), self._cuts(file), left, found):
                    left -= 1
                    yield r

    def _cuts(self, file: str) -> list[str]:
        """Where a project's paths are cut: buckets are by hash, so the chunks of a few of them begin all over its paths."""
        store = self._store(file)
        manifest = store.manifest()
        some = [b for b, v in sorted(manifest.buckets.items()) if v][:CUT_BUCKETS] if manifest else []
        if not some:
            return []
        later = F.col("chunk_id").bitwiseAND(F.lit(0xFFFFFFFF)) > 0  # first chunks all begin where the paths do
        begins = store.read(set(some), manifest=manifest).where(later).groupBy("chunk_id").agg(F.min("path").alias("path"))
        return early.thinned([r.path for r in begins.select("path").collect()])  # a row a chunk of some buckets

    def files(self, spec: str, query: str, options: Options = Options()) -> DataFrame:
        """Paths of projects that match; column pruning leaves contents unread."""
        rows = None
        for i, (_, f) in enumerate(config.projects(spec, self.home)):
            own = files.entries(self._listed(self._store(f)).select("path"), F.struct(F.lit(i).alias("project"), F.col("path").alias("path")))
            rows = own if rows is None else rows.unionByName(own)
        return files.find(rows, query, options)

    def filter(self, rows: DataFrame, query: str, options: Options = Options()) -> DataFrame:
        """The path matchers over any one-column table of lines."""
        numbered = rows.withColumn("ord", F.monotonically_increasing_id())
        return files.find(files.entries(numbered, F.col("ord")), query, options)

    def info(self, spec: str) -> DataFrame:
        """One row a project: files, lines, bytes in the files and in the store, chunks, filters, and parts that break the index's order."""
        out = None
        for name, f in config.projects(spec, self.home):
            store, rows = self._store(f), self.corpus(f)
            own = info.summary(rows).withColumn("project", F.lit(name))
            stored = store.stored_bytes()
            own = own.withColumn("stored_bytes", F.lit(stored).cast("long")).withColumn("ratio", F.col("bytes") / F.lit(max(1, stored)))
            if (data := store.read()) is not None:
                chunks = info.chunk_stats(data.select("chunk_id", F.octet_length("content").cast("long").alias("size"))).select("chunks", F.col("least").alias("least_chunk"), F.col("most").alias("largest_chunk"))
                filters = slices.stats(store.read(what="index")).select(F.col("indexed").alias("filters"), F.col("bytes").alias("filter_bytes"), "filled_avg")
                counted = info.line_counts(data.select("path", "part_no", "start_line", "size", "mtime", "chunk_id", "content")).drop("bytes", "longest")
                broken = info.integrity(counted, bucketed=True).where("not (order_ok and metadata_ok and lines_ok)").agg(F.count(F.lit(1)).alias("broken"))
                for one in (chunks, filters, broken):  # a row each
                    own = own.join(F.broadcast(one))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def watch(self, file: str, seconds: float = BEAT, files: int = UPDATE_FILES, quiet: float = UPDATE_QUIET) -> Watch:
        """A watch of one project; ``start`` begins its beats."""
        changes, store = self._changes(file), self._store(file)

        def now() -> tuple[config.Group, known.KnownTree]:
            group = self._group(file)
            return group, known.KnownTree(self.spark, store.top, self._roots(group))

        before: known.KnownTree | None = None

        def mark() -> tuple:
            nonlocal before
            group, seen = now()
            if before and before.folder.top != seen.folder.top:  # the project file has other folders now
                before.folder.delete("")
            before = seen
            seen.look()
            return seen.folder.top, seen.number(), store.folder.numbers("MANIFEST-"), changes.number(), self._named(group), Path(file).read_text()

        def changed() -> DataFrame:
            group, seen = now()
            return snapshot.changed_paths(self._listed(store), self._chosen(group, seen.files()))

        return Watch(changed, changes.read, changes.write, lambda: self.update(file), files, quiet, mark=mark, last=changes.written() or None)

    def execute(self, words: list[str], rows: DataFrame | None = None) -> list[str]:
        """One command; all lines that it prints. ``rows`` is the input of ``filter``. ``watch`` starts queries that run on, in ``watching``."""
        return list(self.lines(words, rows))

    def lines(self, words: list[str], rows: DataFrame | None = None) -> Iterator[str]:
        """One command; its lines one after the other: the driver holds those of one partition of a result at a time."""
        verb, *rest = words or ["help"]
        if verb in ("search", "files", "filter"):
            spec, *own = [None, *rest] if verb == "filter" else rest
            options, query = from_arguments(own)
            began, n = time.time(), 0
            if verb == "search" and options.limit is not None:
                found = self._first(spec, query, options)
            else:
                found = (self.filter(rows, query, options).select("path") if verb == "filter" else self.search(spec, query, options).select("text") if verb == "search" else self.files(spec, query, options).select("path")).toLocalIterator()
            for n, r in enumerate(found, 1):
                yield r[0]
            if options.summary and verb != "filter":
                yield formats.summary(n, time.time() - began, options.limit)
        else:
            yield from self._told(verb, rest)

    def _told(self, verb: str, rest: list[str]) -> list[str]:
        if verb == "version":
            return [VERSION]
        if verb == "projects":
            return [n for n, _ in config.projects("*", self.home)]
        if verb == "init":
            return [self.init(*rest)]
        if verb in ("build", "update"):
            out = []
            for name, f in config.projects(rest[0], self.home):
                if verb == "build":
                    self.build(f)
                    out.append(name)
                else:
                    n = {r.status: r.n for r in self.update(f).collect()}
                    out.append(f"{name}: +{n.get('added', 0)} -{n.get('removed', 0)} *{n.get('changed', 0)}")
            return out
        if verb == "change":
            for _, f in config.projects(rest[0], self.home):
                self.change(f, rest[1:])
            return []
        if verb == "watch":
            out = []
            for name, f in config.projects(rest[0], self.home):
                self.watching.append(self.watch(f).start(self.spark))
                out.append(f"Watching {name}")
            return out
        if verb == "info":
            shown = self.info(rest[0]).withColumn("shown", grouped(F.col("bytes"))).collect()
            out = []
            for r in shown:
                out.append(f"{r.project}: {r.files} files, {r.shown} bytes, {r.lines} lines, longest {r.longest_line} in {r.longest_file}")
                if "chunks" in r and r.chunks is not None:
                    out.append(f"{r.project}: {r.stored_bytes} bytes stored ({r.ratio:.2f} to one), {r.chunks} chunks up to {r.largest_chunk} bytes, {r.filters} filters of {r.filter_bytes} bytes, {r.broken} parts out of order")
            return out
        return HELP.split("\n")

    def interactive(self, spec: str, ask: Callable[[], str | None], say: Callable[[str], None], options: list[str] = (), watch: bool = True) -> None:
        """Watch the projects and answer lines ``search QUERY`` and ``files QUERY``, with the options of this call, until there are none."""
        began = [self.watch(f).start(self.spark) for _, f in config.projects(spec, self.home)] if watch else []
        try:
            while (line := ask()) is not None:
                verb, _, query = line.strip("\n").partition(" ")
                if verb in ("search", "files"):
                    for out in self.execute([verb, spec, *options, query]):
                        say(out)
        finally:
            for q in began:
                q.stop()
