"""Versioned publication: tables in a new folder, a manifest with digests and counts, and one pointer that moves last.

Files are written, hashed and read by Spark; the driver moves folders and writes the manifest, through Hadoop's file systems.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidetrace import vocab
from sidetrace.operators import digest as D


class ReleaseError(RuntimeError):
    """A release is broken, or may not be published."""


def version(digest: str, when: datetime | None = None) -> str:
    when = when or datetime.now(timezone.utc)
    return f"{when:%Y%m%dT%H%M%S%f}Z-{digest[:12]}"


def _checked(v: object) -> str:
    if not isinstance(v, str) or not re.fullmatch(vocab.VERSION_PATTERN[1:-1], v):
        raise ReleaseError(f"bad version {v!r}")
    return v


class Store:
    """The file system of a release root, through Hadoop, so that a root may lie wherever Spark can write."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        sc = SparkSession.builder.getOrCreate().sparkContext
        self.jvm = sc._jvm
        self.fs = self.path().getFileSystem(sc._jsc.hadoopConfiguration())
        self.fs.setVerifyChecksum(False)
        self.fs.setWriteChecksum(False)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(*parts))) if self.exists(*parts) else []

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise ReleaseError(f"{source} can't become {target}")

    def text(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> None:
        """The file appears whole: it is written beside its place, and moved over it."""
        target = self.path(*parts)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = SparkSession.builder.getOrCreate().sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri()).rename(beside, target, over)

    def lock(self, wait: float = 600.0) -> None:
        """Takes the root's lock, a file that only one can create; waits for another to give it back."""
        self.fs.mkdirs(self.path())
        until = time.monotonic() + wait
        while True:
            try:
                self.fs.create(self.path(".lock"), False).close()
                return
            except Py4JJavaError as e:
                if not self.exists(".lock"):
                    raise
                if time.monotonic() > until:
                    raise ReleaseError(f"{self.root}/.lock is held; remove it if its holder is gone") from e
                time.sleep(0.5)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def file_digests(path: str) -> DataFrame:
    """Rows (name, sha256, bytes) of a table's data files, folders of partitions included; executors read and hash them."""
    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    # names below the table's own folder, whatever the root is called
    name = F.regexp_extract("path", ".*/" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def folder_digest(path: str) -> str:
    """SHA-256 over the names and digests of a table's data files, one line a file; bytes stay on the executors."""
    try:
        found = sorted(tuple(r) for r in file_digests(path).collect())
    except (AnalysisException, Py4JJavaError, SparkRuntimeException) as e:
        raise ReleaseError(f"{path} doesn't match its digest: it can't be read") from e
    return hashlib.sha256("".join(f"{name}\0{digest}\n" for name, digest, _ in found).encode()).hexdigest()


def rows_digest(tables: dict[str, DataFrame]) -> str:
    """SHA-256 over the rows of tables, in no order: what a version made of content is named by."""
    parts = []
    for name, df in sorted(tables.items()):
        rows = df.select(D.record_digest(*sorted(df.columns)).alias("d"))
        r = D.aggregate_digest(rows, "d", "d").first()
        parts.append(f"{name}\0{r['n']}\0{r['digest']}\n")
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@contextlib.contextmanager
def locked(root: str) -> Iterator[Store]:
    store = Store(root)
    store.lock()
    try:
        yield store
    finally:
        store.delete(".lock")


def publish(root: str, name: str, tables: dict[str, DataFrame], gate: DataFrame | None = None, keep: int = 3, counts: dict[str, int] | None = None, partitions: dict[str, str] | None = None) -> dict:
    """Writes tables below root/releases/name and points current.json at them.

    With a gate (rows with a verdict) any row that isn't ok stops the publication before anything is visible. ``counts`` are
    kept in the manifest for the next regression gate; ``partitions`` names the column by which a table is split into
    folders. The newest ``keep`` releases stay. Under a lock, so that two publications don't mix; a failed one leaves the
    pointer as it was.
    """
    name = _checked(name)
    with locked(root) as store:
        if gate is not None and (bad := gate.where("verdict <> 'ok'").limit(10).collect()):
            raise ReleaseError(f"the gate rejects {[r['metric'] for r in bad]}")
        final, staging = f"releases/{name}", f".staging-{name}"
        if store.exists(final):
            raise ReleaseError(f"release {name} exists")
        store.delete(staging)
        try:
            artifacts = {}
            for table, df in tables.items():
                column = (partitions or {}).get(table)
                out = df.repartition(column, *(c for c in ("x",) if c in df.columns)) if column else df
                (out.write.partitionBy(column) if column else out.write).parquet(f"{store.root}/{staging}/{table}")
                artifacts[table] = {"path": f"{final}/{table}", "sha256": folder_digest(f"{store.root}/{staging}/{table}"), "rows": df.sparkSession.read.parquet(f"{store.root}/{staging}/{table}").count()}
            store.move(staging, final)
        finally:
            store.delete(staging)
        before = read(root, missing_ok=True)
        history = list(dict.fromkeys([name, *([before["version"], *before["history"]] if before else [])]))[:keep]
        manifest = {"manifest_version": 2, "version": name, "history": history, "artifacts": artifacts, "counts": counts or {}}
        store.put(canonical_json(manifest), final, "manifest.json")
        store.put(canonical_json(manifest), "current.json")
        for old in store.names("releases"):
            if old not in history:
                store.delete("releases", old)
        return manifest


def activate(root: str, name: str) -> dict:
    """Points back at a retained release, after its digests are checked."""
    with locked(root) as store:
        current = read(root)
        if _checked(name) not in current["history"]:
            raise ReleaseError(f"release {name} isn't retained")
        wanted = json.loads(store.text("releases", name, "manifest.json"))
        verify(root, wanted)
        wanted["history"] = [name, *(v for v in current["history"] if v != name)]
        store.put(canonical_json(wanted), "current.json")
        return wanted


def promote(staging: str, root: str, name: str, gate: DataFrame | None = None, keep: int = 3) -> dict:
    """Publishes the current release of another root, whose digests are checked first, under a name in this one."""
    spark = SparkSession.builder.getOrCreate()
    return publish(root, name, load(spark, staging), gate, keep, read(staging).get("counts"), {"tiles": "z"})


#: The keys of a manifest by its version; the first one had no counts.
FORMS = {1: {"manifest_version", "version", "history", "artifacts"}, 2: {"manifest_version", "version", "history", "artifacts", "counts"}}


def read(root: str, missing_ok: bool = False) -> dict | None:
    """The current manifest; anything that isn't as it should be raises. A manifest of the first form has empty counts."""
    store = Store(root)
    if missing_ok and not store.exists("current.json"):
        return None
    try:
        m = json.loads(store.text("current.json"))
    except (Py4JJavaError, ValueError) as e:
        raise ReleaseError("the manifest can't be read") from e
    if not isinstance(m, dict) or isinstance(m.get("manifest_version"), bool) or set(m) != FORMS.get(m.get("manifest_version")):
        raise ReleaseError("the manifest has another form")
    _checked(m["version"])
    for v in m["history"]:
        _checked(v)
    for a in m["artifacts"].values():
        parts = a["path"].split("/")
        if a["path"].startswith("/") or ":" in a["path"] or ".." in parts or parts[0] != "releases" or not re.fullmatch("[0-9a-f]{64}", a["sha256"]):
            raise ReleaseError("an artifact lies outside or has no digest")
    m.setdefault("counts", {})
    if not all(isinstance(n, int) and not isinstance(n, bool) and n >= 0 for n in m["counts"].values()):
        raise ReleaseError("the manifest's counts aren't counts")
    return m


def verify(root: str, manifest: dict) -> None:
    """Raises if a table's files aren't those that were published."""
    for name, a in manifest["artifacts"].items():
        if folder_digest(f"{root.rstrip('/')}/{a['path']}") != a["sha256"]:
            raise ReleaseError(f"{name} doesn't match its digest")


class Checksums:
    """Whether releases hold, told at once: verifying until a check ends, then verified or invalid. One check of a release runs at a time."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, str], str] = {}
        self.guard = threading.Lock()

    def status(self, root: str, manifest: dict, wait: bool = False) -> str:
        key = (root, hashlib.sha256(canonical_json(manifest).encode()).hexdigest())
        with self.guard:
            if key in self.found and not wait:
                return self.found[key]
            started = key in self.found
            self.found.setdefault(key, "verifying")
        if not started:
            job = threading.Thread(target=self._check, args=(root, manifest, key), daemon=True)
            job.start()
            if wait:
                job.join()
        return self.found[key]

    def _check(self, root: str, manifest: dict, key: tuple[str, str]) -> None:
        try:
            verify(root, manifest)
            self.found[key] = "verified"
        except ReleaseError:
            self.found[key] = "invalid"


def load(spark: SparkSession, root: str, name: str | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables of the current or a retained release; with check, only if their digests hold."""
    m = read(root)
    if name is not None and name != m["version"]:
        if name not in m["history"]:
            raise ReleaseError(f"release {name} isn't retained")
        m = json.loads(Store(root).text("releases", _checked(name), "manifest.json"))
    if check:
        verify(root, m)
    return {t: spark.read.parquet(f"{root.rstrip('/')}/{a['path']}") for t, a in m["artifacts"].items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (metric, n): the row count of each table, for the regression gate."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = part if out is None else out.union(part)
    return out
