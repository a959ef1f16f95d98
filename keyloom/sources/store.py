"""A versioned store of keyspaces: tables and index entries in key ranges, and one manifest file for each published version.

A version is published by giving its manifest a name that nobody has yet, which fails if another writer was first; readers pin a version and
see it unchanged. That takes a file system on which this is atomic: a link on local disks, a rename that refuses to replace on HDFS, viewfs
and ABFS with hierarchical names. On other stores, where a rename is a copy, ``Store`` is refused unless ``atomic_rename`` says that the
store in use has one.

A transaction's ``put``, ``insert``, ``replace`` and ``delete`` rewrite the key ranges they touch, of the table and of each of its indexes; ``write``
replaces a table. ``vacuum`` removes old versions and folders that no version names.
"""

from __future__ import annotations

import copy
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import (
    Conflict, IndexExists, IndexFingerprintMismatch, IndexNotFound, InvalidOptions, KeyspaceExists, KeyspaceKindMismatch, KeyspaceNotFound, ReadOnly, TxClosed,
)
from ..operators import write as verbs
from ..operators.index import check, collapsed, entries, key_name, maintained, require_unique_added
from .model import Bound, Keyspace, SetKeyspace
from .ranged import Ranges

#: File systems whose rename is atomic and can refuse to replace.
SAFE = ("file", "hdfs", "viewfs", "abfs", "abfss")


class Store:
    def __init__(self, spark: SparkSession, path: str, atomic_rename: bool = False, ranges: int | None = None):
        self.spark, self.path, self.ranges = spark, path.rstrip("/"), ranges
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme not in SAFE and not atomic_rename:
            raise InvalidOptions(f"{self._scheme}: no atomic rename is known; atomic_rename=True says there is one")
        self._fs.mkdirs(self._at(self.manifests))
        if not self.versions():
            self._publish(1, {"version": 1, "spaces": {}})

    @property
    def manifests(self) -> str:
        return f"{self.path}/versions"

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._at(self.manifests)) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def version(self) -> int:
        return self.versions()[-1]

    def manifest(self, version: int | None = None) -> dict:
        name = f"{self.manifests}/{version or self.version():012d}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(name, wholetext=True).collect()))  # one small file

    def _publish(self, version: int, manifest: dict) -> None:
        """Write aside, then name: a reader sees the whole manifest or none, and only one writer gets the name."""
        side, final = self._at(f"{self.manifests}/.{uuid.uuid4().hex}"), self._at(f"{self.manifests}/{version:012d}.json")
        out = self._fs.create(side, False)
        out.write(bytearray((json.dumps(manifest, sort_keys=True) + "\n").encode()))
        out.close()
        try:
            if self._scheme == "file":
                file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(file(final), file(side))
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(side, final, options)
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise Conflict(f"version {version}") from None
            raise e
        finally:
            self._fs.delete(side, False)

    def vacuum(self, keep: int = 1, older_than: float = 24 * 3600.0) -> tuple[int, int]:
        """Remove all but the newest ``keep`` versions, and folders that none of the rest names; how many of each went.

        Folders younger than ``older_than`` seconds stay: a transaction that is still open may have written them.
        """
        old = self.versions()[: -max(keep, 1)]
        for v in old:
            self._fs.delete(self._at(f"{self.manifests}/{v:012d}.json"), False)
        named = set()
        for v in self.versions():
            for info in self.manifest(v)["spaces"].values():
                for parts in (info["parts"], *(x["parts"] for x in info["indexes"].values())):
                    named |= {p["path"].split("/")[1] for p in parts if p["path"]}
        tables, gone, now = self._at(f"{self.path}/tables"), 0, time.time()
        for s in self._fs.listStatus(tables) if self._fs.exists(tables) else ():
            if s.getPath().getName() not in named and now - s.getModificationTime() / 1000 >= older_than:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return len(old), gone

    def wait_version(self, after: int, timeout: float = 10.0, space: str | None = None) -> int:
        """The newest version once it is above ``after`` (or once it changed ``space``); the newest at the time limit."""
        end = time.time() + timeout
        while True:
            now = self.version()
            if now > after and (space is None or any(space in self.manifest(v).get("changed", []) for v in self.versions() if v > after)):
                return now
            if time.time() >= end:
                return now
            time.sleep(0.05)

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def update(self, work) -> int:
        """Run ``work(tx)`` and publish; on an error nothing is published."""
        tx = self.begin()
        work(tx)
        return tx.commit()

    def batch(self, works) -> tuple[int, list[Exception | None]]:
        """Run several works in one version. Each is isolated: one that fails leaves no trace and doesn't touch the others."""
        tx, errors = self.begin(), []
        for work in works:
            child = tx.child()
            try:
                work(child)
                child.commit()
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                child.rollback()
                errors.append(e)
        return tx.commit(), errors

    def copy_to(self, path: str, version: int | None = None) -> Store:
        """A consistent copy of one version, rewritten: ranges of even size again, each one sorted."""
        other, snap = Store(self.spark, path, ranges=self.ranges), self.snapshot(version)
        tx = other.begin()
        for name, info in snap.manifest["spaces"].items():
            tables = {"": info, **info["indexes"]}
            done = {k: v | {"parts": tx._ranges(v).write(snap._ranges(v).read()).parts} for k, v in tables.items()}
            tx._spaces()[name] = done.pop("") | {"indexes": done}
            tx.changed.add(name)
        tx.commit()
        return other

    def keyspaces(self) -> DataFrame:
        """name and kind of each keyspace of the newest version."""
        rows = sorted((n, i["kind"]) for n, i in self.manifest()["spaces"].items())
        return self.spark.createDataFrame(rows, "name string, kind string")

    def changes(self) -> DataFrame:
        """A stream with a row for each published version: version, changed, spaces."""
        kind = T.StructType([T.StructField("version", T.LongType()), T.StructField("changed", T.ArrayType(T.StringType()))])
        return self.spark.readStream.schema(kind).json(self.manifests)


class Snapshot:
    """A pinned version."""

    writable = False

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest

    def _spaces(self) -> dict:
        return self.manifest["spaces"]

    def _ranges(self, info: dict) -> Ranges:
        return Ranges(self.store.spark, self.store.path, info["by"], T.StructType.fromJson(json.loads(info["schema"])), info["parts"], self.store.ranges)

    def keyspaces(self) -> list[str]:
        return sorted(self._spaces())

    def _info(self, space: Keyspace) -> dict:
        info = self._spaces().get(space.name)
        if info is None:
            raise KeyspaceNotFound(space.name)
        if info["kind"] != space.kind:
            raise KeyspaceKindMismatch(space.name)
        return info

    def open(self, space: Keyspace) -> Bound:
        """The keyspace's rows and stored entries. An index that was stored for another declaration is an error, never rebuilt unasked."""
        info = self._info(space)
        stored = {}
        for i in space.indexes:
            got = info["indexes"].get(i.name)
            if got is None:
                continue
            if got["fingerprint"] != i.fingerprint:
                raise IndexFingerprintMismatch(i.name)
            stored[i.name] = self._ranges(got).read()
        return self._bound(space, self._ranges(info).read(), stored)

    @staticmethod
    def _bound(space: Keyspace, rows: DataFrame, stored: dict[str, DataFrame]) -> Bound:
        return space.bind_distinct(rows, stored) if isinstance(space, SetKeyspace) else space.bind(rows, stored)

    def stats(self) -> DataFrame:
        """name, kind, rows of each keyspace and index."""
        parts = []
        for name, info in self._spaces().items():
            parts.append(self._ranges(info).read().agg(F.lit(name).alias("name"), F.lit(info["kind"]).alias("kind"), F.count("*").alias("rows")))
            for k, v in info["indexes"].items():
                parts.append(self._ranges(v).read().agg(F.lit(f"{name}.{k}").alias("name"), F.lit("index").alias("kind"), F.count("*").alias("rows")))
        out = parts[0] if parts else self.store.spark.createDataFrame([], "name string, kind string, rows long")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def check(self, *spaces: Keyspace) -> DataFrame:
        out = self.store.spark.createDataFrame([], "code string, subject string, n long")
        for s in spaces:
            out = out.unionByName(check(self.open(s)))
        return out

    def write(self, *_):
        raise ReadOnly("a snapshot")


class Transaction(Snapshot):
    """Staged tables that one commit publishes. A child merges into its parent or is discarded."""

    writable = True

    def __init__(self, store: Store, manifest: dict, parent: Transaction | None = None):
        super().__init__(store, copy.deepcopy(manifest))
        self.parent, self.closed, self.changed = parent, False, set()
        self.frozen = False

    def _spaces(self) -> dict:
        return self.manifest["spaces"]

    def _open(self) -> None:
        if self.closed or self.frozen:
            raise TxClosed("ended, or a child is open")

    def create(self, space: Keyspace, rows: DataFrame, if_not_exists: bool = False) -> None:
        self._open()
        if space.name in self._spaces():
            if if_not_exists:
                self._info(space)
                return
            raise KeyspaceExists(space.name)
        self._spaces()[space.name] = {"kind": space.kind, "by": list(space.pk), "schema": "", "parts": [], "indexes": {}, "sequence": 0}
        self.write(space.bind(rows))

    def write(self, bound: Bound) -> None:
        """Stage new rows for the whole table, with the entries of the declared indexes."""
        self._open()
        info = self._info(bound.space)
        info["schema"] = bound.rows.schema.json()
        info["parts"] = self._ranges(info | {"parts": []}).write(bound.rows).parts
        fresh = self._bound(bound.space, self._ranges(info).read(), {})
        for i in bound.space.indexes:
            self._store_index(info, fresh, i)
        self.changed.add(bound.space.name)

    def _store_index(self, info: dict, bound: Bound, index) -> None:
        got = entries(Bound(bound.space, bound.rows, {}), index)
        kept = {"by": [*[key_name(c) for c in index.columns], *bound.space.pk], "schema": got.schema.json(), "fingerprint": index.fingerprint, "parts": []}
        info["indexes"][index.name] = kept | {"parts": self._ranges(kept).write(got).parts}

    def _touch(self, space: Keyspace, keys: DataFrame, work) -> None:
        """Change the rows of ``keys`` with ``work`` (from the touched ranges' rows to theirs after): only those ranges, and the ranges of their entries, are rewritten."""
        self._open()
        info, pk = self._info(space), list(space.pk)
        before, keys = self._ranges(info), keys.select(*pk).distinct()
        stored = self.open(space).entries
        numbers = before.touched(keys)
        here = self._bound(space, before.read(numbers), {})
        after = work(here)
        new = after.rows.join(keys, pk, "left_semi").select(*here.rows.columns)
        rest = before.read(set(range(len(before.parts))) - set(numbers))
        for i in space.indexes:
            if i.unique:  # the touched ranges' own keys were looked at by the verb
                require_unique_added(Bound(space, rest, {}), i, new)
        replaced = before.replace(numbers, after.rows)
        old = here.rows.join(keys, pk, "left_semi").select(*here.rows.columns)
        for i in space.indexes:
            if i.name not in stored:
                self._store_index(info, self._bound(space, replaced.read(), {}), i)
                continue
            ranges = self._ranges(info["indexes"][i.name])
            first = ranges.by[0]
            moved = ranges.touched(collapsed(here, i, old).select(first).unionByName(collapsed(here, i, new).select(first)))
            part = Bound(space, here.rows, {i.name: ranges.read(moved)})
            info["indexes"][i.name]["parts"] = ranges.replace(moved, maintained(part, i, keys, new)).parts
        info["parts"] = replaced.parts
        self.changed.add(space.name)

    def put(self, space: Keyspace, new: DataFrame, sequence: str | None = None) -> None:
        self._touch(space, new, lambda b: verbs.put(b, new, sequence))

    def insert(self, space: Keyspace, new: DataFrame) -> None:
        self._touch(space, new, lambda b: verbs.insert(b, new))

    def replace(self, space: Keyspace, new: DataFrame) -> None:
        self._touch(space, new, lambda b: verbs.replace(b, new))

    def delete(self, space: Keyspace, keys: DataFrame) -> None:
        self._touch(space, keys, lambda b: verbs.delete(b, keys))

    def create_index(self, space: Keyspace, name: str) -> None:
        self._open()
        if name in self._info(space)["indexes"]:
            raise IndexExists(name)
        self.rebuild_index(space, name)

    def rebuild_index(self, space: Keyspace, name: str) -> None:
        """Make an index again from the staged rows; the old one stays until that worked. Drift is no obstacle here."""
        self._open()
        info, index = self._info(space), space.index(name)
        self._store_index(info, self._bound(space, self._ranges(info).read(), {}), index)
        self.changed.add(space.name)

    def drop_index(self, space: Keyspace, name: str) -> None:
        self._open()
        if self._info(space)["indexes"].pop(name, None) is None:
            raise IndexNotFound(name)
        self.changed.add(space.name)

    def drop(self, space: Keyspace) -> None:
        self._open()
        self._info(space)
        del self._spaces()[space.name]
        self.changed.add(space.name)

    def next_sequence(self, space: Keyspace, n: int = 1) -> int:
        """The first of ``n`` numbers nobody had before; the first ever is 1."""
        self._open()
        info = self._info(space)
        info["sequence"] += n
        self.changed.add(space.name)
        return info["sequence"] - n + 1

    def child(self) -> Transaction:
        self._open()
        self.frozen = True
        return Transaction(self.store, self.manifest, self)

    def commit(self) -> int:
        self._open()
        self.closed = True
        if self.parent is not None:
            self.parent.frozen = False
            self.parent.manifest, self.parent.changed = self.manifest, self.parent.changed | self.changed
            return self.manifest["version"]
        version = self.manifest["version"] + 1
        self.store._publish(version, self.manifest | {"version": version, "changed": sorted(self.changed)})
        return version

    def rollback(self) -> None:
        self._open()
        self.closed = True
        if self.parent is not None:
            self.parent.frozen = False
