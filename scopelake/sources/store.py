"""A namespace of tables on any file system that Spark reaches: canonical rows, log, ledger, operations, cursors, roles, blobs.

All rows are Parquet folders that are written once. Which folders make up a table is told by numbered version files: a step
writes its folders first and then names them all in the next file, so readers see all of a step or nothing, and a failed
write leaves no trace. A file is created only if it is not there yet (as exclusively as the file system creates files), so
of two writers that start from one state the second gets a Conflict if it names a table that the first has named too.

Three kinds of tables: whole ones are replaced (operations, cursors, roles, blobs: outboxes and small state); canonical ones
lie in buckets by row id, and a change writes the buckets it touches anew; logs (log, ledger, the feed of writes, and the
state behind numbering) only get parts added, one for each step, and old parts are folded together once there are many.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.log import CHANGE_FIELDS, Known
from ..operators.push import Push, written
from ..operators.relations import keep_except_ghosts
from ..operators.view import confirmed, derive_view, fold
from ..plans.catalog import TableDef

_VERSIONS = "name string, at bigint, folder string, epoch bigint"
_EPOCH, _HEAD = "__epoch", "__head"
#: Buckets of a canonical table where none are given.
BUCKETS = 16
#: Parts of a state table before they are folded into one.
PARTS = 16
#: How long a version file may be there without its content before its writer counts as lost, in seconds.
PATIENCE = 30.0
OPERATIONS = "op_id string, client_id string, user_id string, schema_version int, function_name string, `table` string, kind string, id string, value string, patch string, created_at double, status string, error string, group_id string, group_index int"
LEDGER = f"user_id string, op_id string, schema_version int, status string, error string, change struct<{CHANGE_FIELDS}>"
CHANGES = "scope_key string, change_id string, `table` string, id string, kind string, value string, patch string, version bigint, server_time double, op_id string"


class Conflict(RuntimeError):
    """Another writer has changed what this one started from; read again and repeat."""


def _picked(rows: DataFrame, key: str, pick: Callable) -> DataFrame:
    """One row of each key, picked by the order of the frame."""
    numbered = rows.withColumn("__at", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c != key]
    picked = numbered.groupBy(key).agg(pick(F.struct(*(F.col(f"`{c}`") for c in rest)), "__at").alias("__r"))
    return picked.select(*(F.col(key) if c == key else F.col("__r")[c].alias(c) for c in rows.columns))


class Store:
    """Tables under `path`/`namespace`, with `buckets` for each canonical one: choose them so that a bucket is a few files.

    clear() starts a new epoch: what was written before is gone, and a writer that still names an older epoch is fenced.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default", buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, f"{path.rstrip('/')}/{namespace}", buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self._jvm.Path(f"{self.base}/{name}")

    def bucket(self, column: str = "_id") -> F.Column:
        """The bucket of a row of a canonical table: a change rewrites the buckets of the rows that it touches."""
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    # Versions

    def version(self) -> int:
        """The number of the last step. A file that is still being written is waited for."""
        until = time.time() + PATIENCE
        while True:
            newest = max(((int(s.getPath().getName()[:12]), s.getLen()) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json")), default=(0, 1))
            if newest[1] or time.time() > until:
                return newest[0]
            time.sleep(0.05)

    def _named(self) -> DataFrame:
        return self.spark.read.schema(_VERSIONS).json(f"{self.base}/versions")

    def _claim(self, number: int, entries: list[tuple[str, str, int]]) -> bool:
        """Writes a version file; False if that number is taken."""
        try:
            out = self._fs.create(self._path(f"versions/{number:012d}.json"), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write("".join(json.dumps({"name": n, "at": number, "folder": f, "epoch": e}) + "\n" for n, f, e in entries).encode())
        out.close()
        return True

    def _name(self, entries: list[tuple[str, str, int]], base: int) -> int:
        """Names folders in the next version, and returns it. A Conflict if one of the names was given since version base."""
        names = {n for n, *_ in entries}
        number = base + 1
        while not self._claim(number, entries):
            self.version()  # the file at that number is whole
            taken = {r["name"] for r in self._named().filter(F.col("at") == number).select("name").collect()}
            if clash := sorted(names & taken):
                raise Conflict(f"another writer has changed {clash[0].strip('_')!r} since version {base}")
            number += 1
        return number

    def epoch(self) -> int:
        return self._named().filter(F.col("name") == _EPOCH).agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def clear(self) -> int:
        """Drops all tables and returns the new epoch."""
        now = self.epoch() + 1
        self._name([(_EPOCH, "", now)], self.version())
        return now

    def _folders(self, prefix: str) -> dict[str, str]:
        """The latest folder of each table whose name begins so, as of one reading of the versions: a bounded number of names."""
        named = self._named().filter(F.col("name").startswith(prefix) | (F.col("name") == _EPOCH)).groupBy("name", "epoch").agg(F.max_by("folder", "at").alias("folder")).collect()
        now = max((r.epoch for r in named if r["name"] == _EPOCH), default=0)
        return {r["name"]: r.folder for r in named if r.epoch == now and r["name"].startswith(prefix) and r.folder}

    def replace_all(self, tables: dict[str, DataFrame], expected_epoch: int | None = None, staged: Callable[[], list[tuple[str, str]]] = list, base: int | None = None) -> bool:
        """Writes several tables, and the folders that `staged` makes, in one step. False, and nothing named, if the store was
        cleared since the epoch that the writer expects. base: the version that the rows were made from (default: now)."""
        base = self.version() if base is None else base
        now = self.epoch()
        if expected_epoch is not None and expected_epoch != now:
            return False
        made = []
        for name, rows in tables.items():
            made.append((name, f"data/{name.replace('#', '/')}/{uuid.uuid4().hex}"))
            rows.write.parquet(f"{self.base}/{made[-1][1]}")
        made += staged()
        if self.epoch() != now:
            return False
        self._name([(name, folder, now) for name, folder in made], base)
        return True

    def replace(self, name: str, rows: DataFrame, expected_epoch: int | None = None, base: int | None = None) -> bool:
        return self.replace_all({name: rows}, expected_epoch, base=base)

    def _rows(self, folders: list[str], schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The rows of a table; none if it was never written."""
        return self._rows([f for n, f in self._folders(name).items() if n == name], schema)

    # Tables that only grow

    def parts(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The rows of a table that steps add parts to."""
        return self._rows(list(self._folders(f"{name}#").values()), schema)

    def stage_parts(self, name: str, rows: DataFrame, part: Column) -> list[tuple[str, str]]:
        """Writes rows as many parts of a growing table, one for each value of `part`, in one job that reads them once; returns
        their names and folders, for replace_all to name."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.withColumn("__part", part).repartition("__part").sortWithinPartitions("__part").write.partitionBy("__part").parquet(f"{self.base}/{folder}")
        found = sorted(n for s in self._fs.listStatus(self._path(folder)) if (n := s.getPath().getName()).startswith("__part="))
        return [(f"{name}#{n.removeprefix('__part=')}", f"{folder}/{n}") for n in found]

    def _fold_parts(self, name: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Writes many parts of a state table as one; what is in them stays the same."""
        base = self.version()
        held = self._folders(f"{name}#")
        if len(held) > PARTS:
            folder = f"data/{name}/{uuid.uuid4().hex}"
            fold(self._rows(list(held.values()), schema)).write.parquet(f"{self.base}/{folder}")
            first, *rest = sorted(held)
            with contextlib.suppress(Conflict):  # another writer has done it
                self._name([(first, folder, self.epoch()), *((n, "", self.epoch()) for n in rest)], base)

    # Canonical rows

    @staticmethod
    def row_schema(table: TableDef) -> T.StructType:
        return T.StructType([T.StructField("_id", T.StringType()), *table.shape.fields, T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def canonical(self, table: TableDef, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        found = self._folders(f"canonical/{table.name}#")
        return self._rows([f for name, f in found.items() if buckets is None or int(name.rpartition("#")[2]) in buckets], self.row_schema(table))

    def has_parts(self, folder: str) -> bool:
        """Whether a folder that was written by partitions has any."""
        return any("=" in s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def _stage(self, table: TableDef, rows: DataFrame, buckets: list[int]) -> list[tuple[str, str]]:
        """Writes all rows of some buckets, and returns their names and folders."""
        folder = f"data/canonical/{table.name}/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self.bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.base}/{folder}")
        full = {int(n.rpartition("=")[2]) for s in self._fs.listStatus(self._path(folder)) if (n := s.getPath().getName()).startswith("__bucket=")}
        return [(f"canonical/{table.name}#{b}", f"{folder}/__bucket={b}" if b in full else "") for b in buckets]

    def _fold(self, table: TableDef, changes: DataFrame) -> list[tuple[str, str]]:
        """The buckets that changes touch, folded and written anew."""
        touched = sorted(r.b for r in changes.select(self.bucket("id").alias("b")).distinct().collect())  # bucket numbers
        return self._stage(table, fold(table, self.canonical(table, touched), changes), touched) if touched else []

    def vacuum(self) -> int:
        """Deletes the folders that no current version names; readers of older versions must be done. Returns how many."""
        used = {f.split("/__bucket=")[0] for f in self._folders("").values()}
        old = {r.folder.split("/__bucket=")[0] for r in self._named().filter(F.col("folder").startswith("data/")).select("folder").distinct().collect()}
        for folder in sorted(old - used):
            self._fs.delete(self._path(folder), True)
        return len(old - used)

    # Pending operations

    def operations(self) -> DataFrame:
        return self.read("operations", OPERATIONS)

    def enqueue(self, operations: DataFrame) -> None:
        """Adds operations; of those with a known op_id the first stays."""
        base, held = self.version(), self.operations()
        new = _picked(operations, "op_id", F.min_by).join(held.select("op_id"), "op_id", "left_anti")
        self.replace("operations", held.unionByName(new.select(held.columns)), base=base)

    def set_status(self, updates: DataFrame) -> None:
        """updates(op_id, new_status, new_error); unknown ids change nothing."""
        base, ops = self.version(), self.operations()
        joined = ops.join(_picked(updates, "op_id", F.max_by), "op_id", "left")
        changed = joined.withColumns({"error": F.when(F.col("new_status").isNotNull(), F.col("new_error")).otherwise(F.col("error")), "status": F.coalesce("new_status", "status")})
        self.replace("operations", changed.select(ops.columns), base=base)

    def drop_operations(self, op_ids: DataFrame) -> None:
        base = self.version()
        self.replace("operations", self.operations().join(op_ids.select("op_id"), "op_id", "left_anti"), base=base)

    def apply_changes(self, table: TableDef, changes: DataFrame, expected_epoch: int | None = None) -> bool:
        """Folds changes into the canonical rows and drops the operations that they confirm, in one step; a writer of an
        older epoch changes nothing."""
        base, own = self.version(), changes.filter(F.col("table") == table.name)
        return self.replace_all({"operations": confirmed(self.operations(), own)}, expected_epoch, lambda: self._fold(table, own), base)

    # Log and ledger

    def log(self) -> DataFrame:
        return self.parts("log", CHANGES)

    def ledger(self) -> DataFrame:
        return self.parts("ledger", LEDGER)

    def known(self) -> Known:
        """What numbering needs to know, from state that each commit adds to: no change is read for it."""
        newest = F.max_by(F.col("scope_key"), F.col("version"))
        heads = self.parts("heads", "scope_key string, last bigint").groupBy("scope_key").agg(F.max("last").alias("last"))
        rows = self.parts("rows", "`table` string, id string, version bigint, scope_key string")
        return Known(heads, rows.groupBy("table", "id").agg(F.max("version").alias("version"), newest.alias("scope_key")))

    def committed(self, batch: str) -> bool:
        """Whether a push, or any other step, of that name is done."""
        return bool(self._named().filter(F.col("name") == f"batch/{batch}").limit(1).count())

    def mark(self, batch: str) -> None:
        """Notes that a step of that name is done."""
        self._name([(f"batch/{batch}", "done", self.epoch())], self.version())

    def feed(self, table: TableDef, batch: str | None = None) -> DataFrame:
        """What accepted pushes, or that of one batch, wrote (see push.written), each write once."""
        row = f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in table.shape.fields)}>"
        shape = f"change_id string, id string, scope_key string, op_id string, user_id string, function_name string, kind string, before {row}, after {row}"
        if batch is None:
            return self.parts(f"feed/{table.name}", shape)
        return self.read(f"feed/{table.name}#{batch}", shape)

    def commit(self, table: TableDef, made: Push, expected_epoch: int | None = None, base: int | None = None, batch: str | None = None) -> bool:
        """Log, ledger, numbering, the feed of writes and the rows of a push, in one step that adds parts and rewrites no old
        one. base: the version that the push was made from; if another push was committed since, this is a Conflict.
        batch: a name for the push; a push of a name that was committed before is left alone (False)."""
        base = self.version() if base is None else base
        if batch is not None and self.committed(batch):
            return False
        twice = made.ledger.join(self.ledger().select("user_id", "op_id"), ["user_id", "op_id"], "left_semi").limit(1).collect()
        if twice:
            raise Conflict(f"operation {twice[0].op_id!r} is in the ledger already")
        part, new = batch or uuid.uuid4().hex, Known.of(made.changes)
        tables = {f"log#{part}": made.changes, f"ledger#{part}": made.ledger, f"heads#{part}": new.heads, f"rows#{part}": new.rows, f"feed/{table.name}#{part}": written(table, self.canonical(table), made)}
        marks = [(_HEAD, ""), *([(f"batch/{batch}", "done")] if batch is not None else [])]
        done = self.replace_all(tables, expected_epoch, lambda: [*self._fold(table, made.changes), *marks], base)
        if done:
            self._fold_parts("heads", "scope_key string, last bigint", lambda x: x.groupBy("scope_key").agg(F.max("last").alias("last")))
            self._fold_parts("rows", "`table` string, id string, version bigint, scope_key string", lambda x: x.groupBy("table", "id").agg(F.max("version").alias("version"), F.max_by("scope_key", "version").alias("scope_key")))
        return done

    def prune(self, horizon: float) -> int:
        """Drops changes older than the horizon: parts that hold nothing newer go, but for the newest change of each scope.
        Returns how many parts went. Versions and numbering are kept apart and stay."""
        base, held = self.version(), self._folders("log#")
        if not held:
            return 0
        rows = self.log().withColumn("__folder", F.regexp_extract(F.col("_metadata.file_path"), "(data/log/.+)/[^/]+$", 1))
        old = [r.f for r in rows.groupBy(F.col("__folder").alias("f")).agg(F.max("server_time").alias("t")).filter(F.col("t") < horizon).collect()]  # a row for each part
        if not old:
            return 0
        newest = self.known().heads
        aged = self._rows(old, CHANGES)
        stay = aged.join(newest, "scope_key").filter(F.col("change_id").cast("bigint") == F.col("last")).drop("last")
        past = set(old)
        gone = [(n, "") for n, f in held.items() if f in past]
        self.replace_all({f"log#{uuid.uuid4().hex}": stay.select(*aged.columns)}, None, lambda: [*gone, (_HEAD, "")], base)
        return len(gone)

    def live(self, table: TableDef) -> DataFrame:
        return derive_view(table, self.canonical(table), self.operations().filter(F.col("table") == table.name))

    def remove_scope_rows(self, table: TableDef, column: str, value, keep: DataFrame) -> None:
        """Drops the rows of a scope that are not in keep(_id)."""
        base = self.version()
        self.replace_all({}, None, lambda: self._stage(table, keep_except_ghosts(self.canonical(table), column, value, keep), list(range(self.buckets))), base)

    # Cursors, roles and blobs

    def cursors(self) -> DataFrame:
        return self.read("cursors", "scope_key string, cursor string")

    def advance(self, cursors: DataFrame) -> None:
        """Cursors only move forward."""
        base = self.version()
        self.replace("cursors", self.cursors().union(cursors.select("scope_key", "cursor")).groupBy("scope_key").agg(F.max("cursor").alias("cursor")), base=base)

    def forget_cursors(self, scopes: DataFrame) -> None:
        base = self.version()
        self.replace("cursors", self.cursors().join(scopes.select("scope_key"), "scope_key", "left_anti"), base=base)

    def roles(self) -> DataFrame:
        return self.read("roles", "scope_key string, role int")

    def set_roles(self, roles: DataFrame) -> None:
        base = self.version()
        rest = self.roles().join(roles.select("scope_key"), "scope_key", "left_anti")
        self.replace("roles", rest.union(roles.select("scope_key", "role")), base=base)

    def remove_roles(self, scopes: DataFrame) -> None:
        base = self.version()
        self.replace("roles", self.roles().join(scopes.select("scope_key"), "scope_key", "left_anti"), base=base)

    def blobs(self) -> DataFrame:
        return self.read("blobs", "id string, storage_id string, data binary")

    def put_blobs(self, blobs: DataFrame) -> None:
        """Adds blobs by id; one that is there stays as it is."""
        base, held = self.version(), self.blobs()
        new = _picked(blobs, "id", F.min_by).join(held.select("id"), "id", "left_anti")
        self.replace("blobs", held.unionByName(new.select("id", "storage_id", "data")), base=base)

    def finalize_blobs(self, uploaded: DataFrame) -> None:
        """uploaded(id, storage_id): where blobs now lie. One that has its place keeps it, so a repeated call changes nothing."""
        base, blobs = self.version(), self.blobs()
        joined = blobs.join(_picked(uploaded.select("id", F.col("storage_id").alias("__s")), "id", F.min_by), "id", "left")
        self.replace("blobs", joined.withColumn("storage_id", F.coalesce("storage_id", "__s")).select(blobs.columns), base=base)
