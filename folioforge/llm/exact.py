"""Exact duplicates by Patricia-trie owners.

Each task first inserts its own rows into compressed radix tries, so that a text repeated a million times leaves a
task once; these local owners are dealt by content hash and length, and the tries of that partition decide over the
whole strings.  A terminal node holds the row that stays and the number of rows.  Where a task's tries outgrow their
budget, the heaviest subtree moves to a file of that task and is finished on its own afterwards.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import shuffle_buckets, written

MEMORY = 96 << 20
SUBTREES = 64
_ENTRY = struct.Struct("<I?qqqq")  # key length, has an id, best id, best row, rows, owner


def common_length(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of b equal a from `at` on."""
    lo, hi = 0, min(len(b), len(a) - at)
    if a[at : at + hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[at + lo : at + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    __slots__ = ("label", "children", "owners", "best", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.owners, self.best, self.rows = label, None, None, None, 0


class RadixTrie:
    """A compressed trie over byte strings of which none is the beginning of another."""

    def __init__(self):
        self.root, self.size = Node(b""), 0
        self.root.children = {}

    def terminal(self, key: bytes) -> tuple[Node, bool]:
        """The node where key ends, and whether it is new."""
        node, at = self.root, 0
        while True:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(key) - at + 200
                return child, True
            same = common_length(key, at, child.label)
            at += same
            if same < len(child.label):
                fork = Node(child.label[:same])
                fork.children = {child.label[same]: child}
                node.children[fork.label[0]] = fork
                child.label = child.label[same:]
                node = fork
                self.size += 200
            elif child.children is None:
                return child, False
            else:
                node = child

    def leaves(self) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.children is None:
                yield prefix + node.label, node
            else:
                stack.extend((prefix + node.label, x) for x in node.children.values())


def better(a: tuple, b: tuple, largest: bool) -> bool:
    """Whether row a (id or None, row number) stays rather than b: by id, then the row met first."""
    if a[0] is None or b[0] is None:
        return a[0] is not None if (a[0] is None) != (b[0] is None) else a[1] < b[1]
    return a[1] < b[1] if a[0] == b[0] else (a[0] > b[0]) == largest


class Owners:
    """Tries over keys hash(8) length(8) text, one subtree for each value of the hash's `SUBTREES` leading steps."""

    def __init__(self, largest: bool, memory: int = MEMORY, depth: int = 0, folder: str | None = None):
        self.largest, self.memory, self.depth = largest, memory, depth
        self.folder = folder
        self.tries: dict[int, RadixTrie] = {}
        self.files: dict[int, object] = {}

    def subtree(self, key: bytes) -> int:
        return (int.from_bytes(key[:8], "big") >> (6 * self.depth)) % SUBTREES

    @property
    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def add(self, key: bytes, best: tuple, rows: int, owner: int) -> tuple[int, bool]:
        """The first owner of this key here, and whether the key is new; a spilled key counts as new."""
        at = self.subtree(key)
        if at in self.files:
            self.keep(at, key, best, rows, owner)
            return owner, True
        trie = self.tries.get(at) or self.tries.setdefault(at, RadixTrie())
        node, new = trie.terminal(key)
        if new:
            node.owners, node.best, node.rows = [owner], best, rows
        else:
            node.rows += rows
            if better(best, node.best, self.largest):
                node.best = best
            if self.folder is not None:
                node.owners.append(owner)
                trie.size += 16
        if new and self.folder is not None and self.depth < 9 and self.size > self.memory:
            self.spill()
        return node.owners[0], new

    def keep(self, at: int, key: bytes, best: tuple, rows: int, owner: int) -> None:
        self.files[at].write(_ENTRY.pack(len(key), best[0] is not None, best[0] or 0, best[1], rows, owner) + key)

    def spill(self) -> None:
        at = max(self.tries, key=lambda k: self.tries[k].size)
        self.files[at] = tempfile.TemporaryFile(dir=self.folder)
        for key, node in self.tries.pop(at).leaves():
            for k, owner in enumerate(node.owners):
                self.keep(at, key, node.best, 0 if k else node.rows, owner)

    def finished(self) -> Iterator[tuple[bytes, Node]]:
        while self.tries:
            yield from self.tries.popitem()[1].leaves()
        while self.files:
            file = self.files.popitem()[1]
            inner = Owners(self.largest, self.memory, self.depth + 1, self.folder)
            file.seek(0)
            while head := file.read(_ENTRY.size):
                n, known, best, row, rows, owner = _ENTRY.unpack(head)
                inner.add(file.read(n), (best if known else None, row), rows, owner)
            file.close()
            yield from inner.finished()


LOCAL = "owner long, best_id long, best_row long, rows long, size long, hash long, body binary"
RESULT = "owner long, keep_id long, keep_row long, group_size long, text_sha256 string"


def _local_owners(largest: bool, memory: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 36, 0
        tries = Owners(largest)

        def entries() -> pa.RecordBatch:
            rows = [(node.owners[0], node.best[0], node.best[1], node.rows, len(key) - 16, int.from_bytes(key[:8], "big", signed=True), key[16:]) for key, node in tries.finished()]
            columns = [pa.nulls(len(rows), schema.field(0).type), pa.nulls(len(rows), pa.int64())]
            columns += [pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(7)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        held = 0
        for batch in batches:
            owners = []
            ids, sizes, hashes, bodies = (batch.column(k) for k in ("id", "size", "hash", "body"))
            for k in range(batch.num_rows):
                body = bodies[k].as_py()
                key = struct.pack(">qq", hashes[k].as_py(), len(body)) + body
                owner, new = tries.add(key, (ids[k].as_py(), base + n + k), 1, base + n + k)
                owners.append(owner)
                held += len(key) + 200 if new else 0
            rows = pa.array(range(base + n, base + n + batch.num_rows), pa.int64())
            n += batch.num_rows
            empty = [pa.nulls(batch.num_rows, schema.field(k + 2).type) for k in range(1, 7)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), rows, pa.array(owners, pa.int64()), *empty], names=schema.names)
            if held > memory:
                yield entries()
                tries, held = Owners(largest), 0
        yield entries()

    return run


def _owners(largest: bool, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Owners(largest, memory, 0, os.environ.get("TMPDIR") or tempfile.gettempdir())
        for batch in batches:
            columns = [batch.column(k) for k in ("owner", "best_id", "best_row", "rows", "hash", "body")]
            for k in range(batch.num_rows):
                owner, best_id, best_row, rows, hashed, body = (c[k].as_py() for c in columns)
                tries.add(struct.pack(">qq", hashed, len(body)) + body, (best_id, best_row), rows, owner)
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate([*[pa.int64()] * 4, pa.string()])], names=["owner", "keep_id", "keep_row", "group_size", "text_sha256"])

        for key, node in tries.finished():
            sha = hashlib.sha256(key[16:]).hexdigest()
            out.extend((owner, *node.best, node.rows, sha) for owner in node.owners)
            if len(out) >= 10_000:
                yield made()
                out = []
        yield made()

    return run


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", normalise=None, carry: list[str] | None = None, memory: int = MEMORY) -> DataFrame:
    """One row per row of docs: struct `row` (the columns in carry, by default the id), keep_id, group_size, kept,
    text_sha256.

    keep: whether the `smallest` or `largest` id of equal texts stays.  Of rows with the same id and text, one stays.
    A null text equals the empty one; a null id stays only where its group has no other.  normalise maps the text's
    Column to what is compared.  Columns of any name may be present: carried ones live in the struct.
    """
    text: Column = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or [id_column])]).alias("row")
    rows = docs.select(row, F.col(id_column).cast("long").alias("id"), body.alias("body")).select("row", "id", "body", F.length("body").cast("long").alias("size"), F.xxhash64("body").alias("hash"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("row_no", T.LongType()), *T._parse_datatype_string(LOCAL).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    largest = {"smallest": False, "largest": True}[keep]
    local = written(rows.mapInArrow(_local_owners(largest, memory, to_arrow_schema(schema)), schema), "owners")
    entries = local.where("row_no is null").select(*[f.name for f in T._parse_datatype_string(LOCAL).fields])
    owners = entries.repartition(shuffle_buckets(docs.sparkSession), "size", "hash").mapInArrow(_owners(largest, memory), RESULT)
    return local.where("row_no is not null").select("row", "row_no", "owner").join(owners, "owner").select("row", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256")


def _local_rows(largest: bool, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, held, rows, texts = Owners(largest), 0, [], []

        def entries() -> pa.RecordBatch:
            found = [(node.best[1], *struct.unpack(">qq", key[:16]), key[16:]) for key, node in tries.finished()]
            kept = pa.array([f[0] for f in found], pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows).take(kept), pa.concat_arrays(texts).take(kept), *(pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary())))], names=["row", "none", "hash", "size", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            base = sum(len(r) for r in rows)
            rows.append(batch.column("row"))
            texts.append(batch.column("none"))
            ids, sizes, hashes, bodies = (batch.column(k) for k in ("id", "size", "hash", "body"))
            for k in range(batch.num_rows):
                key = struct.pack(">qq", hashes[k].as_py(), sizes[k].as_py()) + bodies[k].as_py()
                _, new = tries.add(key, (ids[k].as_py(), base + k), 1, base + k)
                held += 100 + (len(key) + 200 if new else 0)
            if held > memory:
                yield entries()
                tries, held, rows, texts = Owners(largest), 0, [], []
        if rows:
            yield entries()

    return run


def _kept_rows(largest: bool, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, rows, texts, n = Owners(largest, memory, 0, os.environ.get("TMPDIR") or tempfile.gettempdir()), [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows.append(batch.column("row"))
            texts.append(batch.column("none"))
            known, hashes, bodies = batch.column("id"), batch.column("hash"), batch.column("body")
            for k in range(batch.num_rows):
                body = bodies[k].as_py()
                tries.add(struct.pack(">qq", hashes[k].as_py(), len(body)) + body, (known[k].as_py(), n + k), 1, n + k)
            n += batch.num_rows
        if not rows:
            return
        rows, texts = pa.concat_arrays(rows), pa.concat_arrays(texts)
        out, held = [], 0

        def made() -> pa.RecordBatch:
            kept = pa.array([k for k, _ in out], pa.int64())
            none = texts.take(kept).to_pylist()
            return pa.RecordBatch.from_arrays([rows.take(kept), pa.array([None if no else body.decode() for no, (_, body) in zip(none, out, strict=True)], pa.string())], names=["row", "body"])

        for key, node in tries.finished():
            out.append((node.best[1], key[16:]))
            held += len(key)
            if held > 8 << 20:
                yield made()
                out, held = [], 0
        yield made()

    return run


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", memory: int = MEMORY) -> DataFrame:
    """The rows of docs that stay, all their columns unchanged; the rules are those of exact_duplicates.

    A text leaves a task once, with the other columns of the best row there, and the tries over whole texts give back
    the rows that stay: each text is dealt once and nothing is written or joined.  Of rows with the same id and text any one stays.
    """
    others = [c for c in docs.columns if c != text_column]
    text = F.col(f"`{text_column}`").cast("string")
    row = F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("nothing")])).alias("row")
    rows = docs.select(row, text.isNull().alias("none"), F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"size": F.length("body").cast("long"), "hash": F.xxhash64("body")})
    largest = {"smallest": False, "largest": True}[keep]
    kind = rows.schema["row"]
    local = T.StructType([kind, *T._parse_datatype_string("none boolean, hash long, size long, body binary").fields])
    entries = rows.mapInArrow(_local_rows(largest, memory), local).withColumn("id", F.col(f"row.`{id_column}`").cast("long"))
    stays = entries.repartition(shuffle_buckets(docs.sparkSession), "size", "hash").mapInArrow(_kept_rows(largest, memory), T.StructType([kind, T.StructField("body", T.StringType())]))
    return stays.select(*[F.col("body").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
