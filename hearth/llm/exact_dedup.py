"""Exact duplicates by Patricia-trie owners.

Every map task inserts its whole texts into a compressed radix trie and
keeps one row per distinct text (largest or smallest id, count, the text); the
ids of its rows leave the task at once, so a group of copies takes one terminal
node's room. A group of copies of any size crosses the shuffle once per task. Rows
are dealt by (byte length, content hash) into partitions, where a second
trie over the full byte strings joins the tasks' rows; its terminal nodes
hold the owner of the text. Each document then looks its own task's row up
(a join key has at most one task's rows), which carries owner and size.

A trie over its byte budget spills whole subtrees: the heaviest child of
the root is written to a temporary file as (suffix, payload) records, later
strings of that branch follow them, and the branch is built alone at the end.

Cases: null text counts as empty and empty texts are copies of each other;
rows repeated with one id count as rows; a null id owns a text only if all
its copies have null ids. Only ``id_col`` and ``text_col`` are read, so other
columns (whatever their names) do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, partitions, store


class PatriciaTrie:
    """Compressed radix trie from byte strings to payloads merged by ``merge``.

    A node is [edge label, children by first byte, payload or None]; the
    labels on the way to a node spell its string. ``merge(a, b)`` adds b to a in
    place. ``insert`` returns the string's payload, or None if its branch is
    spilled. ``items`` yields every string once, resident branches first, then
    the spilled ones.
    """

    PAYLOAD_BYTES = 200

    def __init__(self, merge: Callable, budget: int = 64 << 20):
        self.merge, self.budget = merge, budget
        self.root: list = [b"", {}, None]
        self.size: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def _merged(self, node: list, payload):
        if node[2] is None:
            node[2] = payload
        else:
            self.merge(node[2], payload)
        return node[2]

    def insert(self, s: bytes, payload):
        if not s:
            return self._merged(self.root, payload)
        first = s[0]
        if first in self.spilled:
            pickle.dump((s, payload), self.spilled[first])
            return None
        added, got = self._put(s, payload)
        if got is payload:
            self.size[first] = self.size.get(first, 0) + added + self.PAYLOAD_BYTES
            if sum(self.size.values()) > self.budget:
                self._spill()
                if first in self.spilled:
                    return None
        return got

    def _put(self, s: bytes, payload) -> tuple[int, list]:
        """Insert below the root; returns the bytes of labels added and the string's payload."""
        node, at = self.root, 0
        while True:
            child = node[1].get(s[at])
            if child is None:
                node[1][s[at]] = [s[at:], {}, payload]
                return len(s) - at, payload
            label = child[0]
            if s.startswith(label, at):
                node, at = child, at + len(label)
                if at == len(s):
                    return 0, self._merged(child, payload)
                continue
            lo, hi = 1, min(len(label), len(s) - at)      # longest common prefix, by halves
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if s.startswith(label[:mid], at) else (lo, mid - 1)
            if not s.startswith(label[:lo], at):
                lo -= 1
            upper = [label[:lo], {label[lo]: [label[lo:], child[1], child[2]]}, None]
            node[1][s[at]] = upper
            if at + lo == len(s):
                upper[2] = payload
                return 0, payload
            upper[1][s[at + lo]] = [s[at + lo:], {}, payload]
            return len(s) - at - lo, payload

    def _spill(self) -> None:
        first = max(self.size, key=self.size.get)
        out = self.spilled[first] = tempfile.TemporaryFile()
        self.size.pop(first)
        for s, payload in self._walk(self.root[1].pop(first), b""):
            pickle.dump((s, payload), out)

    @staticmethod
    def _walk(node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        todo = [(node, prefix)]
        while todo:
            (label, children, payload), above = todo.pop()
            here = above + label
            if payload is not None:
                yield here, payload
            todo += [(child, here) for child in children.values()]

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._walk(self.root, b"")
        self.root = [b"", {}, None]
        for first, file in self.spilled.items():
            prefix = None                     # what all strings of the branch share: no level of depth for it
            for s, _ in self._records(file):
                prefix = s if prefix is None else os.path.commonprefix([prefix, s])
            part = PatriciaTrie(self.merge, self.budget)
            for s, payload in self._records(file):
                part.insert(s[len(prefix):], payload)
            file.close()
            for s, payload in part.items():
                yield prefix + s, payload

    @staticmethod
    def _records(file) -> Iterator[tuple[bytes, object]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _better(a, b, keep: str):
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if keep == "max" else min(a, b)


LOCAL = "doc_id long, rep long, keep long, n long, n_bytes long, hash long, text binary"
FLUSH = 4 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable) -> Iterator[pa.RecordBatch]:
    block, weight = [], 0
    for row in rows:
        block.append(row)
        weight += weigh(row)
        if weight > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block, weight = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def _local_pass(keep: str, budget: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("keep", pa.int64()), ("n", pa.int64()),
                        ("n_bytes", pa.int64()), ("hash", pa.int64()), ("text", pa.binary())])

    def merge(a, b):
        # [number that names the text in this task, best id, rows, ids still to be given their number]
        a[0] = b[0] if a[0] is None else a[0]
        a[1], a[2] = _better(a[1], b[1], keep), a[2] + b[2]
        a[3] += b[3]

    def run(batches):
        trie = PatriciaTrie(merge, budget)

        def flat():
            numbers = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    got = trie.insert(text, [None, doc_id, 1, [doc_id]])
                    if got is None:
                        continue                     # its branch is spilled: numbered at the end
                    if got[0] is None:
                        got[0], numbers = numbers, numbers + 1
                    got[3] = []
                    yield doc_id, got[0], None, None, None, None, None
            for text, (number, best, n, ids) in trie.items():
                if number is None:
                    number, numbers = numbers, numbers + 1
                for doc_id in ids:
                    yield doc_id, number, None, None, None, None, None
                digest = hashlib.blake2b(text, digest_size=8).digest()
                yield None, number, best, n, len(text), int.from_bytes(digest, "little", signed=True), text

        yield from _batches(flat(), schema, lambda r: 64 + len(r[6] or b""))

    return run


def _owner_pass(keep: str, budget: int):
    schema = pa.schema([("task", pa.int64()), ("rep", pa.int64()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def merge(a, b):
        a[0] += b[0]
        a[1], a[2] = a[1] + b[1], _better(a[2], b[2], keep)

    def run(batches):
        trie = PatriciaTrie(merge, budget)

        def rows():
            for batch in batches:
                task, rep, best, n, text = (batch.column(i).to_pylist() for i in range(5))
                for t, r, k, m, s in zip(task, rep, best, n, text):
                    trie.insert(s, [[(t, r)], m, k])
            for text, (reps, size, owner) in trie.items():
                sha = hashlib.sha256(text).hexdigest()
                for t, r in reps:
                    yield t, r, owner, size, sha

        yield from _batches(rows(), schema, lambda r: 120)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                     trie_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, text_sha256.

    ``keep``: "min" or "max", the id that owns a text. ``trie_bytes``: label
    bytes a task holds before it spills subtrees.
    """
    spark = docs.sparkSession
    local = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
                .mapInArrow(_local_pass(keep, trie_bytes), LOCAL)
    local = store(local.withColumn("task", F.spark_partition_id().cast("long")), "dedup-local",
                  compression="zstd")
    reps = local.where("n is not null").select("task", "rep", "keep", "n", "text", "n_bytes", "hash")
    owners = reps.repartition(partitions(spark), "n_bytes", "hash").drop("n_bytes", "hash") \
                 .mapInArrow(_owner_pass(keep, trie_bytes),
                             "task long, rep long, keep_id long, group_size long, text_sha256 string")
    members = local.where("n is null").select("doc_id", "task", "rep")
    return members.join(owners, ["task", "rep"]).select("doc_id", "keep_id", "group_size", "text_sha256")


def op5(spark, sf_dir: str) -> DataFrame:
    """Exact copies of whole texts; the largest doc_id of a group stays."""
    from .common import documents
    out = exact_duplicates(documents(spark, sf_dir), keep="max")
    return out.select("doc_id", "keep_id", "group_size",
                      F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


ORACLE_OP5 = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
