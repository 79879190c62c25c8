"""A trie of conversations by their first turns, built compressed.

Distinct conversations are sorted, and each task streams through a range of them with the open points of a Patricia trie as its
state: branches, ends and leaves, each with the sums of its subtree so far.  When a point closes, its sums are final, and the
nodes along the edge above it, which have one child each, follow from running sums over the edge.

Ranges begin with conversations of a sample.  Only nodes on those conversations' own paths can have members in several
ranges; their sums are partial, and are added up.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .textcore import releasing

#: Conversations that share their opening, and the most turns they share, and one more.
FAMILY, SHARED = 5, 9
#: Ids that a task gathers before it hands them on, and conversations sampled for each range.
GATHERED, SAMPLED = 50_000, 20
KEY = 16
_NO_IDS = hashlib.sha256(b"").hexdigest()

NODE = "key binary, parent binary, depth long, spine boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, tokens long, distinct_tokens long, ends string"
_KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.string()]


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(seq, path, sizes, n, conv_id, ends): one row for each distinct rebuilt conversation.

    path is the chain of its turns' digests, KEY bytes each, of which the d-th names the first d turns; seq the last of them; sizes are the texts'
    bytes; n and conv_id count its conversations and name the least, ends is the digest of all their ids.

    Turns are dealt by ranges of families and sorted, and tasks stream through them; a conversation is held as digests.  Equal ones are
    gathered in each task before they meet, so that a hot one is a few rows."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    dealt = turns.withColumn("family", F.expr(f"c - pmod(c, {FAMILY})")).repartitionByRange(parts, "family").sortWithinPartitions("family", "c", "turn", "digest").select("c", "digest", "size")
    schema = "seq binary, first_id long, n long, ids string, path binary, sizes binary"
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    @releasing
    def rebuild(batches):
        held: dict[bytes, list] = {}
        opening: tuple[int | None, list] = (None, [])
        now, own, gathered = None, [], 0

        def close():
            nonlocal opening
            if now % FAMILY == 0:
                opening = (now, own[: SHARED - 1])
            h = zlib.crc32(str(now).encode()) % SHARED
            turns = [*(opening[1][:h] if opening[0] == now - now % FAMILY else []), *own[h:]]
            chain, last = [], b""
            for digest, _ in turns:
                last = hashlib.md5(last + digest).digest()
                chain.append(last)
            if last not in held:
                held[last] = [now, [], b"".join(chain), np.array([s for _, s in turns], "<i8").tobytes()]
            held[last][1].append(str(now))
            return 1 + 2 * len(turns)

        def out():
            batch = _batch([(k, first, len(ids), ",".join(ids), path, sizes) for k, (first, ids, path, sizes) in held.items()], schema, kinds)
            held.clear()
            return batch

        for batch in batches:
            for c, digest, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != now and now is not None:
                    gathered += close()
                    own = []
                    if gathered > GATHERED:
                        yield out()
                        gathered = 0
                now = c
                own.append((digest, size))
        if now is not None:
            close()
        yield out()

    @releasing
    def gather(batches):
        held = None  # seq, first id, n, path, sizes, hash of the ids so far
        for batch in batches:
            done = []
            for seq, first, n, ids, path, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0] == seq:
                    held[2] += n
                    held[5].update(f",{ids}".encode())
                    continue
                if held:
                    done.append(held)
                held = [seq, first, n, path, sizes, hashlib.sha256(ids.encode())]
            yield final(done)
        yield final([held] if held else [])

    def final(rows):
        return _batch([(seq, path, sizes, n, first, ids.hexdigest()) for seq, first, n, path, sizes, ids in rows], distinct, [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()])

    distinct = "seq binary, path binary, sizes binary, n long, conv_id long, ends string"
    return dealt.mapInArrow(rebuild, schema).repartition(parts, "seq").sortWithinPartitions("seq", "first_id").mapInArrow(gather, distinct)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share.  A digest stands for all turns before it, so equality is monotone."""
    lo, hi = 0, min(len(a), len(b)) // KEY
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[(mid - 1) * KEY : mid * KEY] == b[(mid - 1) * KEY : mid * KEY] else (lo, mid - 1)
    return lo


def _key(path: bytes, depth: int) -> bytes:
    return path[(depth - 1) * KEY : depth * KEY] if depth else b""


class Point:
    """An open point of the compressed trie, and the sums of its subtree below it."""

    __slots__ = ("depth", "n", "conv", "children", "leaves", "tokens", "distinct", "ends", "inner")

    def __init__(self, depth: int, n: int = 0, conv: int | None = None, ends: str | None = None):
        self.depth, self.n, self.conv, self.ends = depth, n, conv, ends
        self.children = self.leaves = self.tokens = self.distinct = 0
        self.inner = False


class Range:
    """The trie of the conversations in one range, fed in order; `lower` and `upper` are the paths that begin this range and the next."""

    def __init__(self, lower: bytes, upper: bytes):
        self.bounds = (lower, upper)
        self.path, self.sums = b"", [0]
        self.open = [Point(0)]
        self.rows: list[tuple] = []

    def _close(self, above: int) -> None:
        """The deepest point, and the nodes on its edge down from `above`, are finished."""
        p = self.open.pop()
        shared = [_shared(self.path, b) for b in self.bounds]
        spine = max(shared)
        if not p.inner and not any(s >= p.depth and p.depth * KEY < len(b) for s, b in zip(shared, self.bounds, strict=True)):
            p.leaves = 1
        children, ends, tokens, distinct = p.children, p.ends, p.tokens, p.distinct
        for d in range(p.depth, above, -1):
            size = self.sums[d] - self.sums[d - 1]
            tokens += p.n * size
            distinct += size if d > spine else 0
            apart = d - 1 == above or d - 1 <= spine
            self.rows.append((_key(self.path, d), _key(self.path, d - 1) if apart else None, d, d <= spine, p.conv, None if apart else p.conv, p.n, children, p.leaves, tokens, distinct, ends))
            children, ends = int(d > spine), None
        if self.open[-1].depth < above:
            self.open.append(Point(above))
        up = self.open[-1]
        up.inner = True
        up.n += p.n
        up.conv = p.conv if up.conv is None else min(up.conv, p.conv)
        up.children += children
        up.leaves += p.leaves
        up.tokens += tokens
        up.distinct += distinct

    def add(self, path: bytes, sizes: np.ndarray, n: int, conv: int, ends: str) -> None:
        shared = _shared(self.path, path)
        while self.open[-1].depth > shared:
            self._close(max(self.open[-2].depth, shared))
        self.path = path
        self.sums = [*self.sums[:shared], *accumulate(sizes[shared:].tolist(), initial=self.sums[shared])]
        if not path:
            root = self.open[0]
            root.n, root.conv, root.ends = n, conv, ends
        else:
            self.open.append(Point(len(path) // KEY, n, conv, ends))

    def finish(self) -> None:
        while len(self.open) > 1:
            self._close(self.open[-2].depth)
        root = self.open[0]
        alone = not root.inner and not any(self.bounds)
        self.rows.append((b"", None, 0, True, root.conv, None, root.n, root.children, root.leaves + alone, root.tokens, root.distinct, root.ends))


def _own(path: bytes, sizes: np.ndarray, before: bytes) -> list[tuple]:
    """What the nodes on the path of a range's beginning count once for all ranges: their own texts, and each other as children; those that
    the beginning of the range before shares are counted there."""
    from_, depth = _shared(before, path), len(path) // KEY
    out, total = [], 0
    for d in range(depth, -1, -1):
        if d > from_:
            total += int(sizes[d - 1])
        out.append((_key(path, d), _key(path, d - 1) if d else None, d, True, None, None, 0, int(from_ < d + 1 <= depth), 0, 0, total, None))
    return out


def build_trie(distinct: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """Nodes (see NODE) of all distinct conversations of `rebuilt`, as a written table."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = distinct.where("n > 0 and length(path) > 0").orderBy(F.xxhash64("seq"), "seq").limit(sampled * parts).select("path", "sizes").collect()
    sample = sorted((bytes(r.path), bytes(r.sizes)) for r in sample)
    step = max(1, len(sample) // parts)
    bounds = sample[step::step][: parts - 1]
    begins = [p for p, _ in bounds]

    @F.pandas_udf("int")
    def place(paths):
        import pandas as pd

        return pd.Series([bisect_right(begins, p) for p in paths], dtype="int32")

    dealt = distinct.withColumn("range", place("path")).repartitionById(len(begins) + 1, F.col("range")).sortWithinPartitions("range", "path").select("range", "path", "sizes", "n", "conv_id", "ends")

    @releasing
    def run(batches):
        at, trie = None, None
        for batch in batches:
            for k, path, sizes, n, conv, ends in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != at:
                    if trie:
                        trie.finish()
                        yield _batch(trie.rows, NODE, _KINDS)
                    at, trie = k, Range(begins[k - 1] if k else b"", begins[k] if k < len(begins) else b"")
                    if k:
                        trie.rows += _own(begins[k - 1], np.frombuffer(bounds[k - 1][1], "<i8"), begins[k - 2] if k > 1 else b"")
                trie.add(path, np.frombuffer(sizes, "<i8"), n, conv, ends)
            if trie and len(trie.rows) > 10_000:
                yield _batch(trie.rows, NODE, _KINDS)
                trie.rows = []
        if trie:
            trie.finish()
            yield _batch(trie.rows, NODE, _KINDS)

    found = save(dealt.mapInArrow(run, NODE))
    sums = ("n_convs", "n_children", "n_leaves", "tokens", "distinct_tokens")
    merged = found.where("spine").groupBy("key", "parent", "depth", "spine").agg(F.min("conv_id").alias("conv_id"), F.first("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in sums), F.max("ends").alias("ends"))
    return save(found.where("not spine").unionByName(merged))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Null roles and texts count as empty; a null turn comes first, and turns with the same number follow in the order of their
    digests, so repeated rows are repeated turns; rows without a conv_id belong to no conversation and are left out; a family's opening
    is the conversation whose id is the next multiple of five below (for negative ids too); turnless conversations are members of the root
    only; texts of any length are hashed whole; an empty table has no nodes, not even the root; other columns are ignored."""
    nodes = build_trie(save(rebuilt(conversations)))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("_up"))
    # only the tops of edges look for their parents
    tops = nodes.where("parent is not null").join(above, "parent", "left").withColumn("parent_conv_id", F.col("_up"))
    rest = nodes.where("parent is null")
    plain: list[Column | str] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("tokens") - F.col("distinct_tokens")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_IDS)).alias("ends_sha256")]
    return tops.select(*plain).unionByName(rest.select(*plain))
