"""Near-duplicate embeddings by sorted projection passes.

In each pass a vector's key is the concatenation of 64 random hyperplane hashes.  Vectors are
range-partitioned and sorted by (pass, key), and each is compared with the `window` next ones,
also across the edges of partitions.  Verified pairs are united at once inside a
partition, so that a pass sends on one link per vector, not one per pair; the links of all passes are
united into components.

The first bits of a key, about one more for each doubling of the table, name a bucket.  There are as many passes as a
pair at the threshold needs to share a bucket in one of them but for a chance of MISS.  The window covers
ordinary buckets; in those with more vectors than it reaches, members of different components are
compared in blocks, so that the chance doesn't depend on how dense the data are.  What that costs
grows with the square of a crowded bucket's vectors outside its largest component.

Links are then counted without listing a component's pairs.  If two members' angles to the
component's mean vector add up to less than the threshold's angle, they are linked, so a member whose
angle and the largest one in the component do so is linked with all members.  Only members for
which this doesn't hold are compared with the others, in blocks of bounded size.

Equal vectors are one vector with a number of copies throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save

HASHES = 64
BLOCK = 512
#: Vectors in a block of a crowded bucket.
CROWD = 4096
#: Chance that a pair at the threshold shares no bucket.
MISS = 0.005
#: Margin for rounding when angles are added (radians).
SLACK = 1e-7


def _clean_rows(batches):
    """Unit vectors in double precision as bytes; null where a vector is null, zero, or not finite."""
    for batch in batches:
        vectors = batch.column("embedding")
        out = []
        for v in vectors:
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
                if np.isinf(norm):
                    x = x / np.abs(x).max()
                    norm = np.sqrt((x * x).sum())
                if norm == 0.0 and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    norm = np.sqrt((x * x).sum())
                x = (x / norm).tobytes() if norm > 0 else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _matrix(column) -> np.ndarray:
    """Vectors of one length from binary values."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _planes(dim: int, turn: int, seed: int) -> np.ndarray:
    return np.random.RandomState([seed, turn, dim]).standard_normal((dim, HASHES))


def _bucket_bits(n: int, window: int) -> int:
    """Bits of a bucket's name: buckets of n evenly spread vectors then hold about half a window."""
    return min(HASHES - 1, max(0, round(math.log2(max(n, 1) / max(window / 2, 1)))))


def _passes_needed(bits: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has shared a bucket but for a chance of MISS."""
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def _key_rows(passes: int, seed: int, with_vector: bool = True):
    """(node, v) -> a row for each pass with the 64 bits as a sortable long."""
    schema = pa.schema([("turn", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("node", pa.int64())] + [("v", pa.binary())] * with_vector)

    def rows(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.uint64(1) << np.arange(HASHES - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            raw = batch.column("v").to_pylist()
            dims = np.array([len(x) // 8 for x in raw])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix([raw[i] for i in at])
                rest = [batch.column(c).take(pa.array(at)) for c in ("node", "v")[: 1 + with_vector]]
                for turn in range(passes):
                    if (dim, turn) not in planes:
                        planes[dim, turn] = _planes(int(dim), turn, seed)
                    key = ((x @ planes[dim, turn] > 0) * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), turn, dtype=np.int32)), pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(key.view(np.int64)), *rest], schema=schema)

    return rows


def _unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n items' components under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _near(x: np.ndarray, window: int, threshold: float, cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j <= i + window, with cosine >= threshold; across position `cross` only, if given."""
    left, right = [], []
    for i in range(0, len(x), 512):
        rows, cols = x[i : i + 512], x[i + 1 : i + 512 + window]
        if not len(cols):
            continue
        gap = (i + 1 + np.arange(len(cols)))[None, :] - (i + np.arange(len(rows)))[:, None]
        hit = (rows @ cols.T >= threshold) & (gap >= 1) & (gap <= window)
        a, b = np.nonzero(hit)
        left.append(a + i)
        right.append(b + i + 1)
    a, b = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (left, right))
    if cross is not None:
        ok = (a < cross) & (b >= cross)
        a, b = a[ok], b[ok]
    return a, b


def _links(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = _unite(len(nodes), a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _window_rows(window: int, threshold: float):
    """Sorted (turn, dim, key, node, v) -> links within the partition, and its first and last rows of
    every turn, for the comparison across partitions (v is null in links)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("turn", pa.int32()), ("dim", pa.int32()), ("edge", pa.int32()), ("place", pa.int32()), ("v", pa.binary())])

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def run(turn, dim, nodes, raw, first, last):
            x = _matrix(raw)
            a, b = _links(nodes, *_near(x, window, threshold))
            none = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(none, turn, np.int32)), pa.array(np.full(none, dim, np.int32)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=schema)
            for edge, ids, use in ((part - 1, np.arange(min(window, len(nodes))), first), (part, np.arange(max(0, len(nodes) - window), len(nodes)), last)):
                if use:
                    place = ids if edge < part else ids - len(nodes)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[ids]), pa.array(nodes[ids]), pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, edge, np.int32)), pa.array(place.astype(np.int32)), pa.array([raw[i] for i in ids], pa.binary())], schema=schema)

        # runs of some thousand rows that overlap by a window
        nodes, raw, at, fresh = np.zeros(0, dtype=np.int64), [], None, True
        for batch in batches:
            turns, dims = batch.column("turn").to_numpy(), batch.column("dim").to_numpy()
            cuts = np.flatnonzero((turns[1:] != turns[:-1]) | (dims[1:] != dims[:-1])) + 1 if len(turns) else []
            for i, j in zip([0, *cuts], [*cuts, len(turns)], strict=True):
                if i == j:
                    continue
                if at != (turns[i], dims[i]):
                    if at is not None and raw:
                        yield from run(*at, nodes, raw, fresh, True)
                    nodes, raw, at, fresh = np.zeros(0, dtype=np.int64), [], (turns[i], dims[i]), True
                nodes = np.concatenate((nodes, batch.column("node").slice(i, j - i).to_numpy()))
                raw += batch.column("v").slice(i, j - i).to_pylist()
                if len(raw) > 8192 + window:
                    yield from run(*at, nodes, raw, fresh, False)
                    nodes, raw, fresh = nodes[-window:], raw[-window:], False
        if at is not None and raw:
            yield from run(*at, nodes, raw, fresh, True)

    return rows


def _edge_links(window: int, threshold: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        # last rows of one partition have negative places, first rows of the next follow
        pdf = pdf.sort_values("place")
        nodes = pdf.a.to_numpy()
        a, b = _links(nodes, *_near(_matrix([bytes(v) for v in pdf.v]), window, threshold, cross=int((pdf.place < 0).sum())))
        return pd.DataFrame({"a": a, "b": b})

    return links


def _crowd_links(threshold: float):
    """One pair of blocks of a crowded bucket: links across components, as pairs of components."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf.component.to_numpy(), return_inverse=True)
        side = pdf.side.to_numpy()
        x = _matrix([bytes(v) for v in pdf.v])
        one, two, right = at[side == 0], at[side == 1], x[side == 1]
        left, label = x[side == 0], np.arange(len(names))
        for i in range(0, len(left), BLOCK):
            a, b = np.nonzero(left[i : i + BLOCK] @ right.T >= threshold)
            a, b = one[i + a], two[b]
            across = a != b
            label = _unite(len(names), np.concatenate((np.arange(len(names)), a[across])), np.concatenate((label, b[across])))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})

    return links


def _crowded(nodes: DataFrame, known: DataFrame, passes: int, seed: int, bits: int, window: int, threshold: float) -> DataFrame | None:
    """Links between components that share a bucket of more vectors than a window reaches, as pairs of components; None
    if no such bucket holds several."""
    bucket = F.shiftright("key", HASHES - bits) if bits else F.lit(0).cast("long")
    keys = nodes.select("node", "v").mapInArrow(_key_rows(passes, seed, with_vector=False), "turn int, dim int, key long, node long").select("turn", "dim", bucket.alias("bucket"), "node")
    names = ["turn", "dim", "bucket"]
    large = save(keys.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > window + 1).select(*names))
    if large.isEmpty():
        return None
    members = save(keys.join(large, names).join(known, "node", "left").select(*names, "node", F.coalesce("component", "node").alias("component")))
    shares = members.groupBy(*names, "component").agg(F.count("*").alias("m"))
    sizes = save(shares.groupBy(*names).agg(F.max_by("component", "m").alias("main"), F.max("m").alias("main_size"), F.sum("m").alias("all_size"), F.count("*").alias("kinds")).where("kinds > 1"))
    if sizes.isEmpty():
        return None
    # blocks 1..few are outside the largest component, and are compared with each other and with its blocks
    blocks = lambda c: F.ceil(c / CROWD).cast("int")
    few, many = blocks(F.col("all_size") - F.col("main_size")), blocks(F.col("main_size"))
    own = F.when(F.col("component") == F.col("main"), F.lit(1) + few + F.pmod(F.xxhash64("node"), many)).otherwise(F.lit(1) + F.pmod(F.xxhash64("node"), few)).cast("int")
    placed = members.join(sizes, names).select(*names, "node", "component", own.alias("own"), few.alias("few"), (few + many).alias("blocks"))
    left = placed.where("own <= few").select(*names, "node", "component", F.col("own").alias("i"), F.explode(F.sequence("own", "blocks")).alias("j"), F.lit(0).alias("side"))
    right = placed.select(*names, "node", "component", F.explode(F.sequence(F.lit(1), F.least("own", "few"))).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    dealt = left.unionByName(right).join(nodes.select("node", "v"), "node")
    return save(dealt.groupBy(*names, "i", "j").applyInPandas(_crowd_links(threshold), "a long, b long").distinct())


def _angle_rows(batches):
    """(node, component, copies, v, mean) -> the angle between v and mean."""
    for batch in batches:
        out = []
        for v, m in zip(batch.column("v").to_pylist(), batch.column("mean"), strict=True):
            x, c = np.frombuffer(v, dtype=np.float64), m.values.to_numpy()
            norm = np.sqrt((c * c).sum())
            out.append(float(np.arccos(np.clip(x @ c / norm, -1, 1))) if norm > 0 else np.pi)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("node", "component", "copies", "v")), pa.array(out, pa.float64())], names=["node", "component", "copies", "v", "angle"])


def _block_counts(threshold: float):
    def counts(pdf: pd.DataFrame) -> pd.DataFrame:
        one, all_ = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(one) or not len(all_):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "found": np.zeros(0, np.int64)})
        hit = _matrix([bytes(v) for v in one.v]) @ _matrix([bytes(v) for v in all_.v]).T >= threshold
        hit &= one.node.to_numpy()[:, None] != all_.node.to_numpy()[None, :]
        return pd.DataFrame({"node": one.node.to_numpy(), "found": hit @ all_.copies.to_numpy()})

    return counts


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, passes: int = 12, window: int = 256, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Link vectors with cosine >= threshold: vec_id, n_links, component_id (least vec_id reachable), kept.

    All pairs that a pass brings within `window` places or into one bucket are found, and then all links among the members
    of a component are counted; no pair below the threshold is linked.  There are at least `passes` passes, and more as the
    table grows: a pair at the threshold is missed with a chance of at most MISS, however dense the data.  Vectors that are null, zero, empty, or hold null
    or non-finite components are linked with nothing, and so are vectors of different lengths.
    Equal vectors (up to a positive factor, as far as doubles show it) are linked.  Repeated rows are copies of
    one vector.  A row without an id counts as a link of others, and its component is the least id among
    its copies and links (null if none has one).  Other columns are ignored; an empty table gives an empty table."""
    base = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("embedding"))
    clean = save(base.mapInArrow(_clean_rows, "vec_id long, v binary").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}))
    ids = clean.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = save(ids.join(clean.select("k1", "k2", F.col("vec_id").alias("node"), "v"), ["k1", "k2", "node"]).dropDuplicates(["k1", "k2", "node"]))
    spark = vectors.sparkSession
    n = nodes.count()
    bits = _bucket_bits(n, window)
    passes = max(passes, _passes_needed(bits, threshold))
    # windows reach across one edge of partitions only
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * passes // (4 * window)))
    dealt = nodes.select("node", "v").mapInArrow(_key_rows(passes, seed), "turn int, dim int, key long, node long, v binary").repartitionByRange(parts, "turn", "dim", "key", "node").sortWithinPartitions("turn", "dim", "key", "node")
    seen = save(dealt.mapInArrow(_window_rows(window, threshold), "a long, b long, turn int, dim int, edge int, place int, v binary"))
    inside = seen.where("edge is null").select("a", "b")
    across = seen.where("edge is not null").groupBy("turn", "dim", "edge").applyInPandas(_edge_links(window, threshold), "a long, b long")
    near = save(inside.unionByName(across))
    known = components(near)
    more = _crowded(nodes, known, passes, seed, bits, window, threshold)
    if more is not None and not more.isEmpty():
        known = components(near.unionByName(more))
    members = save(nodes.join(known, "node").select("node", "component", "copies", "v"))
    doubles = members.mapInArrow(_doubles, "component long, x array<double>")
    mean = doubles.select("component", F.posexplode("x")).groupBy("component", "pos").agg(F.avg("col").alias("m")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).getField("m").alias("mean"))
    mean = save(mean)  # so that the join can split a hot component
    angles = save(members.join(mean, "component").select("node", "component", "copies", "v", "mean").mapInArrow(_angle_rows, "node long, component long, copies long, v binary, angle double"))
    sizes = save(angles.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("copies").alias("all_copies"), F.count("*").alias("size")))
    judged = angles.join(sizes, "component")
    sure = F.col("angle") + F.col("widest") <= float(np.arccos(threshold)) - SLACK
    links = judged.where(sure).select("node", (F.col("all_copies") - F.col("copies")).alias("found"))
    unsure = save(judged.where(~sure))
    if not unsure.isEmpty():
        open_sizes = unsure.groupBy("component").agg(F.count("*").alias("open"))
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        left = unsure.join(open_sizes, "component").select("component", "node", "copies", "v", F.pmod(F.xxhash64("node"), blocks("open")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"), F.lit(0).alias("side"))
        right = judged.join(open_sizes, "component").select("component", "node", "copies", "v", F.explode(F.sequence(F.lit(0), blocks("open") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(3)), blocks("size")).cast("int").alias("j"), F.lit(1).alias("side"))
        counted = left.unionByName(right).groupBy("component", "i", "j").applyInPandas(_block_counts(threshold), "node long, found long")
        links = links.unionByName(counted.groupBy("node").agg(F.sum("found").alias("found")))
    named = nodes.select("k1", "k2", "node", "copies").join(known, "node", "left").join(links, "node", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = clean.where("v is not null").join(named, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.unionByName(clean.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _doubles(batches):
    for batch in batches:
        raw = batch.column("v").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array([np.frombuffer(v, dtype=np.float64) for v in raw], pa.list_(pa.float64()))], names=["component", "x"])
