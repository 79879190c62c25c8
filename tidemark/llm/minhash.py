"""Near-duplicate documents by HyperMinHash.

Each document's set of word shingles is summarised by 128 registers.  A shingle's 64-bit hash
gives the register (7 bits) and a 57-bit value; a register keeps of its least value only the
count of leading zeros and the 10 bits after the first one, 16 bits in all.  Registers that no
shingle fell into borrow from a filled one in a fixed random order, so short sets agree
as often as their Jaccard similarity too.  Bands of the compressed registers propose pairs,
agreement of all registers corrected for chance collisions rejects those far from the
threshold, and what is left is confirmed on the full sets.

No bucket is ever expanded into all its pairs.  Equal sets are one node.  In each bucket
every member is first compared with the bucket's smallest; links found so make components.
Only buckets whose members then still lie in several components are looked at again, and
there only members of different components are compared, in blocks of bounded size that send on
nothing but links.  As a
pair within one component can't change the components, the result is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import components, save, small_batches

K, MANTISSA = 128, 10
BLOCK = 256
_U = tc.U
_RNG = np.random.RandomState(20240229)
#: For each register, the order in which it borrows.
_DONORS = np.array([_RNG.permutation(K) for _ in range(K)], dtype=np.int64)
with np.errstate(over="ignore"):
    _COEF = tc.mix(np.arange(1, 65, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each document (all its words if fewer), and each document's first."""
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(out_first[-1], dtype=_U)
    with np.errstate(over="ignore"):
        m = len(words) - size + 1
        if m > 0:
            full = np.zeros(m, dtype=_U)
            for i in range(size):
                full += words[i : i + m] * _COEF[i]
            full = tc.mix(full + _U(size))
            long = counts >= size
            at = np.repeat(firsts[:-1][long] - np.concatenate(([0], np.cumsum(n[long])[:-1])), n[long]) + np.arange(n[long].sum())
            out[np.repeat(long, n)] = full[at]
        for k in np.flatnonzero((counts > 0) & (counts < size)):
            w = words[firsts[k] : firsts[k + 1]]
            out[out_first[k]] = tc.mix((w * _COEF[: len(w)]).sum(keepdims=True) + _U(len(w)))[0]
    return out, out_first


def registers(u: np.ndarray) -> np.ndarray:
    """Compressed registers of a non-empty sorted array of distinct hashes."""
    bucket = (u >> _U(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    value = u[first] << _U(7)
    top = (value >> _U(11)).astype(np.float64)  # 53 bits, exact
    zeros = np.where(top > 0, 53 - np.frexp(np.maximum(top, 1))[1], 53).astype(_U)
    tail = ((value << zeros) << _U(1)) >> _U(64 - MANTISSA)
    reg = np.zeros(K, dtype=np.uint16)
    filled = np.zeros(K, dtype=bool)
    reg[bucket[first]] = ((zeros << _U(MANTISSA)) | tail).astype(np.uint16)
    filled[bucket[first]] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        donors = _DONORS[empty]
        reg[empty] = reg[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
    return reg


def chance(n: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of about n elements collide."""
    load = np.maximum(np.asarray(n, dtype=np.float64) / K, 1.0)[..., None]
    i = np.arange(0, 40)
    lo, hi = 0.5 ** (i + 1), 0.5**i
    mass = np.exp(-load * lo) - np.exp(-load * hi)  # of each leading-zero count
    return (mass**2).sum(axis=-1) / 2**MANTISSA


def estimate(equal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, corrected for chance collisions."""
    c = chance(n)
    return np.maximum(0, (equal / K - c) / (1 - c))


def least_estimate(n: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs estimated lower than this are rejected: 4.5 standard deviations under the threshold."""
    return threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / np.clip(n, 1, K))


def _document_sets(batch_column, size: int):
    """Sorted distinct shingle hashes of each text of an Arrow column, in order."""
    data, bounds = tc.column_bytes(batch_column)
    for i, j in tc.chunks(bounds):
        d = tc.lower_ascii(data[bounds[i] : bounds[j]])
        words, firsts = tc.word_hashes(d, bounds[i : j + 1] - bounds[i])
        sh, at = shingle_hashes(words, firsts, size)
        for k in range(j - i):
            yield np.unique(sh[at[k] : at[k + 1]])


def _sketch_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("regs", pa.binary())])

    def rows(batches):
        for batch in batches:
            n, f1, f2, regs = [], [], [], []
            for u in _document_sets(batch.column("text"), size):
                n.append(len(u))
                f1.append(int(tc.mix(u).sum(dtype=_U).view(np.int64)))
                f2.append(int(tc.mix(u ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)))
                regs.append(registers(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())], schema=schema)

    return rows


def _likely_rows(threshold: float):
    """(a, b, na, nb, ra, rb) -> pairs that the registers don't reject."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, K) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            n = np.minimum(na, nb)
            ok = estimate((ra == rb).sum(axis=1), n) >= least_estimate(n, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return rows


def _linked_rows(size: int, percent: int):
    """(a, b, ta, tb) -> pairs whose full sets have 100 * intersection >= percent * union."""

    def rows(batches):
        known, sets = None, None
        for batch in batches:
            b_ids = batch.column("b").to_pylist()
            ok = []
            tb = batch.column("tb")
            for i, u in enumerate(_document_sets(batch.column("ta"), size)):
                if b_ids[i] != known:
                    known, sets = b_ids[i], next(_document_sets(tb.slice(i, 1), size))
                both = 0
                if len(sets) and len(u):
                    at = np.minimum(np.searchsorted(sets, u), len(sets) - 1)
                    both = int((sets[at] == u).sum())
                ok.append(100 * both >= percent * (len(u) + len(sets) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their incidence matrices."""
    sizes = [len(u) for u in left + right]
    _, ids, times = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    often = times[ids] > 1
    column = np.cumsum(times > 1) - 1
    ids, owner = column[ids[often]], owner[often]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    out = np.zeros((len(left), len(right)))
    width = 4096
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        i, j = np.searchsorted(ids, (low, low + width))
        m = np.zeros((len(sizes), width), dtype=np.float32)
        m[owner[i:j], ids[i:j] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _block_links(size: int, threshold: float, percent: int):
    """One block of a group of buckets: links across components, as pairs of components."""
    import pandas as pd

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        left, right = pdf[pdf.side != 1], pdf[pdf.side != 0]
        if not len(left) or not len(right):
            return none
        ra, rb = (np.frombuffer(b"".join(map(bytes, p.regs)), dtype=np.uint16).reshape(-1, K) for p in (left, right))
        ca, cb, na, nb = left.component.to_numpy(), right.component.to_numpy(), left.n.to_numpy(), right.n.to_numpy()
        likely = np.zeros((len(left), len(right)), dtype=bool)
        for k in range(len(left)):
            n = np.minimum(na[k], nb)
            ok = (cb != ca[k]) & (100 * n >= percent * np.maximum(na[k], nb))
            ok[ok] &= estimate((rb[ok] == ra[k]).sum(axis=1), n[ok]) >= least_estimate(n[ok], threshold)
            likely[k] = ok
        rows, cols = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if not len(rows):
            return none
        sets = [list(_document_sets(pa.array(p.text.iloc[at], pa.string()), size)) for p, at in ((left, rows), (right, cols))]
        both = _overlaps(*sets)
        union = np.array([len(u) for u in sets[0]])[:, None] + np.array([len(u) for u in sets[1]])[None, :] - both
        i, j = np.nonzero(likely[np.ix_(rows, cols)] & (100 * both >= percent * union))
        x, y = ca[rows[i]], cb[cols[j]]
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return links


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (a, b) node pairs, those that are linked.  nodes: (node, n, regs)."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    likely = save(pairs.hint("merge").join(one, "a").join(two.hint("merge"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tc.releasing(_likely_rows(percent / 100)), "a long, b long"))
    both = likely.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return save(both.select("a", "b", "ta", "tb").mapInArrow(tc.releasing(_linked_rows(size, percent)), "a long, b long"))


def _across(hits: DataFrame, known: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between components that share a bucket, as pairs of components; None if no bucket holds several.

    Buckets that share members are one group, so that a pair which many bands bring together is compared once."""
    members = hits.where("size > 2").join(known, "node", "left").select("key", "node", "b", F.coalesce("component", "node").alias("component"))
    mixed = save(members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    if mixed.isEmpty():
        return None
    groups = components(hits.where("size > 2 and node != b").join(mixed, "key").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "group")
    placed = save(groups.join(nodes.select("node", "n"), "node").join(known, "node", "left").select("group", "node", "n", F.coalesce("component", "node").alias("component")))
    shares = placed.groupBy("group", "component").agg(F.count("*").alias("m"))
    sizes = save(shares.groupBy("group").agg(F.max_by("component", "m").alias("main"), F.max("m").alias("main_size"), F.sum("m").alias("all_size"), F.count("*").alias("kinds")).where("kinds > 1"))
    placed = placed.join(sizes, "group")
    columns = ["group", "node", "n", "component"]
    small = placed.where(F.col("all_size") <= BLOCK).select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    # blocks 1..few are outside the largest component, and are compared with each other and with its blocks
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    few, many = blocks(F.col("all_size") - F.col("main_size")), blocks(F.col("main_size"))
    own = F.when(F.col("component") == F.col("main"), F.lit(1) + few + F.pmod(F.xxhash64("node"), many)).otherwise(F.lit(1) + F.pmod(F.xxhash64("node"), few)).cast("int")
    large = placed.where(F.col("all_size") > BLOCK).select(*columns, own.alias("own"), few.alias("few"), (few + many).alias("blocks"))
    as_left = large.where("own <= few").select(*columns, F.col("own").alias("i"), F.explode(F.sequence("own", "blocks")).alias("j"), F.lit(0).alias("side"))
    as_right = large.select(*columns, F.explode(F.sequence(F.lit(1), F.least("own", "few"))).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    dealt = small.unionByName(as_left).unionByName(as_right).join(nodes.select("node", "regs"), "node").join(texts, "node")
    return save(dealt.groupBy("group", "i", "j").applyInPandas(_block_links(size, percent / 100, percent), "a long, b long").distinct())


def minhash_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 85, rows_per_band: int = 5) -> DataFrame:
    """Link documents with 100 * |A and B| >= percent * |A or B| over their sets of word shingles.

    Returns doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id =
    component_id).  Words are lower-cased in A-Z and split at bytes 9-13 and 32.  Documents without words
    (null and blank texts) are linked with nothing.  Rows with the same doc_id are one node and
    answered each; a row without an id is linked through equal sets only, and is its own,
    null, component if no row with an id has its set.  Other columns are ignored; an empty table
    gives an empty table."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = save(base.mapInArrow(tc.releasing(_sketch_rows(shingle_words)), "doc_id long, n long, f1 long, f2 long, regs binary"))
    filled = sketches.where("n > 0 and doc_id is not null")
    ids = filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    nodes = save(ids.join(filled.withColumnRenamed("doc_id", "node"), ["f1", "f2", "node"]).dropDuplicates(["f1", "f2", "node"]))
    light = nodes.select("node", "n", "regs")
    bands = nodes.select("node", "n", F.explode(F.expr(f"transform(sequence(0, {K // rows_per_band - 1}), i -> xxhash64(i, substring(regs, i * {2 * rows_per_band} + 1, {2 * rows_per_band})))")).alias("key"))
    groups = save(bands.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("size")).where("size > 1"))
    hits = save(bands.join(groups, "key"))
    # always dealt by id, however few take part: the texts are what is large
    texts = save(base.join(hits.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))
    # first each member with the smallest of its bucket
    first = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    star = hits.where("node != b").select(F.col("node").alias("a"), "b", "n").distinct().join(first, "b").where(f"100 * least(n, nb) >= {percent} * greatest(n, nb)").select("a", "b")
    links = _confirmed(star, light, texts, shingle_words, percent)
    known = components(links)
    # then, in buckets of three and more that hold several components, members of different ones
    more = _across(hits, known, light, texts, shingle_words, percent)
    if more is not None and not more.isEmpty():
        known = components(links.unionByName(more))
    named = nodes.join(known, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    out = sketches.where("n > 0").join(named, ["f1", "f2"], "left").unionByName(sketches.where("n = 0").withColumn("component", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
