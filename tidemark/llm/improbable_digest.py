"""Improbable-feature digests: documents as chains of Bloom filters over their rarest byte windows.

Every window of 64 bytes has an entropy; how often each entropy occurs in the whole corpus ranks windows by
rarity.  A window that is the rarest of its 64 neighbours often enough is a feature of its document.  Features enter Bloom
filters in order, 160 each, and two digests are alike as far as their filters overlap beyond chance (Roussev, 2010).

All arithmetic on entropies is on integers, so that a window has one rank wherever it lies.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import chunks, column_bytes, prefix_hash, releasing, span_hash

WINDOW = 64
#: Windows of 64 neighbours in which a feature must be the rarest.
POPULAR = 16
#: Entropies are levels of 0 to 1000; windows below this one (runs of few symbols) are no features.
WEAK = 100
LEVELS = 1001
BITS, HASHES, CROWD = 2048, 5, 160
#: Bytes that are handled at once, which stay in a core's cache.
BLOCK = 1 << 17

_UNIT = 1 << 20
_N_LOG_N = np.array([0, *(round(n * math.log2(n) * _UNIT) for n in range(1, WINDOW + 1))], dtype=np.int64)
_STEP = np.diff(_N_LOG_N)
_FULL = int(_N_LOG_N[WINDOW])
_NONE = np.int32(2**31 - 1)
_PLACE = 20

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of the window that starts at each byte but the last 63.

    The sum of n * log(n) over a window's symbols changes, as it moves by a byte, by what the counts of the
    two bytes involved say; counts are sums of comparisons with the bytes 1 to 63 before."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    equal = np.empty(n, bool)
    for lag in range(1, WINDOW):
        e = np.equal(data[lag:], data[:-lag], out=equal[lag:]).view(np.uint8)
        before[lag:] += e
        after[:-lag] += e
    total = np.cumsum(_STEP[before])[WINDOW - 1 :]
    total[1:] -= np.cumsum(_STEP[after[: n - WINDOW]])
    return ((_FULL - total) * (LEVELS - 1) // _FULL).astype(np.int32)


def _whole_windows(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which bytes start a window that ends in the same document."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(bounds[1:] - (WINDOW - 1), bounds[:-1]), 1)
    np.add.at(edge, bounds[1:], -1)
    return np.cumsum(edge[:n]) == 0


def _popular(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the features of a block of documents."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    level = entropy_levels(data)
    good = _whole_windows(bounds, n)[: len(level)] & (level >= WEAK)
    low = np.full(n + 2 * (WINDOW - 1), _NONE)
    at = np.flatnonzero(good)
    low[at + WINDOW - 1] = (rank[level[at]] << _PLACE) | at.astype(np.int32)
    for w in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-w], low[w:])
    won = np.bincount(low[low != _NONE] & ((1 << _PLACE) - 1), minlength=n)
    return np.flatnonzero(won >= POPULAR)


def _features(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all features, in order; a text without any is one feature as a whole."""
    owners, hashes = [], []
    for i, j in chunks(bounds, BLOCK):
        a, b = int(bounds[i]), int(bounds[j])
        # a text longer than a block is taken in pieces that overlap by all that a feature depends on
        for c in range(a, b, BLOCK if j == i + 1 else max(b - a, 1)):
            d = min(c + BLOCK, b) if j == i + 1 else b
            lo, hi = max(a, c - (WINDOW - 1)), min(b, d + 2 * (WINDOW - 1))
            piece = data[lo:hi]
            at = _popular(piece, np.clip(bounds[i : j + 1], lo, hi) - lo, rank)
            at = at[(at + lo >= c) & (at + lo < d)]
            hashes.append(span_hash(prefix_hash(piece), at, at + WINDOW))
            owners.append(np.searchsorted(bounds, at + lo, side="right") - 1)
    doc = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bare = np.setdiff1d(np.flatnonzero(np.diff(bounds)), doc)
    if len(bare):
        whole = [span_hash(prefix_hash(data[bounds[k] : bounds[k + 1]]), np.zeros(1, np.int64), np.array([bounds[k + 1] - bounds[k]]))[0] for k in bare]
        doc, h = np.concatenate([doc, bare]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


class Digests:
    """Chained filters of some documents: filters[k] holds counts[k] features; document d has those from first[d] to first[d + 1]."""

    def __init__(self, texts: list[bytes], rank: np.ndarray):
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        doc, h = _features(np.frombuffer(b"".join(texts), np.uint8), bounds, rank)
        order = np.lexsort((np.arange(len(h)), h, doc))
        once = np.ones(len(h), bool)
        once[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        doc, h = doc[once], h[once]
        n = np.bincount(doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(-(-n // CROWD))])
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[doc] + place // CROWD
        self.counts = np.bincount(at, minlength=int(self.first[-1]))
        bits = np.zeros((int(self.first[-1]), BITS), bool)
        for k in range(HASHES):
            bits[at, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits, axis=1)

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(int(self.first[d]), int(self.first[d + 1]))
        return self.counts[s], self.filters[s]

    def __len__(self) -> int:
        return len(self.first) - 1


def fingerprint(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """Counts of features and filters in hexadecimal; empty for the empty text."""
    counts, filters = digest
    return f"{','.join(map(str, counts.tolist()))}:{filters.tobytes().hex()}" if len(counts) else ""


def _scores(counts: np.ndarray, filters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Overlap of filters i and j between what chance explains (0) and all of the smaller one's bits (1)."""
    q = (1 - 1 / BITS) ** (HASHES * np.arange(2 * CROWD + 1))
    ones = np.bitwise_count(filters).sum(axis=1, dtype=np.int64)
    e = np.bitwise_count(filters[i] & filters[j]).sum(axis=1, dtype=np.int64)
    chance = BITS * (1 - q[counts[i]] - q[counts[j]] + q[counts[i] + counts[j]])
    return np.where(e < chance + 3 * np.sqrt(chance), 0.0, np.clip((e - chance) / (np.minimum(ones[i], ones[j]) - chance), 0, 1))


def likeness(counts: np.ndarray, filters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of digests (rows of a and b: first filter, and one past the last) the mean best overlap of the shorter chain's filters,
    weighted by their features (both ways if equally long).  Two empty texts are alike, an empty one and another aren't."""
    na, nb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
    out, ways = ((na == 0) & (nb == 0)).astype(float), np.ones(len(a))
    for (x, nx), (y, ny) in (((a, na), (b, nb)), ((b, nb), (a, na))):
        some = np.flatnonzero((nx > 0) & (nx <= ny))
        if not len(some):
            continue
        pair = np.repeat(some, nx[some])
        row = np.arange(len(pair)) - np.repeat(np.cumsum(nx[some]) - nx[some], nx[some]) + x[pair, 0]
        best = np.empty(len(pair))
        ends = np.cumsum(ny[pair])
        s = 0
        while s < len(pair):
            # so many filters at once that their bits stay within some MB
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 14), side="right")))
            n = ny[pair[s:t]]
            starts = np.cumsum(n) - n
            j = np.arange(int(n.sum())) - np.repeat(starts, n) + np.repeat(y[pair[s:t], 0], n)
            best[s:t] = np.maximum.reduceat(_scores(counts, filters, np.repeat(row[s:t], n), j), starts)
            s = t
        head = np.cumsum(nx[some]) - nx[some]
        out[some] += np.add.reduceat(best * counts[row], head) / np.add.reduceat(counts[row], head)
        ways[some] += (nx == ny)[some] / 2
    return out / ways


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the following one (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def entropy_ranks(texts: DataFrame) -> np.ndarray:
    """Rank of each level by the windows of all texts that have it, the rarest first."""

    @releasing
    def count(batches):
        seen = np.zeros(LEVELS, np.int64)
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            for i, j in chunks(bounds, BLOCK):
                a, b = int(bounds[i]), int(bounds[j])
                for c in range(a, b, BLOCK if j == i + 1 else max(b - a, 1)):
                    d = min(c + BLOCK + WINDOW - 1, b) if j == i + 1 else b
                    level = entropy_levels(data[c:d])
                    seen += np.bincount(level[_whole_windows(np.clip(bounds[i : j + 1], c, d) - c, d - c)[: len(level)]], minlength=LEVELS)
        yield pa.record_batch([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], names=["level", "n"])

    seen = np.zeros(LEVELS, np.int64)
    for r in texts.mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        seen[r.level] = r.n
    rank = np.empty(LEVELS, np.int32)
    rank[np.lexsort((np.arange(LEVELS), seen))] = np.arange(LEVELS)
    return rank


def digest_documents(docs: DataFrame) -> DataFrame:
    """Digest of each text and of its edited text (see `edited`; the following document is the next by id, the first after
    the last), and how alike each is to the edited one and to the following one.

    The corpus is read twice: for the ranks, and for the digests.  Documents are dealt by ranges of ids in one shuffle; the first of
    each range is sent to the range before as well, so that each task sees its documents with those that follow.  Tasks stream:
    they hold a block of texts.  A null text counts as empty, and an empty text has an empty fingerprint; rows without an id come
    first; rows that repeat an id follow in the order of their texts (and stay in one range); a single document is followed by itself; texts
    of any length are taken whole, in pieces; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.min(key).alias("least"), F.expr(f"percentile_approx(coalesce(doc_id, {-(2**63)}L), array({', '.join(f'{k / parts}D' for k in range(1, parts)) or '0.5D'}), {max(10_000, 20 * parts)})").alias("at")).first()
    firsts = np.array(sorted({cuts.least, *cuts.at}) if cuts.least is not None else [0], np.int64)
    rank = entropy_ranks(rows.select("text"))

    @F.pandas_udf("int")
    def place(k):
        """Twice the range that an id lies in, and one more if the range begins with it."""
        import pandas as pd

        at = np.searchsorted(firsts, k.to_numpy(), side="right") - 1
        return pd.Series(2 * at + (firsts[at] == k.to_numpy())).astype("int32")

    own = F.struct((F.col("_p") / 2).cast("int").alias("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod((F.col("_p") / 2).cast("int") - 1, F.lit(len(firsts))).alias("part"), F.lit(True).alias("ahead"))
    sent = rows.withColumn("_k", key).withColumn("_p", place("_k")).withColumn("_to", F.explode(F.when(F.col("_p") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
    dealt = sent.select("_to.part", "_to.ahead", "doc_id", "text").repartitionById(len(firsts), F.col("part")).sortWithinPartitions("ahead", "doc_id", "text")

    @releasing
    def run(batches):
        held: list[tuple] = []  # (doc_id, text, counts, filters) of the row that waits for the one that follows
        block: list[tuple] = []
        size = 0

        def flush(ids, texts):
            own = Digests([t.encode() for t in texts], rank)
            line = [*((i, t) for i, t, *_ in held), *zip(ids, texts, strict=True)]
            changed = [edited(t, u).encode() for (_, t), (_, u) in zip(line, line[1:], strict=False)]
            new = Digests(changed, rank)
            # all filters in one table: of the row that waited, of the block, and of the edited texts
            chains = [*((c, f) for _, _, c, f in held), (own.counts, own.filters), (new.counts, new.filters)]
            counts, filters = np.concatenate([c for c, _ in chains]), np.concatenate([f for _, f in chains])
            shift = len(counts) - len(own.counts) - len(new.counts)
            first = np.concatenate([np.zeros(len(held), np.int64), own.first + shift])
            spans = np.stack([first[:-1], first[1:]], axis=1)
            other = new.first + shift + len(own.counts)
            held[:] = [(*line[-1], *own.of(len(own) - 1))]
            n = len(line) - 1
            words = filters.view(np.uint64)
            print_of = lambda s: fingerprint((counts[s[0] : s[1]], filters[s[0] : s[1]]))
            edits = np.stack([other[:-1], other[1:]], axis=1)
            return pa.record_batch(
                [
                    pa.array([i for i, _ in line[:n]], pa.int64()),
                    pa.array([len(t) for _, t in line[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                    pa.array([print_of(s) for s in spans[:n]], pa.string()),
                    pa.array([print_of(s) for s in edits], pa.string()),
                    pa.array(likeness(counts, words, spans[:n], edits), pa.float64()),
                    pa.array(likeness(counts, words, spans[:n], spans[1:]), pa.float64()),
                ],
                names=names,
            )

        names = [x.split()[0] for x in OUT.split(", ")]
        last = None
        for batch in batches:
            for ahead, i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ahead:
                    last = last or (i, t)
                    continue
                block.append((i, t))
                size += len(t)
                if size >= 4 * BLOCK:
                    yield flush(*zip(*block, strict=True))
                    block, size = [], 0
        if last and (block or held):
            yield flush(*zip(*[*block, last], strict=True))

    return dealt.mapInArrow(run, OUT)
