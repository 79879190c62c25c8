"""Removal of long repeated passages by prefix-free parsing and suffix arrays.

Parse.  A rolling hash over 8 bytes puts a trigger at about every 64th byte; the text between triggers is a phrase.
The start of a window of `length` bytes lies in one phrase: the first trigger at or after it ends that phrase, and the
window is a phrase's suffix (up to the trigger) followed by a beginning of the parse's suffix there.  Starts that
share a trigger and a distance class (128 wide, less for short windows) form a cell.  Cells whose common bytes (core) occur once hold no repeated
start and go; cells all of whose bytes (extent) occur twice or more hold only repeated ones.  What is left
are the cells at the ends of repeated passages, and one witness for each extent that shares their core.

Suffix arrays.  Two sorted tables are made of these.  The dictionary holds the distinct phrase ends, read
backwards from the trigger, so that the phrases that end in one suffix are neighbours.  The parse's suffix
array holds the distinct texts that follow the triggers.  Each is sorted by ranges over the cluster, and the lengths of common
prefixes of neighbours give, for each depth, the interval of entries that agree so far; an interval goes by its first entry.
Only what a partition can't see, where its first intervals began, is carried from partition to partition on the driver,
as one place per depth and partition.

Corpus order.  A start at distance d from its trigger is (interval of its phrase end at depth d, interval of what
follows at depth length - d).  Starts that agree in both are a run of equal suffixes in corpus order; a start is repeated if
its run has two members.  Starts whose phrase end or whose following text is alone in its interval are dropped before
runs are counted.

Stretches without a trigger near enough to name all their starts take the least rolling hash within reach instead.  Cores, extents and
the joins with the two tables go by 64-bit hashes of strings: the result is exact up to their collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import save, scratch, small_batches

WINDOW, PERIOD, TIER = 8, 64, 128
FLUSH = 200_000
#: Bits of a place in a partition of a sorted table, and of a distance.
PLACE_BITS, DISTANCE_BITS = 32, 10
NEVER = 1 << 20

_INT64, _INT32 = pa.int64(), pa.int32()
CELLS = {"core": _INT64, "extent": _INT64, "rid": _INT64, "start": _INT32, "len": _INT32, "reach": _INT32}
CONTEXTS = {"rid": _INT64, "start": _INT32, "near": _INT32, "far": _INT32, "weight": _INT32, "left": pa.binary(), "right": pa.binary()}
PIECES = {"rid": _INT64, "at": _INT32, "text": pa.binary()}
SUFFIXES = {"end": _INT64, "next": _INT64, "rid": _INT64, "start": _INT32, "weight": _INT32}
_SQL = {_INT64: "long", _INT32: "int", pa.binary(): "binary", pa.list_(_INT32): "array<int>", pa.list_(_INT64): "array<long>"}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{k}` {_SQL[v]}" for k, v in fields.items())


def cells(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cells of some texts of `length` bytes or more, text i at bounds[i] of data: core and extent hash, text, first start, number of
    starts, and the first start's distance from the trigger."""
    h, n = tc.prefix_hash(data), len(data)
    begin, end = bounds[:-1], bounds[1:]
    k = np.arange(n - WINDOW + 1)
    g = tc.span_hash(h, k, k + WINDOW)
    # a trigger must lie inside every window that it names
    reach = min(3 * TIER, length - WINDOW)
    at = k[(g % tc.U(PERIOD)) == 0]
    doc = np.searchsorted(bounds, at, side="right") - 1
    inside = at + WINDOW <= end[doc]
    at, doc = at[inside], doc[inside]
    prev = begin[doc] - 1
    prev[1:] = np.maximum(prev[1:], at[:-1])
    far = np.minimum(at - prev - 1, reach - 1)  # distance of the farthest start
    near = np.zeros_like(at)
    # starts that no trigger names: named by the least hash within reach
    stop = end - length + 1
    names = np.bincount(np.minimum(at - far, stop[doc]), minlength=n + 1) - np.bincount(np.minimum(at + 1, stop[doc]), minlength=n + 1)
    # nor does any name those whose windows end in another text
    names += np.bincount(stop, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    rest = np.flatnonzero(np.cumsum(names)[:n] == 0)
    if len(rest):
        width = length - WINDOW + 1
        view = np.lib.stride_tricks.sliding_window_view(g, width)
        least = np.concatenate([view[rest[i : i + 4096]].argmin(axis=1) for i in range(0, len(rest), 4096)]) + rest
        new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (rest[1:] != rest[:-1] + 1))))
        final = np.concatenate((new[1:], [len(rest)])) - 1
        at = np.concatenate((at, least[new]))
        far = np.concatenate((far, least[new] - rest[new]))
        near = np.concatenate((near, least[new] - rest[final]))
        doc = np.concatenate((doc, np.searchsorted(bounds, rest[new], side="right") - 1))
    out = []
    # windows of a cell have about half their bytes in common, or more
    tier = min(TIER, length // 2 + WINDOW, length)
    for low in range(0, length, tier):
        sel = (far >= low) & (near < low + tier)
        t, d = at[sel], doc[sel]
        first = t - np.minimum(far[sel], low + tier - 1)
        final = np.minimum(t - np.maximum(near[sel], low), stop[d] - 1)
        ok = final >= first
        t, d, first, final = t[ok], d[ok], first[ok], final[ok]
        # bytes common to all starts at distances low .. low + tier - 1
        a, b = t - low, t - (low + tier - 1) + length
        core = tc.span_hash(h, a, np.minimum(b, end[d]))
        out.append((core, tc.span_hash(h, first, final + length), d, first - begin[d], final - first + 1, t - first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    data, bounds = tc.column_bytes(batch.column(column))
    for i in range(len(bounds) - 1):
        yield data[bounds[i] : bounds[i + 1]]


def _emit(rows: list[tuple[np.ndarray, ...]], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = []
    for column, kind in zip(zip(*rows, strict=True), fields.values(), strict=True):
        x = np.concatenate(column)
        arrays.append(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind, safe=False))
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def _gathered(parts, fields: dict[str, pa.DataType]):
    """Tuples of arrays, put together to batches of some 200,000 rows."""
    rows, count = [], 0
    for part in parts:
        rows.append(part)
        count += len(part[0])
        if count > FLUSH:
            yield _emit(rows, fields)
            rows, count = [], 0
    if count:
        yield _emit(rows, fields)


def _cell_rows(length: int):
    def parts(batches):
        for batch in batches:
            data, bounds = tc.column_bytes(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for i, j in tc.chunks(bounds):
                size = np.diff(bounds[i : j + 1])
                long = size >= length
                if long.any():
                    x = data[bounds[i] : bounds[j]][np.repeat(long, size)]
                    core, extent, doc, start, count, reach = cells(x, np.concatenate(([0], np.cumsum(size[long]))), length)
                    yield core, extent, rid[i:j][long][doc], start, count, reach

    return lambda batches: _gathered(parts(batches), CELLS)


def _context_rows(length: int):
    """Of the cells listed with each text: the phrase end before the trigger, backwards, and what follows the trigger."""

    def rows(batches):
        for batch in batches:
            lists, out, held = batch.column("cells"), [], 0
            for rid, listed, x in zip(batch.column("rid").to_pylist(), lists, _texts(batch), strict=True):
                for c in listed.as_py():
                    t = c["start"] + c["reach"]
                    near = c["reach"] - c["len"] + 1
                    out.append((rid, c["start"], near, c["reach"], c["weight"], x[c["start"] : t][::-1].tobytes(), x[max(t, 0) : t + length - near].tobytes()))
                    held += len(out[-1][-1])
                    if held > 1 << 23:
                        yield _batch(out, CONTEXTS)
                        out, held = [], 0
            if out:
                yield _batch(out, CONTEXTS)

    return rows


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))


#: A sorted table: entries (key, part, steps of their intervals, the depth from which they are alone), and one summary for each part.
ORDER = {"key": _INT64, "part": _INT32, "depths": pa.list_(_INT32), "places": pa.list_(_INT64), "alone": _INT32, "open": pa.list_(_INT64), "first": pa.binary(), "last": pa.binary()}


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of neighbours (one fewer than strings)."""
    size = np.array([len(s) for s in strings])
    width = int(size.max()) + 1
    m = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(-1, width)
    # beyond the shorter one nothing agrees
    same = (m[1:] == m[:-1]) & (np.arange(width)[None, :] < np.minimum(size[1:], size[:-1])[:, None])
    return (~same).argmax(axis=1)


def _order_rows(deepest: int):
    """Sorted distinct (s, key, n, shallow) -> ORDER: for each entry the intervals it is in, by depth from `shallow` on.

    An interval goes by the place of its first entry (part << PLACE_BITS | index); -1 if that is before this partition."""

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        left = np.full(deepest + 1, -1, dtype=np.int64)  # by depth: the first entry of the present interval
        index, first, last, waiting = 0, None, None, None
        out: list[tuple] = []

        def entry(key, n, depths, places, before, after):
            # alone from the depth on that neither neighbour reaches
            alone = max(before, after) + 1 if n == 1 and before >= 0 and after >= 0 else NEVER
            return key, part, depths, places, alone, None, None, None

        for batch in batches:
            strings = batch.column("s").to_pylist()
            if not strings:
                continue
            shared = common_prefixes(strings if last is None else [last, *strings]).tolist()
            if last is None:
                first, shared = strings[0], [-1, *shared]
            for s, key, n, shallow, common in zip(strings, batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("shallow").to_pylist(), shared, strict=True):
                if index:
                    left[common + 1 :] = part << PLACE_BITS | index
                own = left[shallow : len(s) + 1]
                cut = np.flatnonzero(own[1:] != own[:-1]) + 1
                if waiting:
                    out.append(entry(*waiting, common))
                waiting = (key, n, [shallow, *(cut + shallow).tolist()], [int(own[0]), *own[cut].tolist()], common)
                index += 1
            last = strings[-1]
            if len(out) > FLUSH // 10:
                yield _batch(out, ORDER)
                out = []
        if waiting:
            out.append(entry(*waiting, -1))
            out.append((None, part, None, None, None, left.tolist(), first, last))
            yield _batch(out, ORDER)

    return rows


def carried(summaries: list, deepest: int) -> dict[int, np.ndarray]:
    """For each partition of a sorted table, by depth, the first entry of the interval that its own first entry is in."""
    out, before, last = {}, None, None
    for r in sorted(summaries, key=lambda r: r["part"]):
        place = np.full(deepest + 1, r["part"] << PLACE_BITS, dtype=np.int64)
        if before is not None:
            shared = int(common_prefixes([last, bytes(r["first"])])[0])
            place[: shared + 1] = before[: shared + 1]
        out[r["part"]] = place
        left = np.array(r["open"], dtype=np.int64)
        before, last = np.where(left < 0, place, left), bytes(r["last"])
    return out


def _suffix_array(contexts: DataFrame, side: str, shallow: str, deepest: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The sorted table of the distinct strings in column `side`, and what its partitions carry."""
    distinct = save(contexts.groupBy(F.xxhash64(side).alias("key")).agg(F.min(side).alias("s"), F.sum("weight").alias("n"), F.min(F.expr(shallow)).alias("shallow")))
    order = save(distinct.repartitionByRange("s").sortWithinPartitions("s").select("s", "key", "n", "shallow").mapInArrow(tc.releasing(_order_rows(deepest)), _ddl(ORDER)))
    # one row for each partition
    return order.where("key is not null").select("key", "part", "depths", "places", "alone"), carried(order.where("key is null").select("part", "open", "first", "last").collect(), deepest)


def _places(depths, places, part, carry: dict[int, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The intervals of an entry at some depths."""
    got = places[np.searchsorted(depths, wanted, side="right") - 1]
    return np.where(got < 0, carry[part][wanted], got)


def _suffix_rows(length: int, carries):
    """Contexts with their entries in both tables -> starts that may be repeated, by their place in corpus order."""

    def parts(batches):
        ends, nexts = carries.value
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            flat = {n: c[n].to_numpy() for n in ("rid", "start", "near", "far", "weight", "l_part", "r_part", "l_alone", "r_alone")}
            for i in range(len(batch)):
                # distances, where neither part of the window is alone
                low = max(int(flat["near"][i]), length - int(flat["r_alone"][i]) + 1)
                high = min(int(flat["far"][i]), int(flat["l_alone"][i]) - 1)
                if high < low:
                    continue
                d = np.arange(low, high + 1)
                end = _places(c["l_depths"][i].values.to_numpy(), c["l_places"][i].values.to_numpy(), int(flat["l_part"][i]), ends, d)
                follow = _places(c["r_depths"][i].values.to_numpy(), c["r_places"][i].values.to_numpy(), int(flat["r_part"][i]), nexts, length - d)
                start = flat["start"][i] + flat["far"][i] - d
                yield end << DISTANCE_BITS | d, follow, np.full(len(d), flat["rid"][i]), start, np.full(len(d), flat["weight"][i])

    return lambda batches: _gathered(parts(batches), SUFFIXES)


def _in_corpus_order(docs: DataFrame, compared: DataFrame, length: int) -> DataFrame:
    """The repeated ones among the starts of some cells: (rid, start, len)."""
    spark = docs.sparkSession
    lists = compared.groupBy("rid").agg(F.collect_list(F.struct("start", "len", "reach", "weight")).alias("cells"))
    contexts = save(docs.select("rid", "text").join(lists, "rid").mapInArrow(tc.releasing(_context_rows(length)), _ddl(CONTEXTS)))
    ends, end_carry = _suffix_array(contexts, "left", "near", length)
    nexts, next_carry = _suffix_array(contexts, "right", f"{length} - far", length)
    carries = spark.sparkContext.broadcast((end_carry, next_carry))
    named = lambda t, p: t.select(F.col("key").alias(f"{p}_key"), *(F.col(n).alias(f"{p}_{n}") for n in ("part", "depths", "places", "alone")))
    keyed = contexts.select("rid", "start", "near", "far", "weight", F.xxhash64("left").alias("l_key"), F.xxhash64("right").alias("r_key"))
    placed = keyed.join(named(ends, "l"), "l_key").join(named(nexts, "r"), "r_key").drop("l_key", "r_key")
    suffixes = save(placed.mapInArrow(tc.releasing(_suffix_rows(length, carries)), _ddl(SUFFIXES)))
    runs = suffixes.groupBy("end", "next").agg(F.sum("weight").alias("n")).where("n > 1").select("end", "next")
    return save(suffixes.where("weight = 1").join(runs, ["end", "next"], "left_semi").select("rid", "start", F.lit(1).alias("len")))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """docs (rid, text) -> (rid, start, len): runs of starts whose window of `length` bytes starts elsewhere too."""
    with scratch() as keep:
        parsed = save(docs.select("rid", "text").mapInArrow(tc.releasing(_cell_rows(length)), _ddl(CELLS)))
        # each written, so that the joins read both sides from plain exchanges, whose hot keys they can split
        common = save(parsed.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
        found = save(parsed.join(common, "core", "left_semi"))
        extents = save(found.groupBy("extent").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1"))
        kept = save(found.join(extents, "extent", "left").withColumn("n", F.coalesce("n", F.lit(1))))
        for done in (parsed, common, found, extents):
            scratch.drop(done)
        full = kept.where("n > 1").select("rid", "start", "len")
        alone = kept.where("n = 1").select("core", "rid", "start", "len", "reach", "n")
        # one member of each extent that occurs twice or more; equal extents have as many starts
        witness = kept.where("n > 1 and rid = first").groupBy("core", "extent", "rid", "len", "reach", "n").agg(F.min("start").alias("start")).select("core", "rid", "start", "len", "reach", "n")
        compared = alone.unionByName(witness.join(save(alone.select("core").distinct()), "core", "left_semi"))
        single = _in_corpus_order(docs, compared.withColumn("weight", F.when(F.col("n") > 1, 2).otherwise(1)), length)
        return keep(save(full.unionByName(single)))


def _covered(n: int, runs, length: int) -> np.ndarray:
    """Which of n bytes the windows at some runs of starts cover."""
    x = runs.values
    if x is None or not len(x):
        return np.zeros(n, dtype=bool)
    start = x.field("start").to_numpy()
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + x.field("len").to_numpy() - 1 + length, -1)
    return np.cumsum(d[:-1]) > 0


def _spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _long_spans(x: np.ndarray, gone: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that hold at least so many whole words."""
    a, b = _spans(gone)
    if words and len(a):
        start, end, _ = tc.word_spans(x, np.array([0, len(x)]))
        ok = np.searchsorted(end, b, side="right") - np.searchsorted(start, a, side="left") >= words
        a, b = a[ok], b[ok]
    return a, b


def _piece_rows(length: int, shorter: int):
    """(rid, text, shorter) -> (rid, at, text): the parts of a text all of whose strings of `shorter` bytes are repeated, if `length` bytes or longer."""

    def rows(batches):
        for batch in batches:
            lists, out = batch.column("shorter"), []
            for i, (rid, x) in enumerate(zip(batch.column("rid").to_pylist(), _texts(batch), strict=True)):
                # runs of repeated starts
                a, b = _spans(_covered(len(x), lists[i], 1))
                for j, k in zip(a.tolist(), (b - 1 + shorter).tolist(), strict=True):
                    if k - j >= length:
                        out.append((rid, j, x[j:k].tobytes()))
            if out:
                yield _batch(out, PIECES)

    return rows


def _cut_rows(length: int, words: int, passage: int, passage_words: int, with_text: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages", "passage_bytes"] if passage else [])]
    kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names]

    def rows(batches):
        for batch in batches:
            lists, out, texts = batch.column("starts"), [], []
            shorter = batch.column("shorter") if passage else None
            for i, x in enumerate(_texts(batch)):
                a, b = _long_spans(x, _covered(len(x), lists[i], length), words)
                keep = np.ones(len(x), dtype=bool)
                for j, k in zip(a, b, strict=True):
                    keep[j:k] = False
                raw = x[keep].tobytes()
                row = [len(x), int((b - a).sum()), len(a), hashlib.sha256(raw).hexdigest()]
                if passage:
                    j, k = _long_spans(x, _covered(len(x), shorter[i], passage), passage_words)
                    row += [len(j), int((k - j).sum())]
                out.append(row)
                if with_text:
                    texts.append(raw.decode("utf-8", "ignore") if len(a) else raw.decode("utf-8"))
            cols = [pa.array(v, t) for v, t in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            rest = [f for f in batch.schema.names if f not in ("starts", "shorter", "rid", "text") or (f == "text" and with_text)]
            arrays = [pa.array(texts, pa.string()) if f == "text" else batch.column(f) for f in rest]
            yield pa.RecordBatch.from_arrays(arrays + cols, names=rest + names)

    return rows


def suffix_dedup(docs: DataFrame, length: int = 400, words: int = 0, passage: int = 0, passage_words: int = 51, columns: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that starts at two places or more of the whole input; with
    `words`, only in spans of at least so many whole words.

    Returns `columns` (and the remaining text, if with_text: cuts may split a character, whose
    left-over bytes are dropped from the text but not from the digest) with n_bytes, n_removed,
    n_spans and kept_sha256.  With `passage`, a length below `length`, n_passages and passage_bytes tell of the maximal spans
    that repeated strings of that many bytes cover and that hold at least `passage_words` words; they aren't removed.
    Null texts are empty; texts under `length` bytes are kept
    whole; rows with the same id and text are judged as two places; a text of any length is handled whole, by itself.  Other columns, whatever their
    names, are ignored.  An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    base = docs.select(*(F.col(f"`{c}`") for c in columns), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64(*columns, "text"))
    listed = lambda starts, name: starts.groupBy("rid").agg(F.collect_list(F.struct("start", "len")).alias(name))
    if passage:
        short = save(listed(repeated_starts(base, passage), "shorter"))
        joined = base.join(short, "rid", "left")
        # all shorter windows of a repeated window are repeated: it lies in a part that such ones cover, here and elsewhere
        pieces = base.select("rid", "text").join(short, "rid").mapInArrow(tc.releasing(_piece_rows(length, passage)), _ddl(PIECES))
        pieces = save(pieces.select(F.xxhash64("rid", "at", "text").alias("rid"), F.col("rid").alias("whole"), "at", "text"))
        found = repeated_starts(pieces.select("rid", "text"), length)
        starts = found.join(pieces.select("rid", "whole", "at").distinct(), "rid").select(F.col("whole").alias("rid"), (F.col("start") + F.col("at")).alias("start"), "len")
    else:
        joined, starts = base, repeated_starts(base, length)
    joined = joined.join(listed(starts, "starts"), "rid", "left")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(["text string"] if with_text else []), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["n_passages long, passage_bytes long"] if passage else [])])
    return joined.select(*columns, "text", "starts", *(["shorter"] if passage else [])).mapInArrow(tc.releasing(_cut_rows(length, words, passage, passage_words, with_text)), schema)
