"""Toxicity by class-conditional Kneser-Ney models.

Two models of neighbouring words, one of toxic and one of ordinary documents, share their backoff counts.  A class's
count of a word or pair is what the counts of both classes together lead to expect of it, plus what it
has beyond that, less a discount of `kappa` standard deviations of that expectation (absolute discounting of the difference,
with a continuous result: a rare expression keeps the part of its own counts that is more than chance).  For a pair, the expectation is
the backing-off model's own, from the class counts of its first word and the class probability of its second.  Below words, both
classes back off to one distribution, in how many distinct pairs a word ends.  Every token of a text is scored under both models, and
its length-normalised log-likelihoods are compared.  Words are runs of letters, lower-cased.  The discount is the one with the least
log loss on documents that the models haven't seen, weighted as the classes are among all labels.

The models are fitted on a bounded sample of labelled documents: in each slot of a hash, the
document with the least one.  Scoring is a single pass over all whole texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_mod, small_batches

U = tc.U
DISCOUNT = 0.75
#: Discounts to choose from, in standard deviations of a class's expected count.
KAPPAS = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0)
#: Toxic documents that are used for fitting, at most; half as many again of the ordinary ones.
SLOTS = 2048

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(97, 123)) + list(range(65, 91)) + list(range(128, 256))] = True


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (letters and all bytes over 127) and each document's first word."""
    plain = np.where(_LETTER[data], tc.lower_ascii(data), np.uint8(32))
    return tc.word_hashes(plain, bounds)


def _pairs(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it in its document (a fixed start for a first one)."""
    before = _before(words, firsts)
    with np.errstate(over="ignore"):
        return tc.mix(before * U(0x9E3779B97F4A7C15) ^ words)


def _before(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.zeros_like(words)
    out[1:] = words[:-1]
    out[firsts[:-1][firsts[:-1] < len(words)]] = U(0x1234567)
    return out


def _once(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of each value in each document."""
    order = np.lexsort((x, doc))
    same = (x[order][1:] == x[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order[np.concatenate(([True], ~same))] if len(x) else order


class Counts:
    """In how many distinct texts of each class (toxic first) each word and pair is, and what pairs begin and end with."""

    def __init__(self, texts: list[list[bytes]]):
        words, pairs, ends, starts = [], [], [], []
        for group in texts:
            group = list(dict.fromkeys(group))
            data = np.frombuffer(b"".join(group), dtype=np.uint8)
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in group]))).astype(np.int64)
            w_once, p_once, p_end, p_start = [], [], [], []
            for i, j in tc.chunks(bounds):
                w, firsts = _words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                doc = np.repeat(np.arange(j - i), np.diff(firsts))
                w_once.append(w[_once(w, doc)])
                p = _pairs(w, firsts)
                at = _once(p, doc)
                p_once.append(p[at])
                p_end.append(w[at])
                p_start.append(_before(w, firsts)[at])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=U)
            words.append(cat(w_once))
            pairs.append(cat(p_once))
            ends.append(cat(p_end))
            starts.append(cat(p_start))
        self.totals = np.array([len(w) for w in words], dtype=np.float64)
        self.words, at = np.unique(np.concatenate(words), return_inverse=True)
        self.of_words = self._by_class(at, words, len(self.words))
        self.pairs, first, at = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
        self.of_pairs = self._by_class(at, pairs, len(self.pairs))
        self.end = np.searchsorted(self.words, np.concatenate(ends)[first])
        self.start, self.started = _find(self.words, np.concatenate(starts)[first])

    @staticmethod
    def _by_class(at: np.ndarray, lists: list[np.ndarray], n: int) -> np.ndarray:
        cut = len(lists[0])
        return np.stack([np.bincount(at[:cut], minlength=n), np.bincount(at[cut:], minlength=n)]).astype(np.float64)


def _discounted(own: np.ndarray, share: np.ndarray, kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """Class counts (2 rows) as expected (share of the first class of both together) plus the discounted difference, and where one is left."""
    both = own.sum(axis=0)
    expected = both * share
    gap = own[0] - expected
    left = np.maximum(np.abs(gap) - np.maximum(kappa * np.sqrt(both * share * (1 - share)), DISCOUNT), 0) * np.sign(gap)
    return np.stack([expected + left, both - expected - left]), left != 0


class KneserNey:
    """Interpolated models of two classes, as sorted arrays of the hashes of words and pairs whose log ratio isn't that of what they
    back off to (0 for words: both classes share it; their second word's for pairs)."""

    def __init__(self, counts: Counts, kappa: float):
        total = max(1.0, counts.totals.sum())
        rate = float(np.clip(counts.totals[0] / total, 1e-9, 1 - 1e-9))
        of_words, moved = _discounted(counts.of_words, np.full(len(counts.words), rate), kappa)
        # both classes leave the same share to how many distinct pairs a word ends
        back = min(0.5, DISCOUNT * len(counts.words) / total)
        ends = np.bincount(counts.end, minlength=len(counts.words)) if len(counts.end) else np.zeros(len(counts.words))
        shared = (ends + 1.0) / (len(counts.end) + len(counts.words) + 1.0)
        p = (1 - back) * of_words / np.array([[rate], [1 - rate]]) / total + back * shared
        self.words, self.ratio = counts.words[moved], np.log(p[0, moved] / p[1, moved])
        # a pair is expected as often as its first word is of a class and its second one follows there
        before = np.where(counts.started, of_words[:, counts.start], np.array([[rate], [1 - rate]])) if len(counts.pairs) else np.zeros((2, 0))
        weight = before * p[:, counts.end]
        of_pairs, moved = _discounted(counts.of_pairs, weight[0] / np.maximum(weight.sum(axis=0), 1e-300), kappa)
        self.pairs = counts.pairs[moved]
        self.pair_ratio = np.log(of_pairs[0, moved] / of_pairs[1, moved]) - np.log(before[0, moved] / before[1, moved])
        self.slope, self.bias = 1.0, 0.0

    def log_ratios(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document: log-likelihood ratio (toxic against ordinary) per word, and the number of words."""
        w, firsts = _words(data, bounds)
        n = np.diff(firsts)
        r = np.zeros(len(w))
        if len(w) and len(self.words):
            at, hit = _find(self.words, w)
            r = np.where(hit, self.ratio[at], 0.0)
        if len(w) and len(self.pairs):
            at, hit = _find(self.pairs, _pairs(w, firsts))
            r = np.where(hit, self.pair_ratio[at], r)
        return tc.group_sums(r, firsts) / np.maximum(n, 1), n

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        r, n = self.log_ratios(data, bounds)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.where(n > 0, r, 0.0) + self.bias, -500, 500)))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a weighted one-variable logistic regression by Newton's method, lightly regularised."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * b * [1, 0]
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def sample_by_slot(rows: DataFrame, label: str, slots: Column, key: Column) -> DataFrame:
    """At most `slots` rows of each label: the one with the least hash in each slot.  rows: (doc_id, label)."""
    h = rows.withColumn("_h", F.xxhash64(key, F.lit(5))).withColumn("_slot", F.pmod("_h", slots))
    return h.groupBy(label, "_slot").agg(F.min(F.struct("_h", "doc_id")).alias("m")).select(label, F.col("m.doc_id").alias("doc_id"))


def _ratios(model: KneserNey, texts: list[bytes]) -> np.ndarray:
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out = [model.log_ratios(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])[0] for a, b in tc.chunks(bounds)]
    return np.concatenate(out) if out else np.zeros(0)


def fit_texts(groups: list[list[bytes]], sizes: tuple[int, int]) -> KneserNey | None:
    """A calibrated model of toxic and ordinary texts; None if there are none of one.  sizes: how many labels each class has."""
    if not all(groups):
        return None
    # judged and calibrated on each third of the sample by models of the other two, then fitted on all
    parts = [[g[i::3] for i in range(3)] for g in groups]
    x: dict[float, list[np.ndarray]] = {k: [] for k in KAPPAS}
    y: list[np.ndarray] = []
    for i in range(3):
        rest = [[t for j in range(3) if j != i for t in g[j]] for g in parts]
        if not all(rest):
            continue
        counts = Counts(rest)
        for kappa in KAPPAS:
            model = KneserNey(counts, kappa)
            x[kappa] += [_ratios(model, g[i]) for g in parts]
        y += [np.full(len(g[i]), float(label)) for label, g in zip((1, 0), parts, strict=True)]
    if not y:
        return KneserNey(Counts(groups), KAPPAS[-1])
    # weighted as the classes are among all labels
    truth = np.concatenate(y)
    weight = np.where(truth == 1, sizes[0] / len(groups[0]), sizes[1] / len(groups[1]))
    weight /= weight.mean()
    lines = {k: _logistic(np.concatenate(v), truth, weight) for k, v in x.items()}
    loss = lambda k: float((weight * np.logaddexp(0, np.where(truth == 1, -1, 1) * (lines[k][0] * np.concatenate(x[k]) + lines[k][1]))).mean())
    best = min(KAPPAS, key=loss)
    model = KneserNey(Counts(groups), best)
    model.slope, model.bias = lines[best]
    return model


PARTS = ("words", "ratio", "pairs", "pair_ratio", "slope", "bias")


def _fit_rows(sizes: tuple[int, int]):
    def rows(batches):
        groups: list[list[bytes]] = [[], []]
        for batch in batches:
            for y, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                groups[1 - y].append(t.encode())
        model = fit_texts(groups, sizes)
        raw = pickle.dumps(tuple(getattr(model, k) for k in PARTS)) if model else None
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["model"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, train: Column, slots: int = SLOTS) -> KneserNey | None:
    """Fit on at most `slots` toxic and half as many again ordinary documents, in one task; None if a class has none.

    Only the model comes to the driver: the expressions of the sample that have counts of their own."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(train)
    present = docs.select("doc_id").where(train)
    of_class = F.when(F.col("toxic") == 1, slots).otherwise(slots + slots // 2).cast("long")
    chosen = sample_by_slot(known.join(present, "doc_id", "left_semi"), "toxic", of_class, F.col("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # at most 2.5 * slots ids, and one text for each, however many rows an id has
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id"))
    out = rows.repartition(1).sortWithinPartitions("h", "toxic").select("toxic", "text").mapInArrow(tc.releasing(_fit_rows((sizes.get(1, 0), sizes.get(0, 0)))), "model binary").collect()
    if not out or out[0].model is None:
        return None
    model = object.__new__(KneserNey)
    for k, v in zip(PARTS, pickle.loads(bytes(out[0].model)), strict=True):
        setattr(model, k, v)
    return model


def _score_rows(model: KneserNey | None, keep_text: bool):
    def rows(batches):
        for batch in batches:
            data, bounds = tc.column_bytes(batch.column("text"))
            out = [model.scores(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in tc.chunks(bounds)] if model else [np.zeros(len(bounds) - 1)]
            score = np.concatenate(out) if out else np.zeros(0)
            rest = batch.schema.names if keep_text else [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*rest, "score", "predicted"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, slots: int = SLOTS, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: `columns`, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Labels of documents whose crc32(doc_id as text) mod held_out_mod is 0 are never used.  Empty and
    null texts, and texts without letters, have the score of a log ratio of 0.  Without labels of both
    classes every score is 0.  Rows with a null id are scored and belong to the held-out
    part (crc32 of the empty text is 0); repeated rows are each scored; other columns are ignored."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, crc_mod("doc_id", held_out_mod) != 0, slots)
    base = docs.select(*(F.col(f"`{c}`") for c in columns), (crc_mod("doc_id", held_out_mod) == 0).alias("held_out"), *([] if "text" in columns else ["text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return base.mapInArrow(tc.releasing(_score_rows(model, "text" in columns)), f"{kinds}, held_out boolean, score double, predicted int")
