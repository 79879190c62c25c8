"""Language identification of words by a linear-chain conditional random field.

A word's features are its hash (the lexicon), its first and last one to three bytes and
its byte bi- and trigrams, all hashed into one weight table; transitions between the languages
of neighbouring words are learned with them.  Forward-backward gives every word's
posterior, so code-switched text gets a language per word; a text's is the one with
the largest mean posterior.

Forward-backward runs over many documents at once.  Words are laid out in segments of 32;
the transition products of all segments are made step by step in numpy, a short pass over
the segments of each document carries the messages across, and a second pass fills in the words.
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
BITS = 16
SEGMENT = 32
#: Documents of each language that are used for fitting, at most.
SLOTS = 192
#: Documents that are used for fitting in all, at most (but for one of each language).
SAMPLE = 12_288


class Words:
    """Words of some documents, and the features of the distinct ones among them: the weight-table
    rows of lexicon entry and affixes, and those of the n-grams."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.start, self.end, self.firsts = tc.word_spans(data, bounds)
        h = tc.prefix_hash(data)
        mask = U((1 << BITS) - 1)
        whole, one, self.kind = np.unique(tc.span_hash(h, self.start, self.end), return_index=True, return_inverse=True)
        start, end = self.start[one], self.end[one]
        size = end - start
        cols = [whole]
        for k in (1, 2, 3):
            kind = U(k * 0x51ED27)
            cols.append(tc.mix(tc.span_hash(h, start, np.minimum(start + k, end)) ^ kind))
            cols.append(tc.mix(tc.span_hash(h, np.maximum(end - k, start), end) ^ (kind << U(32))))
        self.rows = np.stack([(c & mask).astype(np.int32) for c in cols], axis=1)
        # n-grams inside words, listed by word
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size) + np.repeat(start, size)
        left = np.repeat(end, size) - at
        gram, owner = [], []
        for k in (2, 3):
            ok = left >= k
            gram.append((tc.mix(tc.span_hash(h, at[ok], at[ok] + k) ^ U(k * 0xABCD01)) & mask).astype(np.int32))
            owner.append(word[ok])
        self.gram, self.owner = np.concatenate(gram), np.concatenate(owner)
        self.scale = (1.0 / np.maximum(1, 2 * size - 3)).astype(np.float32)

    def __len__(self) -> int:
        return len(self.start)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Score of each language for each word (log domain)."""
        out = weights[self.rows[:, 0]].copy()
        for i in range(1, self.rows.shape[1]):
            out += weights[self.rows[:, i]]
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(self.owner, weights=weights[self.gram, k], minlength=len(out)).astype(np.float32) * self.scale
        return out[self.kind]


def posteriors(emission: np.ndarray, firsts: np.ndarray, transition: np.ndarray, begin: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over documents: word posteriors, expected transitions (summed, if expect), and the
    posteriors of first words.  emission: words x languages; transition[i, j]: from i to j; all in the log domain."""
    n, k = emission.shape
    counts = np.diff(firsts)
    filled = np.flatnonzero(counts > 0)
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros((0, k))
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    t, b0 = np.exp(transition), np.exp(begin)
    # segments of the words of a document, the last one filled up with neutral words
    segs = -(-counts[filled] // SEGMENT)
    seg_first = np.concatenate(([0], np.cumsum(segs)))
    s = int(seg_first[-1])
    doc_of = np.repeat(np.arange(len(filled)), segs)
    offset = (np.arange(s) - seg_first[doc_of]) * SEGMENT
    base = firsts[filled][doc_of] + offset
    size = np.minimum(SEGMENT, counts[filled][doc_of] - offset)
    place = np.minimum(base[:, None] + np.arange(SEGMENT), n - 1)
    real = np.arange(SEGMENT) < size[:, None]
    x = np.where(real[..., None], e[place], 1.0)
    eye = np.eye(k)
    # products over each segment: the message before its first word to that after its last
    prod = np.broadcast_to(eye, (s, k, k)).copy()
    for j in range(SEGMENT):
        new = (prod.reshape(-1, k) @ t).reshape(s, k, k) * x[:, j, None, :]
        prod = np.where(real[:, j, None, None], new, prod)
        if j % 8 == 7:
            prod /= prod.max(axis=(1, 2), keepdims=True)
    # messages into each segment; a document's first word comes from a begin state instead
    alpha_in, beta_in = np.ones((s, k)), np.ones((s, k))
    level = np.arange(s) - seg_first[doc_of]
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(level.max() + 2))
    # forward: the first segment is run from the begin state step by step
    alpha = np.zeros((s, SEGMENT, k))
    first_ids = np.flatnonzero(level == 0)
    a = np.broadcast_to(b0, (len(first_ids), k)) * x[first_ids, 0]
    a = a / a.sum(axis=1, keepdims=True)
    run = a
    for j in range(1, SEGMENT):
        step = (run @ t) * x[first_ids, j]
        run = np.where(real[first_ids, j, None], step / step.sum(axis=1, keepdims=True), run)
    out_of = np.zeros((s, k))
    out_of[first_ids] = run
    for lv in range(1, int(level.max()) + 1):
        ids = order[edges[lv] : edges[lv + 1]]
        alpha_in[ids] = out_of[ids - 1]
        v = np.einsum("si,sij->sj", alpha_in[ids], prod[ids])
        out_of[ids] = v / v.sum(axis=1, keepdims=True)
    last = np.append(doc_of[1:] != doc_of[:-1], True)
    for lv in range(int(level.max()), -1, -1):
        ids = order[edges[lv] : edges[lv + 1]]
        ids = ids[~last[ids]]
        if len(ids):
            v = np.einsum("sij,sj->si", prod[ids + 1], beta_in[ids + 1])
            beta_in[ids] = v / v.max(axis=1, keepdims=True)
    # within the segments, all at once
    for j in range(SEGMENT):
        before = alpha_in if j == 0 else alpha[:, j - 1]
        step = (before @ t) * x[:, j]
        if j == 0:
            step[first_ids] = b0 * x[first_ids, 0]
        step /= step.sum(axis=1, keepdims=True)
        alpha[:, j] = np.where(real[:, j, None], step, before)
    gamma = np.zeros((s, SEGMENT, k))
    expected = np.zeros((k, k))
    beta = beta_in
    for j in range(SEGMENT - 1, -1, -1):
        g = alpha[:, j] * beta
        gamma[:, j] = g / g.sum(axis=1, keepdims=True)
        right = x[:, j] * beta
        if expect:
            before = alpha_in if j == 0 else alpha[:, j - 1]
            pair = before[:, :, None] * t * right[:, None, :]
            use = real[:, j] if j else real[:, j] & (level > 0)
            pair = pair[use]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = right @ t.T
        beta = np.where(real[:, j, None], new / new.max(axis=1, keepdims=True), beta)
    return gamma[real], expected, gamma[first_ids, 0]


class ChainField:
    """Weights of the field for a sorted list of languages."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((1 << BITS, k), dtype=np.float32)
        self.transition, self.begin = np.zeros((k, k)), np.zeros(k)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> ChainField:
        """Maximise the likelihood of labelling all words of a text with its language (Adagrad, L2)."""
        k = len(self.languages)
        rng = np.random.RandomState(seed)
        groups = [np.sort(p) for p in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch))]
        square, t_square, b_square = np.full_like(self.weights, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        for _ in range(epochs):
            for ids in groups:
                bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in ids]))).astype(np.int64)
                words = Words(np.frombuffer(b"".join(texts[i] for i in ids), dtype=np.uint8), bounds)
                if not len(words):
                    continue
                n = len(words)
                gamma, expected, first = posteriors(words.emissions(self.weights), words.firsts, self.transition, self.begin)
                counts = np.diff(words.firsts)
                y = np.repeat(labels[ids], counts)
                error = (np.eye(k)[y] - gamma).astype(np.float32)
                grad = np.zeros_like(self.weights)
                for c in range(k):
                    by_word = np.bincount(words.kind, weights=error[:, c], minlength=len(words.rows))
                    for i in range(words.rows.shape[1]):
                        grad[:, c] += np.bincount(words.rows[:, i], weights=by_word, minlength=len(grad))
                    grad[:, c] += np.bincount(words.gram, weights=(by_word * words.scale)[words.owner], minlength=len(grad))
                grad = grad / n - decay * self.weights
                square += grad**2
                self.weights += rate * grad / np.sqrt(square)
                seen = np.zeros((k, k))
                np.add.at(seen, (labels[ids], labels[ids]), np.maximum(counts - 1, 0))
                g = (seen - expected) / n - decay * self.transition
                t_square += g**2
                self.transition += rate * g / np.sqrt(t_square)
                g = (np.eye(k)[labels[ids][counts > 0]] - first).sum(axis=0) / n - decay * self.begin
                b_square += g**2
                self.begin += rate * g / np.sqrt(b_square)
        # a switch keeps some probability, however single-minded the training texts are
        self.transition = np.maximum(self.transition, self.transition.max() - 8.0)
        return self

    def label_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Words]:
        words = Words(data, bounds)
        return posteriors(words.emissions(self.weights), words.firsts, self.transition, self.begin, expect=False)[0], words


def _lower(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def _fit_rows(languages: list[str]):
    def rows(batches):
        texts, labels = [], []
        for batch in batches:
            texts += [t.lower().encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            labels += batch.column("label").to_pylist()
        place = {x: k for k, x in enumerate(languages)}
        state = ChainField(languages).fit(texts, np.array([place[x] for x in labels], dtype=np.int64)).__dict__ if texts else None
        yield pa.RecordBatch.from_arrays([pa.array([state and pickle.dumps(state)], pa.binary())], names=["model"])

    return rows


def fit(docs: DataFrame, train: Column, slots: int = SLOTS, sample: int = SAMPLE) -> ChainField | None:
    """Fit, in one task, on at most `slots` documents of each language (those with the least hash in each slot), and on at most
    `sample` in all: with many languages each has fewer slots, one at least.  Every language of the training rows is learned."""
    known = docs.select("doc_id", "lang").where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    slots = max(1, min(slots, sample // len(languages)))
    h = known.withColumn("_h", F.xxhash64("doc_id", F.lit(11))).withColumn("_slot", F.pmod("_h", F.lit(slots)))
    chosen = h.groupBy("lang", "_slot").agg(F.min(F.struct("_h", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"), F.col("lang").alias("label"))
    # at most max(sample, languages) ids, and one text for each and label
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id"))
    out = rows.repartition(1).sortWithinPartitions("h", "label").select("label", "text").mapInArrow(tc.releasing(_fit_rows(languages)), "model binary").collect()
    if not out or out[0].model is None:
        return None
    model = ChainField(languages)
    model.__dict__.update(pickle.loads(bytes(out[0].model)))
    return model


def _predict_rows(model: ChainField | None):
    def rows(batches):
        for batch in batches:
            column = batch.column("text")
            langs, scores = [], []
            _, bounds = tc.column_bytes(column)
            for i, j in tc.chunks(bounds):
                texts = column.slice(i, j - i).to_pylist()
                data, at = _lower(texts)
                if model is None:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                gamma, words = model.label_words(data, at)
                counts = np.diff(words.firsts)
                mean = np.stack([tc.group_sums(gamma[:, k], words.firsts) for k in range(len(model.languages))], axis=1) / np.maximum(counts, 1)[:, None]
                best = mean.argmax(axis=1)
                ascii_letters = tc.group_sums(((data >= 97) & (data <= 122)).astype(np.int64), at)
                for k, t in enumerate(texts):
                    if ascii_letters[k] or any(c.isalpha() for c in t or ""):
                        langs.append(model.languages[best[k]])
                        scores.append(float(min(1.0, max(0.0, mean[k, best[k]]))))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return rows


def identify_languages(docs: DataFrame, held_out_mod: int = 3, held_out: int = 1, slots: int = SLOTS) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score (mean posterior of the language over the words).

    Learned from text and non-null lang of documents whose crc32(doc_id as text) mod
    held_out_mod is not held_out.  A null text, or one without a letter, is `und` with score 0, and
    so is every text if there is nothing to learn from.  Rows without an id are answered but not
    learned from; repeated rows are each answered (and are one document in learning); a text of any length is read whole; of languages with
    equal posteriors the first by name is given; other columns, whatever their names, are ignored, and an empty table gives no rows."""
    small_batches(docs.sparkSession)
    model = fit(docs, crc_mod("doc_id", held_out_mod) != held_out, slots)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", (crc_mod("doc_id", held_out_mod) == held_out).alias("held_out"), "text")
    return base.mapInArrow(_predict_rows(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: ChainField) -> DataFrame:
    """A language for every word of code-switched text: doc_id, position, word, lang, score."""

    def rows(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            _, bounds = tc.column_bytes(column)
            for i, j in tc.chunks(bounds, 1 << 18):
                data, at = _lower(column.slice(i, j - i).to_pylist())
                gamma, words = model.label_words(data, at)
                if not len(words):
                    continue
                counts = np.diff(words.firsts)
                raw = data.tobytes()
                best = gamma.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), counts))),
                        pa.array(np.concatenate([np.arange(c) for c in counts]), pa.int64()),
                        pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(words.start, words.end, strict=True)], pa.string()),
                        pa.array([model.languages[k] for k in best], pa.string()),
                        pa.array(np.minimum(1.0, gamma[np.arange(len(best)), best]), pa.float64()),
                    ],
                    names=["doc_id", "position", "word", "lang", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, position long, word string, lang string, score double")
