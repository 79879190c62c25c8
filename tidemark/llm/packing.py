"""Packing examples into sequences by vector bin packing.

An example has three sizes: tokens, one segment, and tokens that bear loss (its first ones, its context, don't).
A sequence is filled by the dot-product heuristic: of the waiting examples that fit in what is left, the one whose sizes
have the largest inner product with what is left (all as shares of the limits) comes next.
When none fits, an example is cut to fill the sequence.  An example longer than a sequence is cut at once: each
of its sequences takes as much of it as the limits allow, and is then filled like any other.
Each task packs its own partition with a bounded number of waiting examples, each shorter than a sequence; at its
end the rest goes into sequences whose lengths are powers of two, which need no padding either.

Token ids come from a public tokenizer, word by word: words are split at ASCII white space, which the
tokenizer drops and never merges across, and ASCII punctuation at a word's end is a word of its own.  Ids of
distinct words are kept in sorted runs that are merged when they are alike in size; of too many, those
that were met least go.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import small_batches

#: Examples that wait at most, per task, and how many of them are left waiting between batches.
POOL, REST = 1024, 512
#: Distinct words whose ids a worker keeps at most, and bytes of text that are looked up at once.
KEPT_WORDS = 400_000
CHUNK = 1 << 18
END_ID = 2

_PUNCT = np.zeros(256, dtype=bool)
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BAR = ord("|")
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


#: Letters a to z, and the lower-case ones of the Latin-1 supplement.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The characters by which byte-level vocabularies write bytes: printable ones are themselves, others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


def pieces_of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the punctuation at their ends split off, where the tokenizer splits it too: after an ASCII letter or
    digit, or a letter of the Latin-1 supplement."""
    if not len(start):
        return start, end, firsts
    last = np.maximum.accumulate(np.where(_PUNCT[data], -1, np.arange(len(data))))
    core = last[end - 1] + 1
    at = np.maximum(core - 1, 0)
    byte, before = data[at], data[np.maximum(at - 1, 0)]
    latin = (before == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7) & (at > start)
    # a bar may close a special token's name, which is one token
    cut = (core < end) & (core > start) & (_ALNUM[byte] | latin) & (data[np.minimum(core, len(data) - 1)] != _BAR)
    n = 1 + cut.astype(np.int64)
    to = np.cumsum(n) - n
    out_start, out_end = np.repeat(start, n), np.repeat(end, n)
    out_end[to[cut]] = core[cut]
    out_start[to[cut] + 1] = core[cut]
    return out_start, out_end, np.append(to, len(out_start))[firsts]


class WordIds:
    """Ids of words by a tokenizer, remembered by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: (hashes, place of the first id, number of ids, times met), by hash, from the longest run to the shortest
        self.runs: list[list[np.ndarray]] = []
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint16), 0

    def _store(self, ids: np.ndarray) -> int:
        """Where some ids are kept from now on."""
        if ids.max(initial=0) > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(self.used + len(ids) + (1 << 16), dtype=self.ids.dtype)))
        at, self.used = self.used, self.used + len(ids)
        self.ids[at : self.used] = ids
        return at

    def _tokenize(self, words: list[bytes]) -> list[list[int]]:
        """A word of nothing but lower-case letters is left as it is by all steps before the tokenizer's model, which can
        then be asked alone."""
        model = self.tokenizer.model
        ids: list = [[t.id for t in model.tokenize(w.decode("latin-1").translate(_BYTE_LEVEL))] if _LETTERS.fullmatch(w) else None for w in words]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return ids

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """hashes: sorted, none of them known."""
        ids = self._tokenize(words)
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=int(size.sum()))
        offset = self._store(flat) + np.cumsum(size, dtype=np.int64) - size
        self.runs.append([hashes, offset, size, np.zeros(len(hashes), dtype=np.int32)])
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            merged = [np.concatenate(x) for x in zip(*self.runs[-2:], strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.runs[-2:] = [[x[order] for x in merged]]

    def _forget(self) -> None:
        """Keep the half of the words that was met most (of equal ones, that with the least hash)."""
        hashes, offset, size, met = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        keep = np.sort(np.lexsort((hashes, -met))[: KEPT_WORDS // 2])
        keep = keep[np.argsort(hashes[keep])]
        place = np.repeat(offset[keep] - (np.cumsum(size[keep]) - size[keep]), size[keep]) + np.arange(size[keep].sum())
        self.ids = self.ids[place]
        self.used = len(self.ids)
        self.runs = [[hashes[keep], np.cumsum(size[keep], dtype=np.int64) - size[keep], size[keep], met[keep] // 2]]

    def _look_up(self, unique: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of words, and which of them aren't known."""
        offset, size = np.zeros(len(unique), dtype=np.int64), np.full(len(unique), -1, dtype=np.int32)
        open_ = np.arange(len(unique))
        for hashes, places, sizes, met in self.runs:
            at = np.minimum(np.searchsorted(hashes, unique[open_]), len(hashes) - 1)
            hit = hashes[at] == unique[open_]
            offset[open_[hit]], size[open_[hit]] = places[at[hit]], sizes[at[hit]]
            met[at[hit]] += counts[open_[hit]]
            open_ = open_[~hit]
        return offset, size, open_

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some documents, each followed by END_ID, and each document's first."""
        start, end, firsts = pieces_of_words(data, *tc.word_spans(data, bounds))
        # the tokenizer lower-cases, but for special tokens; words of ASCII only can be looked up lower-cased
        wide = np.concatenate(([0], np.cumsum((data > 127) | (data == _BAR))))
        foreign = wide[end] > wide[start]
        word = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(word, start[foreign], 1)
        np.add.at(word, end[foreign], -1)
        inside = np.cumsum(word[:-1]) > 0
        plain = np.where(inside, data, tc.lower_ascii(data))
        h = tc.span_hash(tc.prefix_hash(plain), start, end)
        unique, first, back, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        offset, size, new = self._look_up(unique, counts)
        if len(new):
            if sum(len(r[0]) for r in self.runs) + len(new) > KEPT_WORDS and self.runs:
                self._forget()
                offset, size, new = self._look_up(unique, np.zeros_like(counts))
            raw = plain.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            offset, size, _ = self._look_up(unique, np.zeros_like(counts))
        size, offset = size[back].astype(np.int64), offset[back]
        total = int(size.sum())
        place = np.repeat(offset - (np.cumsum(size) - size), size) + np.arange(total)
        token_first = np.concatenate(([0], np.cumsum(size)))[firsts]
        return np.insert(self.ids[place].astype(np.uint32), token_first[1:], np.uint32(END_ID)), token_first + np.arange(len(token_first))


def word_ids(path: str) -> WordIds:
    """The worker's own memory of a tokenizer.  This module may travel to executors by value, anew for each task, so
    the memory lives in a module of the worker's process."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__.setdefault("word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


class Packer:
    """Fills sequences from waiting examples.  An example is (key, start, tokens, loss): tokens start..start + tokens
    of what key names, of which the last `loss` bear loss."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limit = np.array([tokens, segments, loss], dtype=np.float64)
        self.keys: list = [None] * POOL * 2
        self.sizes = np.zeros((POOL * 2, 3))
        self.sizes[:, 1] = 1
        self.starts = np.zeros(POOL * 2, dtype=np.int64)
        self.n = 0

    def add(self, key, start: int, tokens: int, loss: int) -> None:
        self.keys[self.n] = key
        self.sizes[self.n, 0], self.sizes[self.n, 2] = tokens, loss
        self.starts[self.n] = start
        self.n += 1

    def _drop(self, i: int) -> None:
        self.n -= 1
        self.keys[i], self.sizes[i], self.starts[i] = self.keys[self.n], self.sizes[self.n], self.starts[self.n]
        self.keys[self.n] = None

    def _take(self, i: int, tokens: int) -> tuple:
        """The first tokens of example i; the rest keeps waiting."""
        size, loss = int(self.sizes[i, 0]), int(self.sizes[i, 2])
        piece = (self.keys[i], int(self.starts[i]), tokens)
        taken = max(0, tokens - (size - loss))
        if tokens == size:
            self._drop(i)
        else:
            self.starts[i] += tokens
            self.sizes[i, 0], self.sizes[i, 2] = size - tokens, loss - taken
        return piece, taken

    def fill(self, capacity: int, begun: tuple = (), loss: int = 0) -> list[tuple]:
        """One sequence of at most `capacity` tokens; begun: its first piece, which has `loss` loss-bearing tokens."""
        left = np.array([capacity, self.limit[1], self.limit[2]])
        pieces = []
        if begun:
            pieces.append(begun)
            left -= (begun[2], 1, loss)
        while self.n and left[0] >= 1 and left[1] >= 1:
            sizes = self.sizes[: self.n]
            fits = (sizes[:, 0] <= left[0]) & (sizes[:, 2] <= left[2])
            # the last segment has to fill the sequence, if an example is long enough
            if left[1] == 1 and (sizes[:, 0] >= left[0]).any():
                fits &= sizes[:, 0] == left[0]
            if fits.any():
                score = sizes @ (left / self.limit**2)
                i = int(np.where(fits, score, -1.0).argmax())
                tokens = int(sizes[i, 0])
            else:
                # cut: as much as the limits on tokens and loss allow
                most = np.minimum(np.minimum(sizes[:, 0], left[0]), sizes[:, 0] - sizes[:, 2] + left[2])
                i = int(most.argmax())
                tokens = int(most[i])
                if tokens < 1:
                    break
            piece, taken = self._take(i, tokens)
            pieces.append(piece)
            left -= (tokens, 1, taken)
        return pieces

    def flush(self):
        """Sequences for all that still waits: full ones, then powers of two."""
        while self.n:
            rest = int(self.sizes[: self.n, 0].sum())
            top = int(self.limit[0])
            yield self.fill(top if rest >= top else 1 << (rest.bit_length() - 1))


def pack_stream(examples, tokens: int, segments: int, loss: int):
    """(key, tokens, loss) examples -> sequences, each a list of pieces (key, start, tokens).

    The tokens of an example that bear no loss are its first ones."""
    packer = Packer(tokens, segments, loss)
    for key, size, bears in examples:
        start = 0
        while size - start >= tokens:
            free = max(0, size - start - bears)
            n = min(tokens, free + loss)
            yield packer.fill(tokens, (key, start, n), n - min(free, n))
            bears -= n - min(free, n)
            start += n
        if size > start:
            packer.add(key, start, size - start, min(bears, size - start))
        if packer.n >= POOL:
            while packer.n > REST:
                yield packer.fill(tokens)
    yield from packer.flush()


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def _pack_rows(path: str, tokens: int, segments: int, loss: int, context: int):
    def rows(batches):
        from pyspark import TaskContext

        words, base = word_ids(path), TaskContext.get().partitionId() << 33
        kind = None

        def examples():
            nonlocal kind
            for batch in batches:
                column = batch.column("doc_id")
                kind = column.type
                doc_ids = column.to_pylist()
                data, bounds = tc.column_bytes(batch.column("text"))
                for i, j in tc.chunks(bounds, CHUNK):
                    ids, first = words.encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    for k in range(j - i):
                        own = ids[first[k] : first[k + 1]].copy()
                        yield (doc_ids[i + k], own), len(own), max(0, len(own) - context)

        def packed(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc_id", *_COLUMNS])

        out: list[tuple] = []
        for n, sequence in enumerate(pack_stream(examples(), tokens, segments, loss)):
            offset = 0
            for (doc_id, ids), start, size in sequence:
                out.append((doc_id, start, size, zlib.crc32(ids[start : start + size]), len(ids), base + n, offset, size - max(0, min(context - start, size))))
                offset += size
            if len(out) >= 20_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return rows


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = 4096, segments: int = 64, loss: int = 4080, context: int = 16) -> DataFrame:
    """Pack whole documents: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids by the tokenizer and then id 2; a null or empty text is that id alone.  Each
    id is in exactly one piece.  A sequence holds at most `tokens` tokens, `segments` pieces and `loss`
    loss-bearing tokens (all of a document but its first `context`); pieces lie from offset 0 without gaps.
    A document longer than a sequence is cut; of waiting examples with equal scores the one that waits
    longest comes first.  Null ids are kept, repeated rows are each packed, other columns, whatever their names, are
    ignored, and an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _pack_rows(tokenizer or default_tokenizer(), tokens, segments, loss, context)
    return docs.select("doc_id", "text").mapInArrow(tc.releasing(rows), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COLUMNS))
