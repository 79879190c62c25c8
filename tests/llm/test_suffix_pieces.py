"""op1's second pass reads only what its first has found repeated."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup


def test_second_pass_reads_repeated_parts_only(spark, monkeypatch):
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, read, plain = own(90), [], suffix_dedup.repeated_starts

    def watched(docs, length):
        read.append(docs.agg(F.sum(F.octet_length("text"))).first()[0])
        return plain(docs, length)

    monkeypatch.setattr(suffix_dedup, "repeated_starts", watched)
    rows = [(i, own(3000) + passage + own(3000)) for i in range(4)] + [(4, own(3000) + passage[:50])]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 60, passage=40, passage_words=1).collect()
    assert [r.n_removed >= 90 for r in sorted(out)] == [True] * 4 + [False]
    assert read[0] > 24_000 and read[1] < 500


def test_cells_of_several_texts_are_those_of_each():
    rng = np.random.RandomState(8)
    for length in (12, 40, 400):
        texts = [rng.randint(97, 100, n).astype(np.uint8) for n in (length, length + 1, 3000, 700 + length, length)] + [np.full(900, 97, dtype=np.uint8)]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = suffix_dedup.cells(np.concatenate(texts), bounds, length)
        want = set()
        for i, t in enumerate(texts):
            core, extent, _, start, size, reach = suffix_dedup.cells(t, np.array([0, len(t)]), length)
            want |= set(zip(core.tolist(), extent.tolist(), [i] * len(core), start.tolist(), size.tolist(), reach.tolist(), strict=True))
            assert sorted(x for s, n in zip(start, size, strict=True) for x in range(s, s + n)) == list(range(len(t) - length + 1))
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want
