"""The pipeline's stages against brute force on a small table."""

import collections
import itertools
import os

import corpus_pipeline
import duckdb
from test_operators import covered, shingles, spans_of
from tidemark.llm.common import table
from tidemark.llm.mixing import mix_sql
from tidemark.llm.packing import default_tokenizer
from tokenizers import Tokenizer


def test_stages_in_order(spark, tiny):
    docs = table(spark, tiny, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_array_dedup", "mixing", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.toxicity(spark, docs, tiny)
    assert clean.columns == docs.columns
    one = corpus_pipeline.near_dedup(spark, clean, tiny)
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == docs.columns
    assert len(set(kept.values())) == len(kept)
    assert all(before[i] == t for i, t in kept.items())
    sets = {i: shingles(t) for i, t in ((r.doc_id, r.text) for r in clean.collect())}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    assert set(kept) == {i for i in up if top(i) == i}
    cut = corpus_pipeline.suffix_array_dedup(spark, one, tiny)
    assert set(cut.columns) == set(docs.columns)
    texts = {r.doc_id: r.text for r in cut.collect()}
    order = sorted(kept)
    raw = [kept[i].encode() for i in order]
    want = {}
    for i, t, gone in zip(order, raw, covered(raw, 101), strict=True):
        spans = spans_of(t, gone, 51)
        rest = b"".join(t[a:b] for a, b in zip([0, *(j for _, j in spans)], [*(i for i, _ in spans), len(t)], strict=True)).decode("utf-8", "ignore")
        if rest or not spans:
            want[i] = rest
    assert texts == want
    assert want != {i: kept[i] for i in want}
    cut = spark.createDataFrame(cut.toPandas(), docs.schema)
    mixed = corpus_pipeline.mixing(spark, cut, tiny)
    assert mixed.columns == docs.columns
    con = duckdb.connect()
    con.register("documents", cut.toPandas())
    epochs = {i: n for i, n in con.sql(f"select doc_id, epochs from ({mix_sql()}) where epochs > 0").fetchall()}
    rows = mixed.collect()
    assert collections.Counter(r.doc_id for r in rows) == epochs
    tok = Tokenizer.from_file(default_tokenizer())
    tokens = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}
    packed = corpus_pipeline.packing(spark, mixed, tiny).collect()
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.length
        assert r.doc_tokens == tokens[r.doc_id]
    assert got == {i: tokens[i] * n for i, n in epochs.items()}


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    rows = out.collect()
    assert rows
    assert os.path.basename(tiny) == "sf0.001"
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 4096


def test_empty(spark, tiny):
    docs = table(spark, tiny, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0


def test_odd_rows(spark, tiny):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns in every stage."""
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "x y", None, None, None), (None, None, None, None, None), (2, None, "en", "s", None), (3, "", None, "s", 0), (4, "w " * 60_000, "de", None, 120_000), (5, "é" * 30_000, "fr", "t", 30_000)]
    docs = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rid int, row string, score double")
    kept = corpus_pipeline.toxicity(spark, docs, tiny)
    assert kept.count() == len(rows)
    one = corpus_pipeline.near_dedup(spark, kept, tiny)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]
    cut = corpus_pipeline.suffix_array_dedup(spark, one, tiny)
    # text 4 repeats itself throughout and goes, text 5 does too but is one word; empty ones stay
    assert sorted((r.doc_id or 0, r.text) for r in cut.collect()) == [(0, ""), (0, "x y"), (1, "a b c"), (2, ""), (3, ""), (5, "é" * 30_000)]
    mixed = corpus_pipeline.mixing(spark, cut, tiny)
    assert set(mixed.columns) == set(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.packing(spark, mixed, tiny).count() >= 0


def test_near_dedup_threshold(spark, tiny):
    """Texts that have 0.82 of their shingles of five words in common are near copies; at 0.78 they aren't."""
    base = [f"w{i}" for i in range(495)]

    def changed(n):
        """The last n words replaced: as many of the 491 shingles are, on either side."""
        return base[: len(base) - n] + [f"x{n}y{i}" for i in range(n)]

    def jaccard(a, b):
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    near, far = changed(48), changed(61)
    assert 0.815 < jaccard(base, near) < 0.825 and 0.775 < jaccard(base, far) < 0.785
    other = ["v" + w for w in base]
    rows = [(1, base), (2, near), (11, other), (12, ["v" + w for w in far])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, tiny).collect()) == [1, 11, 12]


def test_short_words_make_a_passage(spark, tiny):
    """52 words in 110 bytes, in two documents; 50 words aren't a passage."""
    passage = " ".join(["a", "b", "c", "d"] * 12 + ["eee", "fff", "ggg", "hh"])
    assert len(passage) == 110 and len(passage.split()) == 52
    few = " ".join(f"{chr(97 + k % 26)}{k % 7}" for k in range(50))
    texts = [f"one starts {passage} here", f"two begins {passage} there", f"three {few} x1", f"four {few} y2"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, tiny).collect()}
    assert passage not in out[0] and passage not in out[1] and len(out[0]) < 20
    assert out[2] == texts[2] and out[3] == texts[3]
