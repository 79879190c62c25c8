"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import embedding_dedup, language_id, minhash, mixing, packing, suffix_dedup, suffix_tree_lm, toxicity, transport_stream, url_filter
from tidemark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, start int, node long, key string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text):
    return text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(90))
    texts += [t + " " + passage for t in texts[:5]]
    texts += [texts[7]] * 4 + [texts[8] + " tail"]
    near = texts[3].split()
    for k in range(6):
        w = list(near)
        w[k * 3 % len(w)] = "zz"
        texts.append(" ".join(w))
    texts += ["", " \n\t ", None, "x", "É" * 700, "ab" * 900, "One\tTWO three", passage * 3]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], f"s{i % 4}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "r", 7, 9, "k") for r in corpus()]
    rows += [rows[2], (None, rows[4][1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


def covered(texts, length):
    """Which bytes of each text are covered by a string of so many bytes that starts twice or more."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


def spans_of(t, gone, words=0):
    edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
    at = [m.span() for m in WORD.finditer(t)]
    return [(i, j) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if sum(i <= a and b <= j for a, b in at) >= words]


@pytest.mark.parametrize("length, words, passage", [(400, 0, 0), (40, 0, 0), (400, 0, 240), (60, 12, 30)])
def test_suffix_dedup(spark, docs, length, words, passage):
    # all partitions of the sorted tables stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(length == 400).lower())
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = collections.Counter()
    shorter = covered([t for _, t in rows], passage) if passage else [None] * len(rows)
    for (i, t), gone, near in zip(rows, covered([t for _, t in rows], length), shorter, strict=True):
        spans = spans_of(t, gone, words)
        kept = b"".join(t[a:b] for a, b in zip([0, *(j for _, j in spans)], [*(i for i, _ in spans), len(t)], strict=True))
        row = [i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
        if passage:
            found = spans_of(t, near, 8)
            row += [len(found), sum(b - a for a, b in found)]
        want[tuple(row)] += 1
    out = suffix_dedup.suffix_dedup(docs, length, words=words, passage=passage, passage_words=8).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter(tuple(r) for r in out) == want
    assert sum(k[2] for k in want) > 0


def test_sorted_table_intervals():
    """Intervals of a sorted table, by depth, across partitions, against comparing all prefixes."""
    rng = random.Random(6)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in range(300)})
    cuts = [0, 1, 40, 41, 150, len(strings)]
    rows, summaries = [], []
    for part, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batches = [pa.RecordBatch.from_pydict({"s": strings[k : min(k + 16, j)], "key": list(range(k, min(k + 16, j))), "n": [1] * (min(k + 16, j) - k), "shallow": [2] * (min(k + 16, j) - k)}) for k in range(i, j, 16)]
        context = mock.Mock(**{"get.return_value.partitionId.return_value": part})
        with mock.patch("pyspark.TaskContext", context):
            for b in suffix_dedup._order_rows(12)(batches):
                for r in b.to_pylist():
                    (rows if r["key"] is not None else summaries).append(r)
    carry = suffix_dedup.carried(summaries, 12)
    for depth in range(2, 13):
        places = {}
        for r in rows:
            s = strings[r["key"]]
            if len(s) >= depth:
                place = int(suffix_dedup._places(np.array(r["depths"]), np.array(r["places"]), r["part"], carry, np.array([depth]))[0])
                places.setdefault(s[:depth], set()).add(place)
                if r["alone"] <= depth:
                    assert sum(x.startswith(s[:depth]) for x in strings) == 1
        assert all(len(v) == 1 for v in places.values())
        assert len({min(v) for v in places.values()}) == len(places)


def test_suffix_dedup_text(docs, nothing):
    out = suffix_dedup.suffix_dedup(docs, 40, columns=("doc_id", "lang"), with_text=True)
    for r in out.collect():
        if r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing, passage=240).columns[-2:] == ["n_passages", "passage_bytes"]


def shingles(text, size=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_minhash(docs, nothing):
    rows = docs.collect()
    sets = collections.defaultdict(list)
    for r in rows:
        sets[r.doc_id].append(shingles(r.text))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = minhash.minhash_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (top(r.doc_id), top(r.doc_id) == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert any(not r.kept for r in got)
    assert minhash.minhash_groups(nothing).count() == 0


def test_minhash_across_buckets(spark, monkeypatch):
    """A chain whose ends are not alike: the second look at mixed buckets must not lose links."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(130)]
    rows = []
    for k in range(40):
        w = list(words)
        for j in range(k):
            w[j * 3] = f"n{j}"
        rows.append((1000 + rng.randrange(10**6), " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 4)
    got = {r.doc_id: r.component_id for r in minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        s, t = shingles(s), shingles(t)
        if 100 * len(s & t) >= 85 * len(s | t):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i, _ in rows}


def test_register_estimate():
    rng = np.random.RandomState(3)
    for n, share in ((5000, 0.9), (400, 0.6), (4000, 0.0)):
        both = rng.randint(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.randint(0, 2**63, n - len(both)).astype(np.uint64)))) for _ in range(2))
        a, b = (np.unique(minhash.tc.mix(x)) for x in (a, b))
        true = len(both) / (2 * n - len(both))
        got = minhash.estimate((minhash.registers(a) == minhash.registers(b)).sum(), np.array(n))
        assert abs(got - true) < 4.5 * np.sqrt(max(true * (1 - true), 0.01) / 128)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    ids_of = collections.defaultdict(list)
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        ids_of[r.doc_id].append(ids)
        want[r.doc_id] += len(ids)
    out = packing.pack_documents(docs, tokens=64, segments=5, loss=40, context=3).collect()
    by_seq, got = collections.defaultdict(list), collections.Counter()
    for r in out:
        got[r.doc_id] += r.length
        by_seq[r.sequence_id].append(r)
        assert any(len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in ids_of[r.doc_id])
    assert got == want
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert len(pieces) <= 5
        assert sum(r.length for r in pieces) <= 64
        for r in pieces:
            assert r.loss_tokens == sum(1 for t in range(r.start, r.start + r.length) if t >= 3)
        assert sum(r.loss_tokens for r in pieces) <= 40
    assert max(sum(r.loss_tokens for r in pieces) for pieces in by_seq.values()) == 40
    assert packing.pack_documents(nothing).count() == 0


def test_packing_ids(monkeypatch):
    """Ids of odd words are the tokenizer's own, also while words are forgotten."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(3)
    odd = ["don't,", "it's.", "'s", "x's!?", "É!", "été,", "a×,", "€,", "<|endoftext|>", "<|ENDOFTEXT|>.", "abc<|endoftext|>,", "x|.", "...", "a.b.c.", "12,5%", "e\u0301.", "a\u0338,", "=\u0338", "\u00a0,", "ΑΣ.", "Σ,", "日本。", "日本,", "\x1c.", "ß)", "Ÿ;"]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.5 else "".join(rng.choice("abcXYZ09.,'é") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    monkeypatch.setattr(packing, "KEPT_WORDS", 1500)
    words = packing.WordIds(packing.default_tokenizer())
    for i in range(0, 200, 10):
        raw = [t.encode() for t in texts[i : i + 10]]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
        ids, first = words.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
        for k, t in enumerate(texts[i : i + 10]):
            assert ids[first[k] : first[k + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]
    assert sum(len(r[0]) for r in words.runs) <= 1500


@pytest.mark.parametrize("context", [1, 16])
def test_packing_has_little_padding(context):
    rng = random.Random(2)
    sizes = [rng.randint(1, 9000) for _ in range(3000)]
    seqs = list(packing.pack_stream(((i, n, max(0, n - context)) for i, n in enumerate(sizes)), 4096, 64, 4097 - context))
    used = [sum(p[2] for p in s) for s in seqs]
    assert sum(used) == sum(sizes)
    assert sum(0 if u & (u - 1) == 0 else 4096 - u for u in used) < 0.002 * sum(sizes)


def test_packing_keeps_loss_limit():
    rng = random.Random(4)
    items = [(i, rng.randint(1, 300)) for i in range(800)]
    items = [(i, n, rng.randint(0, n)) for i, n in items]
    loss = {i: (n, k) for i, n, k in items}
    seen = collections.Counter()
    for s in packing.pack_stream(iter(items), 256, 6, 90):
        assert len(s) <= 6
        assert sum(p[2] for p in s) <= 256
        assert sum(sum(1 for t in range(start, start + size) if t >= loss[key][0] - loss[key][1]) for key, start, size in s) <= 90
        for key, _, size in s:
            seen[key] += size
    assert seen == {i: n for i, n, _ in items}


def test_language_forward_backward():
    rng = np.random.RandomState(0)
    firsts = np.array([0, 3, 3, 7])
    e, t, b = rng.randn(7, 3).astype(np.float32), rng.randn(3, 3), rng.randn(3)
    gamma, expected, _ = language_id.posteriors(e, firsts, t, b)
    g, x = np.zeros((7, 3)), np.zeros((3, 3))
    for lo, hi in ((0, 3), (3, 7)):
        z, gg, xx = 0, np.zeros((hi - lo, 3)), np.zeros((3, 3))
        for p in itertools.product(range(3), repeat=hi - lo):
            w = np.exp(b[p[0]] + sum(e[lo + i, p[i]] for i in range(hi - lo)) + sum(t[p[i], p[i + 1]] for i in range(hi - lo - 1)))
            z += w
            for i in range(hi - lo):
                gg[i, p[i]] += w
            for i in range(hi - lo - 1):
                xx[p[i], p[i + 1]] += w
        g[lo:hi], x = gg / z, x + xx / z
    assert np.abs(g - gamma).max() < 1e-6
    assert np.abs(x - expected).max() < 1e-6


def test_language_id(spark, tiny, nothing):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 ... !"), (10**6 + 2, ""), (None, "le de la")], "doc_id long, text string")
    out = language_id.identify_languages(docs.unionByName(odd, allowMissingColumns=True)).toPandas()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = out[out.held_out & out.doc_id.isin(list(truth))]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.95
    assert set(out[out.doc_id >= 10**6].lang_pred) == {"und"}
    assert out.score.between(0, 1).all()
    assert language_id.identify_languages(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_language_words_in_mixed_text(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").where("lang in ('de', 'fr')").limit(120).collect()
    model = language_id.ChainField(["de", "fr"]).fit([r.text.lower().encode() for r in rows], np.array([["de", "fr"].index(r.lang) for r in rows]))
    de, fr = (" ".join(next(r.text for r in rows if r.lang == k and len(r.text) > 400).split()[:40]) for k in ("de", "fr"))
    out = language_id.label_words(spark.createDataFrame([(1, f"{de} {fr}")], "doc_id long, text string"), model).orderBy("position").collect()
    assert np.mean([r.lang == "de" for r in out[:40]]) > 0.9
    assert np.mean([r.lang == "fr" for r in out[40:]]) > 0.9


def test_lm_scores(docs, nothing):
    rows = docs.collect()
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in rows:
        t = tokens(r.text)
        want[(r.doc_id, held(r.doc_id), len(t), sum(w in c for w in t), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    got = suffix_tree_lm.score_texts(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 and np.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert suffix_tree_lm.score_texts(nothing).count() == 0


def test_lm_scores_by_brute_force(spark):
    """The whole model by dictionaries of tuples: symbols, states of up to three symbols, and scores."""
    rng = random.Random(12)
    phrases = [" ".join(rng.choice("abc") for _ in range(5)) for _ in range(7)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.6 else "".join(rng.choice("abxyz") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    least, depth = 4, 3
    got = suffix_tree_lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), depth=depth, least=least).collect()
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*WORD.findall(t.encode()), None]
    c = collections.Counter(w for t in train for w in tokens(t))
    kind = lambda w: (w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 7) % 64
    symbol = lambda w: ("end",) if w is None else (w,) if c[w] >= least else ("class", kind(w))
    n, once = collections.Counter(), collections.Counter()
    for w, k in c.items():
        if w is not None and k < least:
            n[kind(w)] += k
            once[kind(w)] += k == 1
    unseen = lambda k: (once[k] + 0.5) / (n[k] + 1)
    root = collections.Counter(symbol(w) for t in train for w in tokens(t))
    size = 64 + 1 + sum(k >= least for w, k in c.items() if w is not None)
    states, grams, allowed = [], None, None
    for order in range(1, depth + 1):
        now = collections.defaultdict(collections.Counter)
        for t in train:
            s = ["start", *map(symbol, tokens(t))]
            for i in range(order, len(s)):
                ctx = tuple(s[i - order : i])
                if allowed is None or ctx in allowed:
                    now[ctx][s[i]] += 1
        found = {}
        for ctx, nxt in now.items():
            short = root if order == 1 else grams[ctx[1:]]
            total, under = sum(nxt.values()), sum(short.values())
            if sum(k * (np.log(k / total) - np.log(short[x] / under)) for x, k in nxt.items()) > 2.0 * len(nxt):
                found[ctx] = {x: max(k - 0.75, 0) / total for x, k in nxt.items()}
        states.append(found)
        if not found:
            break
        grams, allowed = now, {(*ctx, x) for ctx, nxt in now.items() for x, k in nxt.items() if k >= least}
    assert len(states) == depth and all(states)
    for r in got:
        s, score = ["start", *map(symbol, tokens(texts[r.doc_id]))], 0.0
        for i, w in enumerate(tokens(texts[r.doc_id]), 1):
            p = (root[s[i]] + 1) / (sum(root.values()) + size)
            for order, found in enumerate(states, 1):
                state = found.get(tuple(s[i - order : i])) if i >= order else None
                if state is not None:
                    p = state.get(s[i], 0.0) + (1 - sum(state.values())) * p
            score += np.log10(p)
            if s[i][0] == "class":
                k = kind(w)
                score += np.log10(c[w] * (1 - unseen(k)) / max(n[k], 1)) if w in c else np.log10(unseen(k))
        assert abs(score - r.score) < 1e-6 * max(1, abs(score)), r


def test_lm_tree_sums_to_one():
    rng = np.random.RandomState(3)
    train = rng.randint(0, 3, 400) + 66
    firsts = np.array([0, len(train)])
    states = []
    for order in (1, 2):
        *_, (context, has) = suffix_tree_lm._contexts(train, firsts, order)
        keys = collections.Counter(zip(context[has].tolist(), train[has].tolist(), strict=True))
        n = collections.Counter(context[has].tolist())
        ctx, nxt = np.array(list(keys)).T
        states.append(suffix_tree_lm.state_arrays(ctx, nxt, np.array(list(keys.values()), dtype=float), np.array([n[x] for x in ctx.tolist()], dtype=float)))
    root = np.zeros(70)
    root[66:70] = 0.25
    for before in itertools.product((66, 67, 68, 69), repeat=2):
        p = sum(suffix_tree_lm.probability(root, states, np.array([*before, x]), np.array([0, 3]))[-1] for x in (66, 67, 68, 69))
        assert abs(p - 1) < 1e-12


def test_urls(spark):
    urls = ["http://a.com/en/1", "https://WWW.Example.COM/en/7x?q", "http://x.example.net/de/8", "ftp://net/de/", "no scheme", None, "", "http://org/es/", "http://org?x", "http://fine.org/casino", "http://fine.org/casinos", "http://fine.org/cheap-Win", "http://fine.org/cheap/cheap", "http://h.org/a\nb#c", "x://", "http://spam-farm.net/de/1", "http://xcom/en/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block")
    assert got[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("x.example.net", "/de/8", "example.net/de/8", "block")
    assert got[3] == ("net", "/de/", "net/de/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("org/es/", "block")
    assert got[8] == ("org", "", None, "allow")
    assert [got[i][3] for i in (9, 10, 11, 12)] == ["block", "allow", "block", "allow"]
    assert got[13] == ("h.org", "/a\nb", None, "allow")
    assert got[15] == ("spam-farm.net", "/de/1", "net/de/", "allow")
    assert got[16][2] is None
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    sql = {r[0]: r[1:5] for r in con.execute(f"select page_id, host, path, rule, verdict from ({url_filter.filter_sql()})").fetchall()}
    assert sql == got


def test_embeddings(spark):
    rng = np.random.RandomState(4)
    base = rng.randn(60, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[5] + 0.05 * rng.randn(16)).tolist()) for i in range(30)]
    rows += [(200 + i, (base[6] + 0.28 * k * rng.randn(16) / 8).tolist()) for i, k in enumerate(range(12))]
    rows += [(300, base[9].tolist()), (301, base[9].tolist()), (302, (2 * base[9]).tolist()), (303, None), (304, [0.0] * 16), (305, [float("nan")] * 16), (306, [1.0] * 15 + [None]), (307, []), (308, base[9][:8].tolist()), (309, (-base[9]).tolist()), (300, base[9].tolist())]
    got = embedding_dedup.embedding_groups(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, component string")).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, up = [0] * len(ok), {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(ok)), 2):
        x, y = ok[a][1], ok[b][1]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            links[a] += 1
            links[b] += 1
            p, q = top(ok[a][0]), top(ok[b][0])
            up[max(p, q)] = min(p, q)
    want = collections.Counter((ok[k][0], links[k], top(ok[k][0])) for k in range(len(ok)))
    want += collections.Counter((i, 0, i) for i in (303, 304, 305, 306, 307))
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def planted_pairs(n_hot, n_rest, n_pairs, cosine, seed=5):
    """A crowded topic whose vectors are hardly linked among themselves (cosines about 0.85), others all around, and
    pairs inside the topic at about the cosine: vectors, and the ids of the pairs."""
    rng = np.random.RandomState(seed)
    center = rng.standard_normal(64)
    center /= np.sqrt(center @ center)

    def turned(x, cos):
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.sqrt((z * z).sum(axis=1, keepdims=True))
        return cos * x + np.sqrt(1 - cos * cos) * z

    hot = turned(np.repeat(center[None, :], n_hot, axis=0), np.sqrt(0.85))
    rest = rng.standard_normal((n_rest, 64))
    rest /= np.sqrt((rest * rest).sum(axis=1, keepdims=True))
    source = hot if n_hot else rest
    twins = turned(source[:n_pairs], cosine)
    return np.concatenate((hot, rest, twins)), [(i, n_hot + n_rest + i) for i in range(n_pairs)]


def test_embeddings_in_a_crowded_topic(spark):
    x, pairs = planted_pairs(4000, 2000, 200, 0.953)
    got = {r.vec_id: r.component_id for r in embedding_dedup.embedding_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 198


def test_embedding_passes_grow():
    needed = [embedding_dedup._passes_needed(embedding_dedup._bucket_bits(n, 256), 0.95) for n in (100, 50_000, 2_000_000, 80_000_000)]
    assert needed == sorted(needed) and needed[-1] > needed[1] > needed[0]


@pytest.mark.parametrize("n", [0, 1, 150, 192, 6144, 6145, 60_000, 200_001])
def test_transport_stream(n):
    rng = random.Random(n)
    payload = transport_stream.pad(bytes(rng.randrange(256) for _ in range(n)))
    media = transport_stream.write_stream(payload)
    read = transport_stream.read_stream(media)
    assert read["payload"] == payload
    assert read["continuity_errors"] == 0
    units = -(-len(payload) // transport_stream.UNIT)
    assert read["pts"] == [k * 3000 for k in range(units)]
    assert read["random_access"] == [k * 3000 for k in range(0, units, 8)]
    if len(media) > 6 * 188:
        lost = media[: 3 * 188] + media[4 * 188 :]
        with pytest.raises(ValueError, match="damaged"):
            transport_stream.read_stream(lost)
        broken = bytearray(media)
        broken[3 * 188 + 3] ^= 1
        assert transport_stream.read_stream(bytes(broken))["continuity_errors"] > 0
    with pytest.raises(ValueError, match="sync"):
        transport_stream.read_stream(b"x" * 188)


def test_media_columns(docs, nothing):
    rows = docs.collect()
    stored = transport_stream.to_transport_streams(docs).collect()
    media = {hashlib.sha256(bytes(r.media)).hexdigest(): bytes(r.media) for r in stored}
    out = transport_stream.store_transport_streams(docs).collect()
    assert len(out) == len(rows) == len(stored)
    values = {}
    for r in out:
        assert len(media[r.media_sha256]) == r.media_bytes
        assert len(r.pts) == -(-r.payload_bytes // 6144) and r.random_access == r.pts[::8]
        assert f"units={len(r.pts)};pts={r.pts[0]}-{r.pts[-1]};access={len(r.random_access)}@" in r.feature
        values.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.tail_crc32))
    assert all(len(v) == 1 for v in values.values())
    want = collections.Counter()
    for r in rows:
        raw = (r.text or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert len(p) % 192 == 0 and len(p) > 0
        want[(r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[len(p) - 16 :]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert transport_stream.store_transport_streams(nothing).count() == 0


def fill(budget, children):
    """Water-filling by brute force: (weight, usable) by name."""
    share, left, open_ = {}, budget, dict(children)
    while open_:
        rate = left / sum(w for w, _ in open_.values())
        full = [k for k, (w, u) in open_.items() if u / w <= rate]
        if not full:
            return share | {k: min(u, int(rate * w)) for k, (w, u) in open_.items()}
        for k in full:
            share[k] = open_[k][1]
            left -= open_.pop(k)[1]
    return share


@pytest.mark.parametrize("total", [None, 500, 10**7, 0])
def test_mixing(docs, nothing, total):
    out = [r.asDict() for r in mixing.mix_sources(docs, total=total, max_epochs=3).collect()]
    rows = docs.collect()
    assert len(out) == len(rows)
    have = collections.Counter()
    for r in out:
        have[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
    quota = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in out}
    usable = lambda *k: 3 * sum(v for x, v in have.items() if x[: len(k)] == k)
    budget = sum(have.values()) if total is None else total
    doms = fill(budget, {k: (mixing.DOMAIN_WEIGHTS.get(k, 1), usable(k)) for k in {x[0] for x in have}})
    for d in doms:
        langs = fill(doms[d], {k: (mixing.LANG_WEIGHTS.get(k, 1), usable(d, k)) for k in {x[1] for x in have if x[0] == d}})
        for g in langs:
            leaves = fill(langs[g], {k: (mixing.SOURCE_WEIGHTS.get(k, 1), usable(d, g, k)) for k in {x[2] for x in have if x[:2] == (d, g)}})
            for s, q in leaves.items():
                assert quota[d, g, s] == q
                mine = [r for r in out if (r["domain"], r["lang"], r["source"]) == (d, g, s)]
                whole, rest = divmod(q, have[d, g, s]) if have[d, g, s] else (0, 0)
                key = lambda r: (hashlib.md5(f"17:{whole}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] or 0, r["n_tokens"])  # noqa: B023, E731
                so_far = 0
                for r in sorted(mine, key=key):
                    so_far += r["n_tokens"]
                    assert r["epochs"] == whole + (q > 0 and so_far <= rest)
    assert mixing.mix_sources(nothing).count() == 0


def test_mixing_plan_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("on", "er", "ti", "lo", "mu")]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "horrid"])
        rows.append((i, " ".join(w) + ("." if i % 3 else " Ö" * 3)))
        labels.append((i, int(toxic), "z"))
    rows += [(5000, None), (5001, ""), (None, "vile vile vile"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    out = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).toPandas()
    assert len(out) == len(rows)
    held = out[out.held_out & (out.doc_id < 900)]
    assert len(held) > 100
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.98
    assert out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(("" if i != i else str(int(i))).encode()) % 5 == 0)).all()
    assert (out[out.doc_id.isin([5000, 5001])].predicted == 0).all()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.score_toxicity(nothing, none).count() == 0


@pytest.mark.parametrize("kappa", [0.2, 1.0])
def test_toxicity_models(kappa):
    """Log ratios of texts under the two models, by dictionaries."""
    rng = random.Random(8)
    vocab = [a + b for a in "abcd" for b in ("u", "é", "OX")]
    groups = [[" ".join(rng.choice(vocab[k:]) for _ in range(rng.randint(1, 25))).encode() for _ in range(40 - 10 * k)] for k in range(2)]
    model = toxicity.KneserNey(toxicity.Counts(groups), kappa)
    words_of = lambda t: [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", lower(t.decode()))]
    words, pairs, totals = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for k, g in enumerate(groups):
        for t in set(g):
            w = words_of(t)
            words[k].update(set(w))
            pairs[k].update(set(zip([None, *w], w, strict=False)))
    totals = [sum(c.values()) for c in words]
    n, kinds = sum(totals), set(words[0]) | set(words[1])
    rate = totals[0] / n
    all_pairs = set(pairs[0]) | set(pairs[1])

    def discounted(a, b, share):
        expected = (a + b) * share
        gap = a - expected
        left = max(abs(gap) - max(kappa * ((a + b) * share * (1 - share)) ** 0.5, 0.75), 0) * (1 if gap > 0 else -1)
        return expected + left, a + b - expected - left

    own = {w: discounted(words[0][w], words[1][w], rate) for w in kinds}
    back = min(0.5, 0.75 * len(kinds) / n)
    shared = {w: (sum(e == w for _, e in all_pairs) + 1) / (len(all_pairs) + len(kinds) + 1) for w in kinds}
    p = {w: ((1 - back) * own[w][0] / rate / n + back * shared[w], (1 - back) * own[w][1] / (1 - rate) / n + back * shared[w]) for w in kinds}

    def ratio(v, w):
        word = np.log(p[w][0] / p[w][1]) if w in p else 0.0
        if (v, w) not in all_pairs:
            return word
        a, b = own[v] if v in own else (rate, 1 - rate)
        share = a * p[w][0] / (a * p[w][0] + b * p[w][1])
        x, y = discounted(pairs[0][v, w], pairs[1][v, w], share)
        return np.log(x / y) - np.log(a / b)

    tests = [" ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(60)]
    want = [sum(ratio(v, w) for v, w in zip([None, *x], x, strict=False)) / max(1, len(x)) for x in map(words_of, tests)]
    assert np.allclose(toxicity._ratios(model, tests), want, atol=1e-9)
    assert len(model.pairs) > 0 and np.abs(want).max() > 0.1
