"""Fingerprints, spelling variants and the conversation trie against brute force, with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from unittest import mock

import numpy as np
import pytest
from test_operators import SCHEMA, corpus

from tidemark.llm import conversation_trie, improbable_digest, spelling_variants
from tidemark.llm.textcore import prefix_hash, span_hash


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "r", 7, 9, "k") for r in corpus()]
    rows += [rows[2], (None, rows[4][1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def levels(data):
    out = []
    for i in range(len(data) - 63):
        total = sum(round(n * math.log2(n) * (1 << 20)) for n in collections.Counter(data[i : i + 64]).values())
        out.append((6 * 64 * (1 << 20) - total) * 1000 // (6 * 64 * (1 << 20)))
    return out


def slow_digest(text, rank):
    """Sets of bits with their counts of features, one for each filter."""
    data = text.encode()
    level = levels(data)
    good = [i for i, x in enumerate(level) if x >= 100]
    won = collections.Counter()
    for w in range(-63, len(data)):
        inside = [i for i in good if w <= i < w + 64]
        if inside:
            won[min(inside, key=lambda i: (rank[level[i]], i))] += 1
    spans = [(i, i + 64) for i in sorted(won) if won[i] >= 16] or ([(0, len(data))] if data else [])
    hashes = []
    for a, b in spans:
        piece = np.frombuffer(data[a:b], np.uint8)
        h = int(span_hash(prefix_hash(piece), np.array([0]), np.array([len(piece)]))[0])
        if h not in hashes:
            hashes.append(h)
    return [({(h >> 11 * k) & 2047 for h in hashes[i : i + 160] for k in range(5)}, len(hashes[i : i + 160])) for i in range(0, len(hashes), 160)]


def slow_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def score(x, y):
        (fx, nx), (fy, ny) = x, y
        q = 1 - 1 / 2048
        chance = 2048 * (1 - q ** (5 * nx) - q ** (5 * ny) + q ** (5 * (nx + ny)))
        e = len(fx & fy)
        return 0.0 if e < chance + 3 * math.sqrt(chance) else min(1, max(0, (e - chance) / (min(len(fx), len(fy)) - chance)))

    ways = [sum(x[1] * max(score(x, y) for y in v) for x in u) / sum(x[1] for x in u) for u, v in ((a, b), (b, a)) if len(u) <= len(v)]
    return sum(ways) / len(ways)


def bits(print_):
    """A fingerprint string as slow_digest gives it."""
    if not print_:
        return []
    counts, raw = print_.split(":")
    raw = np.unpackbits(np.frombuffer(bytes.fromhex(raw), np.uint8)).reshape(-1, 2048)
    return [(set(np.flatnonzero(r).tolist()), int(n)) for r, n in zip(raw, counts.split(","), strict=True)]


def test_entropy_of_windows():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(300)) + b"\0" * 100 + bytes(range(200))
    assert improbable_digest.entropy_levels(np.frombuffer(data, np.uint8)).tolist() == levels(data)


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_fingerprints(spark, docs, block):
    """Small blocks too, so that long texts are cut into pieces."""
    with mock.patch.object(improbable_digest, "BLOCK", block):
        rows = improbable_digest.digest_documents(docs).collect()
    line = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen = collections.Counter(x for _, t in line for x in levels(t.encode()))
    rank = {x: k for k, x in enumerate(sorted(range(1001), key=lambda x: (seen[x], x)))}
    digest = {t: slow_digest(t, rank) for _, t in line}
    want = []
    for (i, t), (_, u) in zip(line, [*line[1:], line[0]], strict=True):
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), digest[t], slow_digest(new, rank), digest[u]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert len(rows) == len(want)
    for got, (i, n, sha, own, new, nxt) in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:3] == (i, n, sha)
        assert bits(got[3]) == own and bits(got[4]) == new
        assert got[5] == pytest.approx(slow_likeness(own, new)) and got[6] == pytest.approx(slow_likeness(own, nxt))


def test_fingerprints_of_little(spark, nothing):
    assert improbable_digest.digest_documents(nothing).count() == 0
    one = improbable_digest.digest_documents(spark.createDataFrame([(5, "just one", "x", "x", 1, "", 1, 1, "")], SCHEMA)).first()
    assert (one.doc_id, one.n_chars, one.near_next) == (5, 8, 1.0)
    assert one.edited_sha256 == hashlib.sha256(b"justjust").hexdigest()


def slow_words(rows):
    seen = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(a) + 32) if "A" <= a <= "Z" else a for a in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 3 and len(w) >= 5}


def apart_by_one(u, v):
    if len(u) < len(v):
        u, v = v, u
    cut = [u[:i] + u[i + 1 :] for i in range(len(u))]
    return v in cut if len(u) > len(v) else len(u) == len(v) and sum(a != b for a, b in zip(u, v, strict=True)) == 1


@pytest.fixture(scope="module")
def wordy(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdÉé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    vocab = list(base)
    for w in base * 3:
        k = rng.randrange(len(w))
        vocab += [w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k + 1 :]]
    vocab += [p + s for p in ("prefix", "post") for s in ("aa", "ab", "ba", "b", "aab", "aabb", "Xyé×÷")]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(20, len(vocab))]).capitalize() for _ in range(60)), None, None, None, "r", 1, 2, "k") for i in range(90)]
    rows += [rows[0], rows[1], (None, rows[2][1], None, None, None, "r", 1, 2, "k"), (7, None, None, None, None, "r", 1, 2, "k"), (8, "", None, None, None, "r", 1, 2, "k"), (9, "\n12 %", None, None, None, "r", 1, 2, "k"), (10, "longword " * 5000, None, None, None, "r", 1, 2, "k")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("crowded, shard", [(20_000, 50_000), (2, 30)])
def test_spelling_variants(spark, wordy, crowded, shard):
    """With small shards and crowded halves too."""
    plain = spelling_variants.neighbours
    with mock.patch.object(spelling_variants, "neighbours", lambda words: plain(words, shard, crowded)):
        got = {r.word: r for r in spelling_variants.spelling_variants(wordy).collect()}
    words = slow_words([(r.doc_id, r.text) for r in wordy.collect()])
    assert set(got) == set(words) and len(words) > 150
    form = {}
    for w, n in words.items():
        near = [v for v in words if apart_by_one(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if near and words[best] >= 2 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(near), form[w], words.get(form[w]))
    steps = 0
    for w in words:
        root, k = w, 0
        while form[root]:
            root, k = form[root], k + 1
        steps = max(steps, k)
        assert got[w].root == root
    assert steps >= 2


def test_no_words(nothing):
    assert spelling_variants.spelling_variants(nothing).count() == 0


CONVERSATIONS = "conv_id long, turn int, role string, text string, key binary, path string, depth int"


def talk(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 160), 201, 202, 207, 900, -3, -4]:
        turns = rng.choice([[("user", "a"), ("assistant", "bb")], [("user", "a")], [("user", "hé")], []])
        turns = turns + [(rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None, "long " * 40])) for _ in range(rng.randint(0, 5))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    # a hot opening, and a hot whole conversation
    for c in range(1000, 1120):
        rows += [(c, 0, "user", "hi"), (c, 1, "assistant", "hello"), *([(c, 2, "user", str(c))] if c % 3 else [])]
    for c in range(2000, 2200):
        rows += [(c, k, "user", "same") for k in range(4)]
    rows += [(3000, None, "system", "first"), (3000, -1, "user", "second"), (3001, None, None, None), (None, 0, "user", "nobody")]
    rows += [(4000, k, "user", f"turn {k}") for k in range(300)] + [(4005, k, "user", f"turn {k}") for k in range(299)] + [(4010, k, "user", f"turn {k}") for k in range(150)]
    rng.shuffle(rows)
    return rows


def slow_trie(rows):
    talks = collections.defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            talks[c].append((k, role or "", text or ""))
    for turns in talks.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    whole = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(t[1:] for t in [*talks.get(c - c % 5, [])[:h], *turns[h:]])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == k).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("parts, gathered, sampled", [("4", 50_000, 20), ("13", 30, 3), ("1", 50_000, 20)])
def test_conversation_trie(spark, parts, gathered, sampled):
    """Many ranges, whose beginnings lie inside hot openings, and few."""
    rows = talk()
    df = spark.createDataFrame([(*r, b"k", "p", 3) for r in rows], CONVERSATIONS)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        with mock.patch.object(conversation_trie, "GATHERED", gathered), mock.patch.object(conversation_trie, "SAMPLED", sampled):
            got = sorted(map(tuple, conversation_trie.conversation_trie(df).collect()), key=lambda r: (r[1], r[0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert got == slow_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    lone = conversation_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], CONVERSATIONS))
    assert lone.count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    """Id 2 skips its first two turns, and its family has no opening."""
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    c = max(h, key=h.get)
    rows = [(c, k, "user", "x") for k in range(h[c])]
    got = conversation_trie.conversation_trie(spark.createDataFrame([(*r, None, None, None) for r in rows], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == slow_trie(rows) and len(got) == 1
