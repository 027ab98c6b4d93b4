"""Kneser-Ney model, token shards, suffix removal, SimHash, mixing, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import frames, kneserney, mixing, queries, simhash, suffixes, tokenbin
from meterline.llm import words as w
from tests.llm.conftest import SCHEMA, by_id
from tests.llm.test_filters import contamination

SMALL = "/root/testdata/sf0.001"
lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (w.unmix(w.mix(x)) == x).all()


def test_word_hashes_know_words_only():
    texts = ["ab c ab", "", "ab", "b" * 10 + " ab"]
    data, offsets = w.text_bytes(pa.array(texts))
    starts, ends = w.word_bounds(data, offsets, w.not_space())
    h = w.word_hashes(data, starts, ends)
    names = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(names)) == 3 and names[0] == names[2] == b"ab"
    assert h[0] == h[2] == h[3]


# --- Kneser-Ney ------------------------------------------------------------------------------

def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if not n[0]:
        return [0, 0.5, 1, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0 for k in (1, 2, 3)]
    return [0, *(d if d > 0 else k / 2 for k, d in zip((1, 2, 3), raw))]


class Brute:
    """Counts of each length of n-grams in dictionaries; None is the end token and what is before a text."""

    def __init__(self, texts, order):
        toks = [[*lower((t or "").encode()).split(), None] for t in texts]
        self.c = Counter(x for t in toks for x in t)
        self.n, self.v, self.order = sum(self.c.values()), len(self.c), order
        level = Counter(g for t in toks for g in self.grams(t, order))
        self.levels = {order: level}
        for k in range(order - 1, 0, -1):
            level = Counter(g[1:] for g in level)
            self.levels[k] = level
        self.cuts = {k: discounts(v.values()) for k, v in self.levels.items()}
        self.follow = defaultdict(lambda: [0, 0, 0, 0])
        self.sums = Counter()
        for level in self.levels.values():
            for g, k in level.items():
                self.follow[g[:-1]][min(k, 3)] += 1
                self.sums[g[:-1]] += k

    def grams(self, t, n):
        padded = [None] * (n - 1) + t
        return [tuple(padded[i:i + n]) for i in range(len(t))]

    def p(self, g):
        if not g:
            return 1 / (self.v + 1)
        h, cut = g[:-1], self.cuts[len(g)]
        if not self.sums[h]:
            return self.p(g[1:])
        k = self.levels[len(g)][g]
        left = sum(a * b for a, b in zip(self.follow[h], cut)) / self.sums[h]
        return max(k - cut[min(k, 3)], 0) / self.sums[h] + left * self.p(g[1:])

    def score(self, text):
        t = [*lower((text or "").encode()).split(), None]
        return (len(t), sum(self.c[x] > 0 for x in t),
                sum(math.log10((self.c[x] + 1) / (self.n + self.v + 1)) for x in t),
                sum(math.log10(self.p(g)) for g in self.grams(t, self.order)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(odd, odd_rows, order):
    train = odd.where("doc_id is null or doc_id % 3 <> 1").select("text")
    brute = Brute([r[1] for r in odd_rows if r[0] is None or r[0] % 3 != 1], order)
    model = kneserney.fit(train, order)
    assert model.tokens == brute.n and model.words == brute.v
    for context in [(None,) * (order - 1), (b"w1",) * (order - 1)]:
        whole = sum(brute.p((*context, v)) for v in brute.c) + brute.p((*context, b"?"))
        assert whole == pytest.approx(1)
    clashing = odd.withColumn("shard", F.lit("x")).withColumn("ids", F.lit(1))
    got = clashing.select("doc_id", "text", kneserney.scorer(model)("text").alias("s")).collect()
    for r in got:
        assert tuple(r.s) == pytest.approx(brute.score(r.text), rel=1e-9)


def test_kneser_ney_in_small_pieces(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(kneserney, "INPUT_PER_SHARD", 64)
    model = kneserney.fit(odd.select("text").repartition(5))
    brute = Brute([r[1] for r in odd_rows], 3)
    for r in odd.select("text", kneserney.scorer(model)("text").alias("s")).collect():
        assert tuple(r.s) == pytest.approx(brute.score(r.text), rel=1e-9)


def test_grams_are_added_up_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(kneserney, "PENDING", 50)
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 7, (40, 3)).astype("u4") for _ in range(30)]
    one = lambda x: kneserney._Grams.merged(kneserney.gram_keys(x), x, np.ones((len(x), 1), np.uint8))
    found = Counter()
    for batch in kneserney._counted(map(one, parts), 2, "u4"):
        for r in batch.to_pylist():
            ids = kneserney._from_planes(r["ids"], r["size"], 3)
            assert (kneserney.gram_keys(ids) >> np.uint64(62) == r["shard"]).all()
            stats = kneserney._from_planes(r["stats"], r["size"], 1)
            for g, n in zip(ids.tolist(), stats[:, 0].tolist()):
                found[tuple(g)] += n
    assert found == Counter(tuple(g) for x in parts for g in x.tolist())


def test_kneser_ney_without_training(spark, none, odd):
    model = kneserney.fit(none.select("text"))
    got = odd.select(kneserney.scorer(model)("text").alias("s")).select("s.*").collect()
    assert all(r.n_known == 0 and r.score == 0 for r in got)
    model = kneserney.fit(odd.select("text"))
    assert none.select(kneserney.scorer(model)("text")).count() == 0


def test_counts_beyond_a_byte(spark):
    df = spark.createDataFrame([("a b " * 5000,), ("b " * 700,)], "text string")
    brute = Brute(["a b " * 5000, "b " * 700], 3)
    model = kneserney.fit(df, 3)
    for r in df.select("text", kneserney.scorer(model)("text").alias("s")).collect():
        assert tuple(r.s) == pytest.approx(brute.score(r.text), rel=1e-9)


def test_each_distinct_gram_is_looked_up_once(spark):
    """What is worked out per n-gram is worked out for the distinct ones; unknown ones share a row of zeros."""
    model = kneserney.fit(spark.createDataFrame([("a b a b a c",)], "text string"))
    stream, sizes = kneserney.tokens(np.frombuffer(b"a b a b a b a d", np.uint8), np.array([0, 15]))
    hashes, at = np.unique(stream, return_inverse=True)
    ids = model.word_ids(hashes)[0]
    rows = kneserney.grams(ids[at], sizes, int(ids[np.searchsorted(hashes, kneserney.END)]), 2)
    stats, which = model.level(2, rows)
    assert len(stats) == 4 and len(which) == len(rows)  # end a, a b, b a, and the others
    assert (stats[-1] == 0).all() and (which[-2:] == 3).all()
    # distinct words before: (end end) a has one; a b has end and b; b a has a
    assert stats[which[:5], 0].tolist() == [1, 2, 1, 2, 1]


def test_levels_send_small_numbers(spark, tmp_path):
    """Statistics of the next shorter n-grams add up in no wider type than their counts need."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50, (3000, 3)).astype("u4")
    group = kneserney._Grams.merged(kneserney.gram_keys(ids), ids, np.ones((3000, 1), np.uint8))
    part, seen = group.rows(0, "u4"), []
    model, real = kneserney.Model(str(tmp_path), 0, 50, 3000), kneserney._Grams.merged
    with pytest.MonkeyPatch.context() as m:
        m.setattr(kneserney._Grams, "merged", staticmethod(lambda k, i, s: (seen.append(s.dtype), real(k, i, s))[1]))
        kneserney._write_level(part, model, 3)
    assert seen[-1] == np.uint8


# --- token shards ----------------------------------------------------------------------------

@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (5, 3), (1000, 9), (1000, 10**6), (700, 1 << 40), (300, 1 << 62)])
def test_sorted_lists(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint64))
    found = tokenbin.SortedList(np.frombuffer(tokenbin.encode_sorted(v), np.uint64))
    assert (found.select(0, n) == v).all()
    for a in range(0, n, 37):
        assert (found.select(a, min(a + 53, n)) == v[a:a + 53]).all()


ODD_TEXTS = ["Hello, WORLD's it's  <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b x,.!y ,x é́, é,́ don't.",
             "", "a b\x85c\x1cd\x00e", "A1b2,3 v1.2.3 ΣΑΣ, ΟΔΟΣ. İstanbul, straße! 日本語。テスト ½x ²",
             "a̸,̸≮ ≠x, ḱ.", "'s'tx ,'s x,'s hello.'re", "ab" * 500 + ", x.y.z", "😀,a.😀 a's,'s"]


def test_word_encoder():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    encoder = tokenbin.WordEncoder(queries.word_tokenizer())
    rng = random.Random(3)
    letters = "aB c,.'!<|>é́1 \n-:;?Σ"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, sizes = encoder.encode(*w.text_bytes(pa.array(texts)))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def token_rows(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_token_shards(odd, odd_rows, clashing, none):
    for frame in (odd, clashing):
        got = tokenbin.read_documents(tokenbin.write(frame, queries.word_tokenizer()))
        assert sorted(map(tuple, got.collect()), key=str) == token_rows([r[:2] for r in odd_rows])
    assert tokenbin.read_documents(tokenbin.write(none, queries.word_tokenizer())).count() == 0


# --- repeated strings ------------------------------------------------------------------------

def without_repeats(texts, size=400):
    seen = Counter(hashlib.md5(t[i:i + size]).digest() for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[hashlib.md5(t[i:i + size]).digest()] > 1:
                hit[i] += 1
                hit[i + size] -= 1
        gone = np.cumsum(hit)[:len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_repeats(spark, odd_rows, group):
    rng = random.Random(3)
    pieces = [f"{rng.randrange(99)} " for _ in range(9)]
    base = ["".join(rng.choice(pieces) for _ in range(600)) for _ in range(3)]
    texts = []
    for i in range(60):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            x[rng.randrange(len(x))] = chr(65 + rng.randrange(26))
        a = rng.randrange(0, 900)
        texts.append("".join(x[a:a + rng.randrange(0, 1500)]) + (texts[-1][:rng.randrange(1, 500)] if i % 3 == 0 and texts else ""))
    texts += ["a" * 1000, "a" * 399, "a" * 401, "", None, "ab" * 700, "ü" * 900]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[9]), (7, "b" * 410)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(df, group=group).collect()
    want = without_repeats([(t or "").encode() for _, t in rows])
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == \
        sorted(((i, *x) for (i, _), x in zip(rows, want)), key=key)


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeats_over_segments(spark, group):
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    shared = line(700)
    texts = [line(9000), line(1500) + shared + line(1100) + shared + line(800), "y" * 5000,
             line(300) + shared, line(399)]
    texts += [texts[1]] * 2
    want = without_repeats([t.encode() for t in texts])
    assert want[0][1] == 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for segment in (1000, 137):
        got = suffixes.remove_repeats(df, group=group, segment=segment).collect()
        assert [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
                for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_anchors_once_over_segments():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (5000, 100, 3000, 0, 700)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    rows = lambda size: [tuple(r.values()) for b in suffixes._block_anchors(
        data, offsets, pa.array(range(5)), size) for r in b.to_pylist()]
    assert len(set(rows(1 << 21))) == len(rows(1 << 21))
    assert rows(1 << 21) == rows(500) == rows(61) == rows(1)


def test_repeats_edges(clashing, none, odd_rows):
    assert suffixes.remove_repeats(none).count() == 0
    got = suffixes.remove_repeats(clashing).collect()
    assert sum(r.n_removed for r in got) == sum(x[1] for x in without_repeats(
        [(r[1] or "").encode() for r in odd_rows]))


def shares_passage(texts, size=50):
    rows = defaultdict(set)
    for i, t in enumerate(texts):
        x = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for j in range(len(x) - size + 1):
            rows[tuple(x[j:j + size])].add(i)
    return [any(i in r and len(r) > 1 for r in rows.values()) for i in range(len(texts))]


@pytest.mark.parametrize("segment", [1 << 21, 150])
def test_shared_passages(spark, segment):
    """Passages under 400 bytes stay in the text, and are told."""
    rng = random.Random(12)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(n))
    passage, once = line(50), line(50)
    texts = [f"{line(rng.randrange(90))} {passage} {line(rng.randrange(90))}" for _ in range(6)]
    texts += [passage, passage.replace(" ", "\n"), passage + "x", passage.split(" ", 1)[1], line(400),
              f"{line(30)} {once}\n{line(9)} {once} {line(20)}", "ab " * 500, "ab " * 49, "ab " * 50, "", None]
    texts += [f"{line(20)} {' '.join(passage.split()[:49])} {line(30)}" for _ in range(3)]
    again = line(60)
    rows = list(enumerate(texts)) + [(70, again), (70, again), (None, texts[10]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(df, segment=segment).collect()
    want = shares_passage([t for _, t in rows])
    assert sum(want) == 8 + 2 + 2 + 2
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.shares_passage) for r in got), key=key) == \
        sorted(((i, x) for (i, _), x in zip(rows, want)), key=key)
    assert [r.n_removed for r in sorted(got, key=lambda r: str(r.doc_id)) if r.doc_id in range(8)] == [0] * 8
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_query_op4_tells_passages(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = by_id(queries.op4_suffix_dedup(spark, SMALL), "doc_id", "shares_passage")
    assert got == sorted((i, x) for (i, _), x in zip(docs, shares_passage([t for _, t in docs])))


def test_deep_shallow_order():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 120))) for _ in range(400)]
    strings += [s + b"tail" for s in strings[:50]] + strings[:30] + [b"ab" * n for n in range(60)]
    for order in (suffixes.deep_shallow_order(strings), suffixes.blind_trie_order(strings, list(range(len(strings))))):
        assert [strings[i] for i in order] == sorted(strings) and len(set(order)) == len(strings)


def test_shared_reach():
    rng = random.Random(2)
    lefts, rights = [], []
    for _ in range(40):
        lefts.append(bytes(97 + (rng.random() < 0.01) for _ in range(336)))
        rights.append(b"k" * 64 + bytes(97 + (rng.random() < 0.01) for _ in range(336)))
    unique = list({(a, b) for a, b in zip(lefts, rights)})
    lefts, rights = [list(x) for x in zip(*unique)]
    got = suffixes.shared_reach(lefts, rights)
    for i in range(len(lefts)):
        pairs = [(suffixes.common(lefts[i], lefts[j]), suffixes.common(rights[i], rights[j]))
                 for j in range(len(lefts)) if j != i]
        ok = [p for p in pairs if sum(p) >= 400]
        want = (max(a for a, _ in ok), max(b for _, b in ok)) if ok else (0, 0)
        assert (got[0][i], got[1][i]) == want


# --- SimHash ---------------------------------------------------------------------------------

def brute_fingerprint(text):
    ws = lower((text or "").encode()).split()
    grams = [b" ".join(ws[i:i + 4]) for i in range(max(len(ws) - 3, 1))] if ws else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for i, c in zip(ids, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{f:016x}", least.get(c)) for i, f, c in zip(ids, fps, label)), key=str)


@pytest.mark.parametrize("chunk", [8192, 2])
def test_simhash(odd, odd_rows, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    got = simhash.classes(odd).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(odd_rows)


@pytest.mark.parametrize("parts,chunk", [(3, 8192), (2, 8192), (3, 5)])
def test_simhash_links(spark, parts, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(300):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [tuple(r) for r in simhash.links(df, parts=parts).collect()]
    label = {x: x for x in signed}
    find = lambda x: x if label[x] == x else find(label[x])
    for a, b in links:
        label[find(a)] = find(b)
    want = {x: x for x in signed}
    root = lambda x: x if want[x] == x else root(want[x])
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                want[root(a)] = root(b)
    groups = lambda f: sorted(sorted(x for x in signed if f(x) == r) for r in {f(x) for x in signed})
    assert groups(find) == groups(root)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    rng.shuffle(edges)
    got = dict(map(tuple, frames.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_simhash_keeps_one(clashing, odd_rows, none):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    want = {c for _, _, c in brute_components(odd_rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(none).count() == 0


# --- mixing ----------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while len(capped) < len(names):
        free = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 2 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * share for s in free}
        capped |= {s: 2 * sizes[s] for s in over}
    return capped


@pytest.mark.parametrize("block,slots", [(512, 8192), (16, 10)])
def test_mix(odd, odd_rows, block, slots, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", slots)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 8)
    rows = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want, taken = brute_targets(sizes), Counter()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_every_slot_once(spark):
    sources = mixing.targets(spark.createDataFrame(
        [("a", 5000), ("b", 70_000), (None, 12), ("c", 0)], "source string, size long"))
    got = mixing.slots(sources).collect()
    assert sum(r.words for r in got) == sum(r.words for r in sources.collect())
    assert len({(r["rank"], r["pass"], r.block) for r in got}) == len(got)
    assert all(0 < r.words <= 512 for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutations(n):
    p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
    q = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 78, np.uint64))
    assert sorted(p) == list(range(n)) and (n < 7 or (p != q).any())


def test_mixed_documents(clashing, none):
    mixed = mixing.mixed_documents(clashing)
    rows = mixed.collect()
    assert mixed.columns == clashing.columns
    assert sum(len(r.text.encode().split()) for r in rows) == sum(r.taken for r in mixing.mix(clashing).collect())
    whole = {r.text for r in clashing.collect()}
    assert any(r.text in whole for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# --- pipeline --------------------------------------------------------------------------------

def test_pipeline(spark):
    """Every stage against a plain version on the smallest tables."""
    from tests.llm.test_filters import counts

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}

    first = stages["quality rules"](spark, docs, SMALL)
    before, after = read(docs), read(first)
    for i, t in before.items():
        n, *_, repeated = counts(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in after
    assert first.columns == docs.columns and all(before[i] == t for i, t in after.items())

    second = stages["SimHash near-dedup"](spark, first, SMALL)
    assert sorted(read(second)) == sorted({c for *_, c in brute_components(sorted(after.items()))})

    third = stages["benchmark decontamination"](spark, second, SMALL)
    assert sorted(read(third)) == sorted(i for i, t in read(second).items() if not contamination(t, bench)[3])

    fourth = stages["mixing sources to target weights"](spark, third, SMALL)
    assert fourth.columns == docs.columns and fourth.dtypes == docs.dtypes
    taken = {r.doc_id: r.taken for r in mixing.mix(third).collect() if r.taken}
    got = Counter()
    for r in fourth.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert got == taken

    last = stages["token-ID / binary output"](spark, fourth, SMALL)
    assert sorted(map(tuple, last.collect()), key=str) == token_rows([(r.doc_id, r.text) for r in fourth.collect()])


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


# --- queries without SQL ---------------------------------------------------------------------

def test_query_op2(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([r.text for r in docs if not held(r.doc_id)])
    texts = {r.doc_id: r.text for r in docs}
    for r in queries.op2_kneser_ney(spark, SMALL).collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == brute.n
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(brute.score(texts[r.doc_id]))


def test_query_op3_op4_op6_op7(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_token_binary(spark, SMALL).collect()), key=str) == token_rows(docs)
    got = by_id(queries.op4_suffix_dedup(spark, SMALL), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((i, *x) for (i, _), x in zip(docs, without_repeats([t.encode() for _, t in docs])))
    got = queries.op6_simhash(spark, SMALL).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(docs)
    rows = queries.op7_mixing(spark, SMALL).collect()
    assert len(rows) == len(docs) and all(r.taken <= 2 * r.size for r in rows)


def test_query_op2_has_its_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200).collect()
    train = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([r.text for r in train if not held(r.doc_id)], kneserney.ORDER)
    got = {r.doc_id: r for r in queries.op2_kneser_ney(spark, SMALL).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == held(r.doc_id) and r.train_tokens == brute.n
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == pytest.approx(brute.score(d.text))
