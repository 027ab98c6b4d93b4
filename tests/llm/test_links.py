"""Token alignment, conversation trie and embedding near-duplicates against brute force."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import alignment, covertree, frames, prefixes, queries
from tests.llm.conftest import by_id

SMALL = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


# --- alignment -------------------------------------------------------------------------------

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
ODD = ["<s> </s><|endoftext|> <unk>", "a\x00b", "x" * 3000, " " * 500 + "y", "▁▁ a▁", "👩‍👩‍👧 ﬁ Å Å", "日本語のテキスト",
       "tab\tand\r\nlines\n\n\n", "<0x41> 123456 1,000.50", "é" * 700, "", None, "the the the the", "the the the the"]


def brute_alignment(docs):
    """(id, figures, digest) of each text, token by token and byte by byte."""
    ea, eb = alignment.ByteLevel(A), alignment.Pieces(B)
    letters = alignment._byte_letters()
    assert sorted(letters.values()) == list(range(256))
    held, counts, out = [], Counter(), []
    for _, text in docs:
        t = text or ""
        a, b = ([i for i in e.encode([t])[0]] for e in (ea, eb))
        pa, pb = ([e.vocabulary.pieces[i] for i in side] for e, side in ((ea, a), (eb, b)))
        if not t or b"".join(pa) != b" " + t.encode() or b"".join(pb) != b" " + t.encode():
            held.append(([], [], [], 0))
            continue
        ends = [np.cumsum([len(p) for p in side]).tolist() for side in (pa, pb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = lambda end: bisect.bisect_left(cuts, end)
        groups = [([], []) for _ in cuts]
        for side, (ids, stop) in enumerate(((a, ends[0]), (b, ends[1]))):
            for i, e in zip(ids, stop):
                groups[group(e)][side].append(i)
        overlap = sum(min(x, y) > max(x - len(p), y - len(q)) for x, p in zip(ends[0], pa)
                      for y, q in zip(ends[1], pb)) if len(a) < 60 else None
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        held.append((a, b, groups, (links, overlap)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for (i, _), (a, b, groups, rest) in zip(docs, held):
        if not a:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        links, overlap = rest
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), sha(spelled), overlap))
    return out


@pytest.mark.parametrize("block", [1, 20_000, alignment.BLOCK])
def test_alignment(clashing, spark, none, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "PIECE", 4000)
    monkeypatch.setattr(alignment, "PRODUCTS", 1000)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = clashing.unionByName(more, allowMissingColumns=True)
    got = alignment.align(docs, A, B).collect()
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    known = Counter(key(w[:-1]) for w in want)
    assert Counter(key((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
                   for r in got) == known
    overlaps = {w[0]: w[-1] for w in want if w[-1] is not None and w[0] is not None}
    assert all(r.n_overlaps == overlaps[r.doc_id] for r in got if r.doc_id in overlaps)
    assert all((sha(r.groups) if r.groups else "") == r.groups_sha256 for r in got)
    assert alignment.align(none, A, B).count() == 0


CUT = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", " \r", "a", "the", "And", "é", "ſ", "÷", "'s", "'", "'ve", ",", ".",
       ");\r\n", "){\r", "(", "12", "3.5", "<s>", "<|endoftext|>", "://", "_", "|", "<0x0A>", "%", "x" * 300, " " * 40]


@pytest.mark.parametrize("known", [0, 50, alignment.KNOWN])
def test_segments(monkeypatch, known):
    """What segments add up to, against whole texts; other characters mixed in."""
    monkeypatch.setattr(alignment, "KNOWN", known)
    found = alignment.Segments(A, B)
    assert found.by_segment
    rng = random.Random(known)
    for _ in range(30):
        pool = CUT + ["▁", "日本", "\x0b", "\x85", "Ⅷ", "µ"] * rng.randrange(2)
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(60)] + [None]
        got = found.link(texts, 100)
        brute = brute_alignment(list(enumerate(texts)))
        assert got.figures[:, [0, 1, 2, 4]].tolist() == [list(b[1:5]) for b in brute]
        assert [sha(g.decode()) if g else "" for g in got.groups] == [b[7] for b in brute]
        assert all(b[8] in (None, n) for b, n in zip(brute, got.figures[:, 3].tolist()))
        assert len(found.numbers) - len(found.passing) <= known + sum(map(len, map(found._cut, filter(None, texts))))


def test_each_segment_is_encoded_once(monkeypatch):
    found, seen = alignment.Segments(A, B), Counter()
    for e in found.encoders:
        real = e.encode_segments
        monkeypatch.setattr(e, "encode_segments", lambda parts, f=real, k=type(e): (
            seen.update((k, p) for p in parts), f(parts))[1])
    texts = [f"the same words, number {i % 7}.\nand more of the same words" for i in range(200)]
    found.link(texts)
    found.link(texts)
    assert set(seen.values()) == {1} and len(seen) < 40


def test_other_vocabularies_are_encoded_whole(monkeypatch):
    """A piece that holds a cut forbids to encode segments."""
    real = alignment.Pieces._text_of
    monkeypatch.setattr(alignment.Pieces, "_text_of", lambda self, i: "of the" if i == 300 else real(self, i))
    assert not alignment.Pieces(B).by_segment


def test_row_products():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((7, 5), (5, 6)))
        csr = lambda m: alignment.from_sorted(*np.nonzero(m), m[np.nonzero(m)], *m.shape)
        got = np.zeros((7, 6), int)
        for r, c, v in alignment.row_products(csr(x), csr(y), 4):
            got[r, c] += v
        assert (got == x @ y).all()
        t = alignment.transposed(csr(x))
        back = np.zeros(x.T.shape, int)
        back[np.repeat(np.arange(5), np.diff(t.starts)), t.columns] = t.values
        assert (back == x.T).all()


def test_query_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op11_token_alignment(spark, SMALL)
    assert rows.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_id(rows, *rows.columns[:8]) == sorted(w[:-1] for w in brute_alignment(docs))


# --- trie ------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(math.fmod(c, 100))
        built[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return Counter(key((
        min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
        sha(",".join(map(str, sorted(c for c in m if built[c] == s)))))) for s, m in members.items())


def conversations(rng):
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc" * t]))
            for c in [*range(0, 60), *range(100, 130), *range(255, 260), -5, -250, -300]
            for t in range(rng.randrange(1, 9))]
    rows += [(7, None, "user", "no turn"), (8, 2, "user", "tie"), (8, 2, "system", "tie"), (9, 1, "user", "twice"),
             (9, 1, "user", "twice"), (None, 0, "user", "nobody"), (40, 0, None, None)]
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(60) for t in range(7)]
    rows += [(2000, t, "user", f"long {t % 3}") for t in range(230)]
    return rows + [(2001, None, "user", str(t)) for t in range(90)] + [(2100, 5, "user", "very long " * 50_000)]


@pytest.mark.parametrize("slices", [3, 4096])
def test_trie(spark, monkeypatch, slices):
    monkeypatch.setattr(prefixes, "SLICE", slices)
    monkeypatch.setattr(prefixes, "IDS_PER_PIECE", 5 if slices == 3 else 8192)
    monkeypatch.setattr(prefixes, "lookup", lambda r, v, k: frames.lookup(r, v, k, 10 if slices == 3 else 8192))
    rows = conversations(random.Random(5))
    turns = spark.createDataFrame(rows, CONV).repartition(5).withColumn("node", F.lit(1)).withColumn("place", F.lit(2))
    assert Counter(key(r) for r in prefixes.trie(turns).collect()) == brute_trie(rows)


def test_trie_edges(spark):
    assert prefixes.trie(spark.createDataFrame([], CONV)).count() == 0
    alone = spark.createDataFrame([(1, 0, "user", "gone")], CONV)  # its first turns are another's
    h = zlib.crc32(b"1") % 6
    assert h > 0 and [tuple(r) for r in prefixes.trie(alone).collect()] == [(1, 0, None, 1, 0, 1, 0, sha("1"))]


def test_long_conversation_is_split(spark):
    """One conversation with most of the rows lies in several partitions."""
    rows = [(3, t, "user", str(t)) for t in range(2000)] + [(c, 0, "user", "x") for c in range(5, 50)]
    turns = spark.createDataFrame(rows, CONV).repartition(6)
    local = prefixes.places(turns)
    got = {(r.conv_id, r.place) for r in local.collect()}
    assert got == {(3, i + 1) for i in range(2000)} | {(c, 1) for c in range(5, 50)}


def test_query_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_trie(spark, SMALL)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    assert Counter(key(r) for r in found.collect()) == brute_trie(rows)


def test_lookup_of_hot_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 300)], "k long, i long")
    values = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k long, v string")
    got = {r.i: r.v for r in frames.lookup(rows, values, "k", 10).collect()}
    assert got == {r.i: None if r.k is None or r.k >= 200 else f"v{r.k}" for r in rows.collect()}


# --- near vectors ----------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int"


def brute_near(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    link = defaultdict(set)
    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[j][2] == a and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= threshold:
                link[i].add(j)
                link[j].add(i)
    out = []
    for i, (n, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append(key((n, len(link[i]), least, n == least)))
    return Counter(out)


def vectors(rng):
    centres = rng.normal(size=(12, 16))
    rows = [(i, rng.normal(size=16), int(i % 3)) for i in range(150)]
    rows += [(200 + i, centres[i % 12] + rng.normal(size=16) * 0.18 * (i % 4), int(i % 12 % 2)) for i in range(400)]
    rows += [(1000 + i, centres[0] + rng.normal(size=16) * 0.01, 1) for i in range(150)]  # all of them link
    rows += [(2000 + i % 20, centres[1] * 3, 1) for i in range(60)]                         # copies, repeated ids
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [1.0] * 15 + [None], 1), (3003, [math.nan] * 16, 1),
             (3004, [math.inf] + [1.0] * 15, 1), (3005, rows[200][1], None), (None, rows[300][1], rows[300][2]),
             (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (None, None, None), (3009, [1e-30] * 16, 2),
             (3010, [3e30] * 16, 2), (-4, [-1.0] * 16, 2)]
    return rows


@pytest.mark.parametrize("tile", [24, 2048])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(covertree, "TILE", tile)
    monkeypatch.setattr(covertree, "TILES_PER_BLOCK", 3 if tile == 24 else 1024)
    rows = vectors(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, VEC).repartition(3).withColumns({c: F.lit(1) for c in ("cls", "key", "space")})
    got = covertree.near_duplicates(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(key(r) for r in got.collect()) == brute_near(rows)
    assert covertree.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_cover_tree():
    """Covering radii hold and halve, children lie in their parents, and nothing is lost."""
    points = np.random.default_rng(2).normal(size=(500, 5))
    points[100:200] = points[0] + np.random.default_rng(3).normal(size=(100, 5)) * 1e-3
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = covertree.build(points, 4)
    assert sorted(tree.order) == list(range(500)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.start)):
        below = tree.points[tree.start[i]:tree.end[i]]
        assert covertree.distances(below, tree.points[tree.centre[i]][None]).max() <= tree.radius[i] + 1e-6
        kids = range(tree.first[i], tree.last[i])
        if kids:
            assert tree.start[kids[0]] == tree.start[i] and tree.end[kids[-1]] == tree.end[i]
            assert tree.centre[kids[0]] == tree.centre[i]
    for threshold in (0.5, 0.93, 0.999):
        weights = np.random.default_rng(4).integers(1, 9, 500)[tree.order]
        found = covertree.Found((weights, weights), (tree.order, tree.order))
        covertree.traverse(tree, tree, found, threshold, True)
        linked = tree.points @ tree.points.T >= threshold
        np.fill_diagonal(linked, False)
        assert ((found.sums[0] + found.sums[1]) == linked @ weights).all()


def test_linked_run_is_not_paired():
    """Points that all link are counted from the balls alone."""
    points = np.ones((400, 8)) + np.random.default_rng(5).normal(size=(400, 8)) * 1e-3
    points /= np.linalg.norm(points, axis=1)[:, None]
    one = np.ones(400, np.int64)
    found = covertree.Found((one, one), (np.arange(400), np.arange(400)))
    tree = covertree.build(points)
    calls = []
    found.links = lambda *a: calls.append(a)
    covertree.traverse(tree, tree, found, 0.93, True)
    assert (found.sums[0] + found.sums[1] == 399).all() and not any(len(a) for a, _ in calls) and len(found.tree()[0]) == 399


def test_query_op13(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert Counter(key(r) for r in queries.op13_embedding_dedup(spark, SMALL).collect()) == brute_near(rows)
