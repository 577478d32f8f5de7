"""Whitening, spelling variants and boundary BPE against brute force, numpy and the tokenizer library."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from followgraph.llm import boundary_bpe, common, queries, spelling, whitening
from followgraph.llm.boundary_bpe import Codec
from followgraph.llm.fm_index import WordIndex

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")

# --- whitening -----------------------------------------------------------------------------------

CLASHING = "vec_id bigint, embedding array<float>, component int, n int, v string, dims int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in rows], CLASHING).repartition(3)


def expected(rows, top):
    """(deviations, whitened, explained) in numpy, from exact integers."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * c - s for c, s in zip(v, sums)] for v in x]
    centred = np.array([[float(Fraction(c, n)) for c in v] for v in off])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    return [sum(c * c for c in v) for v in off], centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(got, rows, top):
    deviations, white, explained = expected([v for _, v in rows], top)
    table = got.sort_values(["vec_id", "component"])
    assert len(table) == len(rows) * top and (table["n"] == len(rows)).all()
    found = table["whitened"].to_numpy().reshape(len(rows), top)
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-6
    assert [int(d) for d in table["deviation"][::top]] == deviations
    assert np.abs(table["explained"].to_numpy()[:top] / explained - 1).max() < 1e-6
    assert table["identity_error"].nunique() == 1 and table["identity_error"].iloc[0] < 1e-8


def test_whitening_equals_numpy_and_leaves_odd_rows_out(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(6, 6))
    rows = [(k, (rng.normal(size=6) @ mixing + 5).astype(np.float32).tolist()) for k in range(200)]
    odd = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [float("inf")] + [0.0] * 5)]
    odd += [(905, [1.0, 2.0]), (906, [1e30] + [0.0] * 5)]
    check(whitening.whiten(vectors(spark, rows + odd)).toPandas(), rows, 6)


def test_whitening_of_repeated_rows_and_few_components(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist()) for k in range(40)]
    repeated = rows + rows[:1] * 30
    got = whitening.whiten(vectors(spark, repeated), components=2)
    assert got.count() == 140 and got.where("n = 70").count() == 140
    unnamed = whitening.whiten(vectors(spark, [*rows, (None, rows[0][1])]), components=1)
    assert unnamed.where("vec_id is null").count() == 1


def test_whitening_of_badly_conditioned_dimensions(spark):
    """Dimensions of very different size, and two that are nearly the same: the covariance's condition is about 1e13."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 3)) * np.array([1e5, 1.0, 0.5])
    rows = np.column_stack([base, base[:, 0] + rng.normal(size=300) * 0.05]).astype(np.float64)
    data = [(k, v.tolist()) for k, v in enumerate(rows)]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    x = np.floor(64 * rows).astype(np.int64) + 1_000_000
    centred = np.array([[float(Fraction(int(c) * len(x) - int(s), len(x))) for c, s in zip(v, x.sum(axis=0))] for v in x])
    singular = np.linalg.svd(centred, compute_uv=False)
    got = whitening.whiten(table).toPandas()
    explained = got.sort_values(["vec_id", "component"])["explained"].to_numpy()[:4]
    assert len(got) == 1200 and np.abs(explained / (singular**2 / (singular**2).sum()) - 1).max() < 1e-4
    assert got["identity_error"].iloc[0] < 1e-4


@pytest.mark.parametrize("rank", [1, 3])
def test_dependent_and_constant_dimensions_give_fewer_components(spark, rank):
    rng = np.random.default_rng(4)
    base = rng.integers(-40, 40, size=(60, rank))
    rows = np.column_stack([base, base.sum(axis=1), np.full(60, 7), base[:, 0] * 3]) / 64
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(table).toPandas()
    assert len(got) == 60 * rank and got["identity_error"].iloc[0] < 1e-9
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(white.T @ white / 60 - np.eye(rank)).max() < 1e-9


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [0.5, 1.0]) for k in range(5)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).columns[:3] == ["vec_id", "component", "n"]


def test_deviations_beyond_64_bits_stay_exact(spark):
    rows = [(k, [float(k * 2**38), 0.5]) for k in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert [int(d) for d in got.sort_values("vec_id")["deviation"]] == [(3 * 64 * 2**38) ** 2, 0, (3 * 64 * 2**38) ** 2]


# --- spelling ------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


@pytest.mark.parametrize("letters, size", [("ab", 9), ("abcé", 6), ("abcdefghijklmnopqrstuvwxyzàÿ", 5)])
def test_index_finds_exactly_the_near_words(letters, size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(size - 2, size))) for _ in range(500)})
    asked = words + ["", "q", "ab" * 9, letters * 3, "日本語"]
    index, found = WordIndex(words), set()
    for first in (True, False):
        pattern, word = index.one_edit(asked, first)
        pairs = {(asked[p], words[w]) for p, w in zip(pattern, word)}
        half = lambda a: len(a) // 2
        same = (lambda a, b: b[: half(a)] == a[: half(a)]) if first else (lambda a, b: b.endswith(a[half(a) :]))
        assert pairs == {(a, b) for a in asked for b in words if near(a, b) and same(a, b)}
        found |= pairs
    assert found == {(a, b) for a in asked for b in words if near(a, b)}


def counted(rows):
    total = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def by_brute_force(rows):
    words = counted(rows)
    links = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(links[w]), words[forms[w]] if forms[w] else None))
    return out


def variants_of(spark, rows):
    docs = spark.createDataFrame([(d, t, "w", 1, "k") for d, t in rows], "doc_id bigint, text string, word string, n int, key string")
    return {tuple(r) for r in spelling.variants(docs.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(150):
            w = base[min(int(rng.expovariate(0.03)), 119)]
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdeéÀ") + w[k:], w[:k] + rng.choice("xyzZ") + w[k + 1 :]])
            text.append(w)
        rows.append((doc, rng.choice([" ", ", ", "1", "\n"]).join(text)))
    odd = [(100, None), (101, ""), (102, " .-7 "), (None, "nulled nulled nulled Nulled"), (103, "A" * 5000 + " " + "À" * 3000), rows[0]]
    return rows + odd + [(104, ("z" * 400 + " ") * 4 + ("z" * 401 + " ") * 9)]


def test_variants_equal_brute_force(spark, noisy):
    assert variants_of(spark, noisy) == by_brute_force(noisy)


def test_large_groups_are_divided(spark, noisy, monkeypatch):
    monkeypatch.setattr(spelling, "_GROUP", 3)
    monkeypatch.setattr(spelling, "_BUCKET", 50)
    assert variants_of(spark, noisy) == by_brute_force(noisy)


def test_texts_are_counted_in_parts(spark, noisy, monkeypatch):
    assert list(spelling._parts("")) == []
    monkeypatch.setattr(spelling, "_PART", 7)
    text = "aaaa bbbbbbbbbbb c,dÀÀÀÀÀÀÀÀ 1"
    assert "".join(spelling._parts(text)) == text and not any(re.search("[A-Za-zÀ-ÿ]$", a) and re.match("[A-Za-zÀ-ÿ]", b) for a, b in zip(list(spelling._parts(text)), list(spelling._parts(text))[1:]))
    monkeypatch.setattr(spelling, "_HELD", 5)
    assert variants_of(spark, noisy[:20]) == by_brute_force(noisy[:20])


def test_forms_tie_by_code_points_and_chains_end(spark):
    words = {"aaaaab": 3, "aaaaac": 6, "aaaaad": 6, "aaaacd": 12, "aaaxcd": 24, "zzzzzz": 5, "zzzzzx": 9}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    doc = next(d for d in range(10_000) if all(zlib.crc32(f"{d}:{w}".encode()) % 97 for w in words))
    got = {r[0]: r for r in variants_of(spark, [(doc, text)])}
    assert got["aaaaab"][1:3] == ("aaaaac", "aaaaac") and got["aaaaad"][1:3] == ("aaaacd", "aaaxcd")
    assert got["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 5, 1, None) and got["aaaxcd"][1] is None
    assert got == {r[0]: r for r in by_brute_force([(doc, text)])}


def test_no_words(spark):
    assert variants_of(spark, []) == set() and variants_of(spark, [(1, None), (2, "one two two")]) == set()


# --- boundary BPE --------------------------------------------------------------------------------

POOLS = [
    "abcdefghij ", "ab'stremvld !?'\"  \n\t", "é世界　 \u0085 a1'", "\x00\x1c\x1d\x1e\x1f\x0b \n a", "😀👩‍👧́ñ٣१½ x",
    ".,;:!?()[]{}<>|'s <|endoftext|>", "0123456789 .,", "​﻿  a᠎'ll", "İΣςßÀÉ×÷.,- é",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(4), ["", " ", "a  b", "<|endoftext|>", " <|endoftext|><|endoftext|>  x", "<|endoftext|", "don't  'tis !'s", "a" * 5000]
    for _ in range(4000):
        pool = rng.choice(POOLS) + (rng.choice(POOLS) if rng.random() < 0.5 else "")
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        out.append(f"{text}<|endoftext|>{text[::-1]}" if rng.random() < 0.1 else text)
    points = lambda: rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x11000)])
    return out + ["".join(chr(points()) for _ in range(20)) for _ in range(300)]


def ids_of(codec, text):
    return codec.encode(np.frombuffer(text.encode(), dtype=np.uint8))


def test_ids_and_texts_are_the_librarys(library, texts):
    codec = Codec(BPE)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = ids_of(codec, text)
        assert got.tolist() == want.ids, text
        assert codec.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_librarys(library):
    codec, rng = Codec(BPE), random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, dtype="<u4")) == library.decode(ids, skip_special_tokens=False)


def test_cuts_lie_in_no_token(library):
    own = boundary_bpe.Vocabulary(BPE)
    inside = {t[k : k + 2] for t in own.tokens.values() for k in range(len(t) - 1) if t != b"<|endoftext|>"}
    assert {bytes(divmod(p, 256)) for p in np.flatnonzero(~own.apart)} == inside
    assert not (own.safe & ~own.apart).any() and own.safe.sum() > 10_000


def test_long_fragments_segments_and_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(boundary_bpe, "_SEGMENT", 50)
    monkeypatch.setattr(boundary_bpe, "_FRAGMENTS", 20)
    codec = Codec(BPE)
    for text in ("é" * 3000, " " * 3000, "ab" * 2000 + "'s", "the quick brown fox, and so on. " * 200, "x\n\n" * 700, "世" * 500):
        assert ids_of(codec, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_a_table(spark, library, texts):
    rows = [(k, t, 1, "ids") for k, t in enumerate(texts[:300])] + [(900, None, 1, "x"), (None, "no id", 1, "x"), (0, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string").repartition(3)
    encoded = boundary_bpe.encode(docs, BPE)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    want = collections.Counter((k, *library.encode(t or "", add_special_tokens=False).ids) for k, t, *_ in rows)
    got = encoded.collect()
    assert collections.Counter((r["doc_id"], *np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    back = boundary_bpe.decode(encoded, BPE)
    assert back.columns == ["doc_id", "n_tokens", "text"]
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((k, t or "") for k, t, *_ in rows)
    assert boundary_bpe.decode(boundary_bpe.encode(docs.limit(0), BPE), BPE).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert boundary_bpe.decode(nulls, BPE).head()["text"] is None


def test_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r for r in queries.op13_bpe_round_trip(spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(documents)
    for doc, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"], rows[doc]["decoded_sha256"]) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        boundary_bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_nodes_that_cannot_link_go_to_no_tile(spark, monkeypatch):
    monkeypatch.setattr(common, "_TILE_NODES", 8)
    template = list(range(20))
    # every node shares key 7; three in four have too many elements of their own to link with any other
    grams = {k: template + [1000 + 100 * k + j for j in range(1 + k % 2 if k % 4 == 0 else 9)] for k in range(80)}
    sets = spark.createDataFrame([(k, len(g), 1, sorted(g)) for k, g in grams.items()], "node bigint, n bigint, weight bigint, grams array<bigint>")
    postings = spark.createDataFrame([(k, 7) for k in grams], "node bigint, gram bigint")
    large = sets.selectExpr("node", "cast(0 as bigint) as group", "size(grams) as size")
    assert {r.node for r in common._lone_nodes(large, sets, 75).collect()} == {k for k in grams if k % 4}
    labels, counts = common.linked(postings, sets, 75)
    assert {r.node: r.component for r in labels.collect()} == {k: 0 for k in grams if k % 4 == 0 and k}
    assert {r.node: r.n_links for r in counts.collect()} == {k: 19 for k in grams if k % 4 == 0}


def test_workers_wait_without_what_a_task_used(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "settle", lambda: calls.append("settled"))
    rows = common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert [(r, len(calls)) for r in rows] == [(2, 1), (3, 1)] and len(calls) == 2
