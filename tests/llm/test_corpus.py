"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import html
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from followgraph.llm import (
    bit_sliced,
    decontaminate,
    html_extract,
    huffman,
    language_id,
    license_scan,
    ngram_join,
    packing,
    quality,
    queries,
    substring_dedup,
)
from followgraph.llm.shingles import string_buffers
from followgraph.llm.tokens import Encoder, groups
from followgraph.session import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, part string, node int"


def words_of(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, odd texts and clashing column names."""
    rng = random.Random(3)
    base, passage = words_of(rng, 120), words_of(rng, 60)
    texts = {k: " ".join(words_of(rng, 100)) for k in range(10)}
    texts |= {20: " ".join(base), 21: " ".join(base).upper(), 22: "\n".join(base)}
    texts |= {30 + k: " ".join([*base[: 100 - k], f"new{k}", *base[101 - k :]]) for k in range(8)}
    texts |= {k: " ".join([*words_of(rng, 45), *passage, *words_of(rng, 45)]) for k in (40, 41, 42)}
    texts |= {50: None, 51: "", 52: " \n\t ", 53: "one two", 54: "one  two", 55: "é" * 50, 56: " ".join(words_of(rng, 20000))}
    rows = [(k, t, "en", "s", len(t or ""), k % 3, "x", 7) for k, t in texts.items()]
    return rows + [rows[0], (None, "no id here at all", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_ngram_join_equals_brute_force(docs, rows):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = {k: shingles(t) for k, t in texts.items()}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0
    component = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            component[a] = min([component[a], *(component[b] for b in sets if b != a and link(a, b))])
    got = ngram_join.link_components(docs).collect()
    assert len(got) == sum(r[0] is not None for r in rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]])
    assert {r["doc_id"]: r["n_links"] for r in got}[20] == sum(link(20, b) for b in sets if b != 20)
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in sets if component[k] == k} | {None}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert ngram_join.link_components(none).count() == 0
    assert substring_dedup.repeated_spans(none).count() == 0
    assert substring_dedup.without_repeats(none).columns == docs.columns
    assert decontaminate.contaminated(docs, items).count() == 0
    assert packing.pieces(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert license_scan.scan(none).count() == 0
    assert language_id.identified(none).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("id") >= 0).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    path = new_path(spark, "none")
    huffman.write_files(none, public_tokenizers.path("word_bpe_49k.json"), path)
    assert huffman.read_files(spark, path).count() == 0


def test_substring_dedup_cuts_the_shared_passage(docs, rows):
    spans = substring_dedup.repeated_spans(docs.where("doc_id >= 40 or doc_id is null")).collect()
    assert {(r["doc_id"], r["removed"]) for r in spans} == {(40, False), (41, True), (42, True)}
    for r in spans:
        assert 45 <= r["start"] and r["start"] + r["length"] <= 105 and r["length"] >= substring_dedup.MIN_WORDS
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    before, after = {r[0]: r[1] for r in rows}, {r["doc_id"]: r["text"] for r in cut.collect()}
    for k in (*range(10), 40, 50, 51, 52, 53, 55, 56, None):
        assert after[k] == before[k]
    for k in (41, 42):
        w = before[k].split()
        assert after[k].split() == w[: len(w) - 105 + 45][:45] + [x for x in after[k].split()[45:]]
        assert set(w[:45]) | set(w[105:]) <= set(after[k].split()) and len(after[k].split()) <= 150 - substring_dedup.MIN_WORDS
    assert after[21] == "" or before[21] == after[21]


def test_substring_dedup_finds_near_lines(spark):
    rng = random.Random(5)
    line = words_of(rng, 80)
    other = [*line[:40], "changed", *line[41:]]
    texts = [(1, "\n".join([" ".join(words_of(rng, 9)), " ".join(line)])), (2, " ".join(other)), (3, " ".join(words_of(rng, 80)))]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert (2, 0, 80, True, 1) in {(r["doc_id"], r["start"], r["length"], r["removed"], r["keep_doc_id"]) for r in spans}
    assert 3 not in {r["doc_id"] for r in spans}


def test_substring_dedup_finds_near_passages_in_short_lines(spark):
    rng = random.Random(9)
    two, tiny = words_of(rng, 60), words_of(rng, 80)
    near = [*two[:29], "changed", *two[30:]]  # 29 and 30 equal words, too few for a window
    lines = lambda w, n: [" ".join(w[i : i + n]) for i in range(0, len(w), n)]
    own = [words_of(rng, n) for n in (12, 7, 20, 40, 9, 30)]
    texts = [(5, [" ".join(own[0]), *lines(near, 30), " ".join(own[1])]), (2, [" ".join(own[2]), *lines(two, 30), " ".join(own[3])])]
    # a list of single words of which the other document has a part
    texts += [(7, [*own[4], *tiny]), (8, [*own[5], *tiny[20:70], *own[3][::-1]])]
    docs = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts], "doc_id bigint, text string").coalesce(1)
    spans = {(r["doc_id"], r["start"], r["length"], r["removed"]) for r in substring_dedup.repeated_spans(docs).collect()}
    assert (5, 12, 60, True) in spans and (2, 20, 60, False) in spans
    after = {r["doc_id"]: r["text"].split() for r in substring_dedup.without_repeats(docs).collect()}
    assert after[5] == [*own[0], *own[1]] and after[2] == [*own[2], *two, *own[3]]
    # near blocks reach a few words beyond the common part, and no further
    assert after[7] == [*own[4], *tiny] and len((set(own[5]) | set(own[3])) - set(after[8])) <= 8


def test_substring_dedup_keeps_one_copy_whatever_the_order_of_rows(spark):
    line = words_of(random.Random(6), 80)
    near = [*line[:40], "changed", *line[41:]]
    texts = [(12, " ".join(near)), (9, " ".join(line)), (3, " ".join(line))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert {(r["doc_id"], r["removed"], r["keep_doc_id"]) for r in spans} == {(3, False, 3), (9, True, 3), (12, True, 3)}
    after = {r["doc_id"]: r["text"].split() for r in substring_dedup.without_repeats(docs).collect()}
    assert after == {3: line, 9: [], 12: []}


@pytest.mark.parametrize("file, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(file, spaces):
    texts = ["", " ", "a  b", "\n a\n\n b.", "Don't  'tis,\nx.", "\x1c a\x85b", "é É ß İ Σας", "| a | b", "<|endoftext|> x", "tab\tb  ", "1,2. 3"]
    texts += [r.text or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").df().itertuples()]
    texts += ["<|endoftext|>", "a <|endoftext|><|endoftext|>  b<|startoftext|>c", "İ. İ, aİ.", "é.à,ÉcoLE:x", "x!'s y'll", ""]
    rng = random.Random(7)
    pools = ["ab'stremvld !?.,\"  \n\t", "é世　 \u0085 a1'É.,", "\x00\x1c\x1f\x0b \n a", "😀👩‍👧́ñ٣½ x.", "<|endoftext|> |<>", "İΣςßÀ×÷.,- é"]
    texts += ["".join(rng.choice(p + q) for _ in range(30)) for p in pools for q in pools for _ in range(60)]
    library = Tokenizer.from_file(public_tokenizers.path(file))
    data, offsets = string_buffers(pa.array(texts))
    own = Encoder(public_tokenizers.path(file), spaces)
    parts = [own.encode(data, offsets[a : b + 1]) for a, b in groups(offsets, 5000)]
    ids, sizes = (np.concatenate(x) for x in zip(*parts))
    want = [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing_is_gapless_and_whole(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = collections.Counter((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in rows)
    got = packing.pieces(docs, path, 64, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (got["length"] <= 64).all()
    for _, own in got.groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all()
    assert (got.groupby("sequence_id")["length"].sum().iloc[:-1] == 64).all()
    found, current = collections.Counter(), []
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and r.start == len(current)
        current += list(r.ids)
        if len(current) == r.doc_tokens:
            found[(None if np.isnan(r.doc_id) else int(r.doc_id), *current)] += 1
            current = []
    assert found == want and not current


def test_huffman_round_trip(spark, docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = new_path(spark, "huffman")
    huffman.write_files(docs, path, out)
    got = huffman.read_files(spark, out, with_ids=True).collect()
    want = collections.Counter((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows)
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89], list(range(1, 400)), [2**k for k in range(40)]])
def test_code_lengths_are_limited_and_complete(counts):
    lengths = huffman.code_lengths(np.array(counts), limit=10)
    assert lengths.max() <= max(10, int(np.ceil(np.log2(max(2, len(counts))))))
    assert len(counts) == 1 or sum(2.0 ** -int(x) for x in lengths) == 1
    assert (lengths[np.argsort(counts, kind="stable")][:-1] >= lengths[np.argsort(counts, kind="stable")][1:]).all()


def test_bit_sliced_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(0, 1, 7)]) for k in range(150)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (202, None), (203, [1.0, float("nan")]), (204, [float("inf")] * 7), (205, []), vectors[0]]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = bit_sliced.top_k(df, F.col("id") % 10 == 0, 4).collect()
    whole = {k: np.floor(256 * np.array(v)).astype(int) for k, v in vectors if v is not None and np.isfinite(v).all()}
    pad = lambda v: np.pad(v, (0, 7 - len(v)))
    for q in (k for k in whole if k % 10 == 0):
        best = sorted((-int(pad(whole[q]) @ pad(v)), k) for k, v in whole.items() if k != q)[:4]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [
            (n + 1, k, -s) for n, (s, k) in enumerate(best)
        ]


def test_bit_sliced_blocks_are_searched_as_queries_pass(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bit_sliced.tiles, "_PACK_BYTES", 256)
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rng.normal(0, 1, 5)]) for k in range(700)]
    vectors += [(k, vectors[5][1]) for k in range(700, 720)] + [(9, [0.5] * 5), (10, [3.0] * 5), (720, None)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = bit_sliced.top_k(df, F.col("id") % 10 == 0, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no copy of a block for each bundle of queries
    scores = collections.defaultdict(lambda: collections.defaultdict(list))
    whole = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in vectors if v is not None]
    for q, v in whole:
        for k, w in whole if q % 10 == 0 else ():
            if k != q:
                scores[q][k].append(int(v @ w))
    want = [(q, n + 1, k, -s) for q, all_ in scores.items() for n, (s, k) in enumerate(sorted((-max(x), k) for k, x in all_.items())[:4])]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    item = words_of(rng, 40)
    leaks = {1: item, 2: [w if k % 9 else "other" for k, w in enumerate(item)], 3: item[:20], 4: words_of(rng, 40), 5: item[:6]}
    rows = [(k, " ".join([*words_of(rng, 30), *w, *words_of(rng, 30)]).upper(), 1) for k, w in leaks.items()]
    rows += [(6, None, 1), (7, "", 1), (None, " ".join(item), 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, ", ".join(item)), (11, "a few words"), (12, None), (None, " ".join(item))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(k, 10, 30) for k in (1, 2, 3)}
    assert sorted(r["doc_id"] or 0 for r in decontaminate.without_contaminated(docs, items).collect()) == [0, 4, 5, 6, 7]


def test_language_id_on_held_out_documents(spark):
    got = entry.queries()["op3_language_id"](spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred", "score")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 ...", "de"), (3, "", None)], "doc_id bigint, text string, lang string")
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), ~language_id.held_out())
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language_id.predict(odd, model).collect()} == {("und", 0.0, True)}


def test_language_id_rejects_what_has_letters_but_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    clean = docs.where(language_id.held_out()).where("length(text) >= 200").select("doc_id", "text")
    rng = random.Random(8)
    texts = [r["text"] for r in clean.orderBy("doc_id").collect()]
    gibberish = [re.sub("[^\\W\\d_]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), t) for t in texts]
    rows = [*enumerate(gibberish), (-1, "Съешь же ещё этих мягких французских булок, да выпей чаю"), (-2, "xqzw vkjq zzxw qqkv wxzj pqzk")]
    wrong = language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    kept = language_id.predict(clean, model).where("not rejected").count()
    assert kept >= 0.98 * len(texts) and np.mean([r["rejected"] for r in wrong]) > 0.95
    assert all(r["rejected"] for r in wrong if r["doc_id"] < 0)
    few = language_id.train(docs.where("doc_id < 12"), F.lit(True))
    assert max(few.thresholds) > 1 / len(few.languages)  # calibrated on few documents, too


def test_language_id_learns_from_every_document(spark):
    # a language's only word of a kind is in a document beyond the first 500 by hash
    common = [(k, "gam dol ber sitre", "xx") for k in range(560)] + [(k, "oni vap lurk tesma", "yy") for k in range(1000, 1560)]
    special = [(2000 + k, "qewq wqeq", "xx") for k in range(40)] + [(3000 + k, "jhgj gjhj", "yy") for k in range(40)]
    learnt = spark.createDataFrame(common + special, "doc_id bigint, text string, lang string").repartition(3)
    ranked = learnt.withColumn("rank", F.expr("row_number() over (partition by lang order by xxhash64(doc_id), doc_id)"))
    learnt = ranked.where("doc_id < 2000 or rank > 500").drop("rank")
    assert learnt.where("doc_id >= 2000").groupBy("lang").count().count() == 2
    model = language_id.train(learnt, F.lit(True))
    asked = spark.createDataFrame([(1, "qewq wqeq"), (2, "jhgj gjhj")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()}
    assert got[1][0] == "xx" and got[2][0] == "yy" and min(s for _, s in got.values()) > 0.6


def test_license_phrases_equal_brute_force(spark):
    texts = {1: "MIT License. mit\nlicense", 2: "the mit licenses", 3: None, 4: "Apache-License GNU General Public License v3", 5: "émit license"}
    texts[6] = "x " * 5000 + license_scan.TEMPLATES["mit-text"].replace("[[", "").replace("]]", "").upper()
    texts[7] = license_scan.TEMPLATES["mit-text"].replace("[[including the next paragraph]] ", "").replace("without restriction", "with restriction")
    texts[8] = "This software is released under the terms of the MIT license"
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    for k, text in texts.items():
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert got[6]["labels"] == "mit-text" and got[6]["score"] == 1.0 and got[7]["labels"] == ""
    assert got[8]["labels"] == "mit,mit-notice" and got[4]["labels"] == "apache,gpl,gpl-named"


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad-box'>Buy</div><article>"
        "<h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Four <script>var x='</p>'</script>five<form>Name</form><aside>Side</aside></article>"
        "<div class=comments><p>First!</div><footer>End</footer>"
    )
    want = "Head & more\nOne two three\nFour five"
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", page), (3, None, None), (4, "", ""), (5, "x", "plain &lt;text"), (6, "http://a.example/3", page[:180])]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"] == got[2]["text"] == want and got[1]["n_chars"] == len(want)
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == ("", "", "plain <text")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split("<p>|</h1>", inner)]
        assert texts[r["page_id"]] == "\n".join(p for p in parts if p)


def test_html_extraction_keeps_the_whole_article(spark):
    long, short = "long body text " * 20, "shorter section text " * 12
    flat = f"<body><article><div class=body><p>{long}</p></div></article></body>"
    pages = {
        1: (f"<body><article><h1>T</h1><p>{short}</p><div class=body><p>{long}</p></div></article></body>", f"T\n{short}\n{long}"),
        2: (f"<body><article><div class=a>{long}</div><div class=b>{short}</div></article></body>", f"{long}\n{short}"),
        3: (f"<body><div class=nav>Menu</div><div><p>{short}</p><div class=body>{long}</div></div></body>", f"{short}\n{long}"),
        4: (f"<body><p>Site name</p><main><a href=x>Link</a><article>{long}</article><p>{short}</p></main></body>", f"Link\n{long}\n{short}"),
        5: (f"<body><div class=post>{long}</div><article>A card</article></body>", f"{long}\nA card"),
        6: (f"<body><p>Site name</p><article><p>{short}</p><a href=x>Link</a></article></body>", f"{short}\nLink"),
    }
    rows = [(k, "https://x.org/a", p) for k, (p, _) in pages.items()] + [(k, "https://x.org/b", flat) for k in range(10, 20)]
    rows += [(100 + k, f"https://h{k}.org/a", p) for k, (p, _) in pages.items()]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k, (_, want) in pages.items():
        assert got[k] == got[100 + k] == re.sub(" *(\n|$)", r"\1", want)
    assert got[10] == long.strip()


def test_quality_on_labels_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["quality"] == r["quality_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    same = lambda f: sorted(f[columns].itertuples(index=False, name=None))
    assert same(got) == same(want) and len(got)


def test_shuffled_starts_keep_their_letters_and_places(spark):
    text = "Zürich, 42 \U0001d400bc; d\0e 東京!" * 3
    sizes = [8, 16, len(text)]
    starts = language_id._shuffled_starts(text, sizes, 5)
    assert [len(s) for s in starts] == sizes and starts == language_id._shuffled_starts(text, sizes, 5)
    for size, start in zip(sizes, starts):
        assert sorted(start) == sorted(text[:size])
        assert all(a == b for a, b in zip(text, start) if not a.isalpha())
    assert starts[-1] != text and language_id._shuffled_starts("abc", [], 5) == []


def test_thresholds_come_from_whole_texts(spark):
    # scores by subword: those of x speak for the first language, all others for neither
    table = np.zeros((language_id.BUCKETS + 1, 2), dtype=np.float32)
    data = np.frombuffer(b"xxxxxxxx", dtype=np.uint8)
    for buckets in language_id._subwords(data, np.array([0, len(data)])):
        table[buckets[buckets < language_id.BUCKETS], 0] = 9
    model = language_id.Model(["a", "b"], table, np.zeros(2))
    rows = [(k, "a", "x" * 4096 + "y" * 9000) for k in range(20)] + [(30, "a", "x" * 3)]
    apart = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    thresholds = language_id._thresholds(apart, model)
    chances, _ = language_id._chances(pa.array([rows[0][2], "x" * 3]), model)
    assert thresholds[-1] <= chances[0].max() < 0.99
    assert thresholds[0] == chances[1].max() > 0.99  # texts shorter than the shortest start count as well


def test_an_encoder_learns_each_fragment_once(monkeypatch):
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    asked, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda fragments: (asked.append(set(fragments)), learn(fragments)))
    data = np.frombuffer(b"unlikely words, unlikely words again", dtype=np.uint8)
    first, _ = encoder.encode(data, np.array([0, len(data)]))
    again, _ = encoder.encode(data, np.array([0, len(data)]))
    assert first.tolist() == again.tolist() and asked == [{b"unlikely", b"words", b"again"}]


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    clean = docs.where("doc_id < 10")
    for name in names[:-1]:
        out = stage[name](spark, clean, SF)
        assert out.columns == clean.columns
        if name != "language_id":  # invented words have no language
            assert {r["text"] for r in out.collect()} == {r["text"] for r in clean.collect()}
    assert corpus_pipeline.run(spark, SF).select("sequence_id").distinct().count() > 1
