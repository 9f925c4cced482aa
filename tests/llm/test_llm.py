"""The text operators against brute force, and their edge cases."""

import base64
import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vectrail.llm import catalog, html_blocks, langid, packing, piece_sampling, pseudo_likelihood, quality, sharding, similar, simhash, topk, warc

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row long, fp string, lines string"
EDGES = [(1, None, "en", None, None, "x", 1, "a", "b"), (2, "", None, "s", 0, None, None, None, None), (3, "word " * 60, "en", "s", 9, "y", 2, "c", "d"), (3, "word " * 60, "en", "s", 9, "y", 2, "c", "d"), (4, "é — 中 \t ▁ <|endoftext|> " * 4000, "fr", "s", 9, "y", 2, "c", "d"), (None, "no id here at all", "de", "t", 1, "z", 3, "e", "f"), (5, " \n\t ", "de", "t", 1, "z", 3, "e", "f")]


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOC)


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    s = [w[i : i + 4] for i in range(len(w) - 3)] or ([w] if w else [])
    h = [xxhash.xxh64(b" ".join(x), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = {d: brute_print(t) for d, t in rows}
    ids, root = sorted(prints), {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_simhash(spark, docs):
    got = {r[0]: (r[1], r[2]) for r in catalog.op1_simhash_near_dedup(spark, SF).collect()}
    assert got == brute_groups([(d, t) for d, t, *_ in docs])


def test_components_of_a_long_path(spark):
    from vectrail.llm.common import components

    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in catalog.op4_quality_rules(spark, SF).collect()}
    for d, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_line_frequency_rejects_depleted_documents(spark):
    shared = "\n".join(" ".join(c + x for x in "abcdefghijklm") for c in "stuvwxyz")
    own = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    rows = [(k, shared + f"\nonly{k}", "h") for k in range(30)] + [(100 + k, own(k) + "\n" + shared, "h") for k in range(5)] + [(200 + k, shared, "h") for k in range(40)] + [(300, shared, "other")]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[k] for k in range(30)) and all(got[100 + k] for k in range(5)) and got[300]


def test_top_k(spark):
    got = defaultdict(list)
    for r in catalog.op5_exact_topk(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids = np.array([r[0] for r in rows])
    v = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    for q in ids[ids % 50 == 0]:
        s = v @ v[ids == q][0]
        best = sorted((-x, i) for x, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        assert got[q] == [(n + 1, i, -x) for n, (x, i) in enumerate(best)]


def test_top_k_edges_and_ties(spark):
    rows = [(k, [0.5, 0.5]) for k in range(0, 120)] + [(200, None), (201, [None, 1.0]), (250, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = topk.top_k(t.where("id % 50 = 0"), t, query_rows=2, candidate_rows=16).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, v) for q in (0, 50, 100) for v in [x for x in range(7) if x != q][:5]]
    assert topk.top_k(t.where("id < 0"), t).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 é\r\n"), (None, "u", "x")]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(p, "file://" + path, captures_per_file=2)
    t = {r["metadata"]["page_id"]: r for r in warc.transactions(warc.read_records(spark, "file://" + path)).collect()}
    assert len(t) == 6 and t[5]["response"]["payload"] == rows[4][2] and t[3]["request"]["type"] == "request" and t[3]["response"]["uri"] is None
    got = {r["page_id"]: tuple(r)[1:] for r in warc.captures(spark, "file://" + path).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert got == {1: (4, sha("same"), "revisit", 2), 2: (4, sha("same"), "response", None), 3: (0, sha(""), "revisit", 4), 4: (0, sha(""), "response", None), 5: (len(rows[4][2].encode()), sha(rows[4][2]), "response", None), None: (1, sha("x"), "response", None)}
    assert warc.round_trip(p.limit(0)).count() == 0


def brute_pieces(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(WORDS), set()
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out |= {(d, n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))}
    return out


def check_packed(rows, want):
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2


def test_packing(spark, docs):
    check_packed(catalog.op7_best_fit_packing(spark, SF).collect(), brute_pieces([(d, t) for d, t, *_ in docs]))


def test_packing_rules_and_capacities():
    r = np.random.default_rng(1)
    n = r.integers(1, 100, 500)
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(n, 100, 5, 4000.0, rule=rule)
        for b in range(bins.max() + 1):
            x = n[bins == b].astype(float)
            assert len(x) <= 5 and x.sum() <= 100 and ((x**2).sum() <= 4000 or len(x) == 1)


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = ["Hello, World. it's. I'LL, don't! <|endoftext|> <|EndOfText|>, A.B, x,,  é. İ. 12,3. foo.\nbar,\tbaz\x1cqux ΑΣ.", "", "...,", "a'S. b'D, 's."]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.many(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_sharding(spark, docs):
    rows = catalog.op9_histogram_sharding(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    text = {d: t.encode() for d, t, *_ in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(text) and set(by) <= set(range(40))
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    largest = max(r["size"] for r in rows)
    mean = sum(r["size"] for r in rows) / 40
    assert all(abs(sum(r["size"] for r in by[k]) - mean) <= largest for k in range(40))


def test_sharding_splits_a_hot_text(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'the same text in a third of all rows', concat('text ', id))").alias("text"))
    n = {r["shard"]: r["b"] for r in sharding.shard_by_bytes(d).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(n) == 40 and max(n.values()) < 1.1 * min(n.values())
    assert sharding.shard_by_bytes(d.limit(0)).count() == 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    r = got.agg(F.avg(F.expr("cast(lang = lang_pred as int)")).alias("a"), F.min("score"), F.max("score")).first()
    assert r["a"] > 0.93 and 0 <= r[1] <= r[2] <= 1


def test_html(spark):
    pages = duckdb.connect().execute(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in catalog.op2_html_extraction(spark, SF).collect()}
    for p, h in pages:
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p]["text"] == "\n".join(x for x in parts if x) and got[p]["n_chars"] == len(got[p]["text"])


def test_html_gradients():
    r = np.random.default_rng(0)
    m = html_blocks.Labeller(1)
    x, mask = html_blocks.padded([r.normal(size=(k, html_blocks.DIMS)).astype(np.float32) for k in (3, 5)])
    loss = lambda: float(m.run(x, mask, "f")[:, :, 0].sum())
    kept: list = []
    m.run(x, mask, "f", kept)
    d = np.zeros((5, 2, html_blocks.HIDDEN), np.float32)
    d[:, :, 0] = 1
    grads = {k: np.zeros_like(v) for k, v in m.p.items()}
    m.back(x, kept, d, "f", grads)
    for k in ("fx", "fh"):
        i = tuple(r.integers(0, s) for s in m.p[k].shape)
        old = m.p[k][i]
        m.p[k][i] = old + 1e-2
        up = loss()
        m.p[k][i] = old - 1e-2
        down = loss()
        m.p[k][i] = old
        assert grads[k][i] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=5e-3)


def test_html_leaves_out_other_parts(spark):
    page = "<body><nav><a href=x>menu entry</a></nav><div class='cookie-notice'>We use cookies here.</div><article><h1>Title</h1><p>First &amp; main\n paragraph of the text.</p><form>Subscribe now</form><p>Second one.</p></article><section id=comments><p>I disagree with this.</p></section><footer>About us</footer>"
    base = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(-1, None, page), (-2, "u", None), (-3, "u", ""), (-4, "u", "<script>x</script>")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(base.union(more)).where("page_id < 0").collect()}
    assert got == {-1: "Title\nFirst & main paragraph of the text.\nSecond one.", -2: "", -3: "", -4: ""}


def test_pieces(spark, docs):
    d = spark.createDataFrame([(r[0], r[1]) for r in docs[:50]] + [(-1, None), (-2, ""), (-3, "▁ a  b\n\n中😀\x00" + "y" * 300)], "doc_id bigint, text string")
    e = piece_sampling.encode(d, PIECES, seed=5)
    back = {r["doc_id"]: r["text"] for r in piece_sampling.decoded(e, PIECES).collect()}
    assert back == {r["doc_id"]: r["text"] for r in d.collect()}
    ids = lambda x: {r["doc_id"]: r["ids"] for r in x.collect()}
    assert ids(e) == ids(piece_sampling.encode(d.repartition(7), PIECES, seed=5)) != ids(piece_sampling.encode(d, PIECES, seed=6))


def test_piece_sampling_follows_the_lattice():
    v = piece_sampling.vocabulary(PIECES)

    def all_of(s):
        return [((s[:i], *r), v.weight[s[:i]][1] * w) for i in range(1, len(s) + 1) if s[:i] in v.weight for r, w in all_of(s[i:])] if s else [((), 1.0)]

    lattice, n = all_of(" then"), 20_000
    total = sum(w for _, w in lattice)
    seen = Counter(tuple(v.text[k] for k in i) for i in piece_sampling.encode_many(v, [" then"] * n, piece_sampling.row_seeds(list(range(n)), 1)))
    assert all(abs(seen[k] / n - w / total) < 0.01 for k, w in lattice)


def test_pseudo_likelihood(spark, docs):
    d = spark.createDataFrame([(r[0], r[1]) for r in docs] + [(-1, None), (-2, " ")], "doc_id bigint, text string")
    r = np.random.default_rng(0)
    shuffled = spark.createDataFrame([(10_000 + x[0], " ".join(r.permutation(x[1].split()))) for x in docs], d.schema)
    net = pseudo_likelihood.Network(*pseudo_likelihood.vocabulary(pseudo_likelihood.word_counts(d)))
    rows = pseudo_likelihood.packed(d, net, 3).cache()
    before = pseudo_likelihood.score(rows, net).agg(F.sum("log_probability")).first()[0]
    net = pseudo_likelihood.train(rows, net)
    after = pseudo_likelihood.score(rows, net).agg(F.sum("log_probability")).first()[0]
    assert before < after < 0
    every = d.union(shuffled)
    scores = pseudo_likelihood.score(pseudo_likelihood.packed(every, net, 5), net)
    out = {x["doc_id"]: x for x in every.select("doc_id", *pseudo_likelihood.text_keys("text")).join(scores, ["h1", "h2"]).collect()}
    assert len(out) == 2 * len(docs) + 2
    # documents scored together have the sums that each has by itself
    for x in docs[:20]:
        ids = net.ids(x[1])
        alone = float(net.log_probabilities(pseudo_likelihood.contexts(ids), ids).sum(dtype=np.float64))
        assert out[x[0]]["n_words"] == len(ids) and out[x[0]]["log_probability"] == pytest.approx(alone, rel=1e-4)
    assert out[-1]["n_words"] == 0 == out[-2]["n_words"] and out[-2]["log_probability"] == 0
    # all outcomes of one position sum to one
    c = np.tile(pseudo_likelihood.contexts(net.ids("the of and"))[1:2], (pseudo_likelihood.VOCAB, 1))
    assert np.exp(net.log_probabilities(c, np.arange(pseudo_likelihood.VOCAB))).sum() == pytest.approx(1, abs=1e-3)
    rows.unpersist()


def test_window_counts_against_brute_force(spark, docs):
    """Mixed scores from the windows of all other documents, counted plainly."""
    texts = [x[1] for x in docs[:60]] + [docs[3][1], docs[3][1], docs[5][1] + " and more", "", "one", "one", "one two one two one two one two"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = pseudo_likelihood.word_counts(d)
    words, share = pseudo_likelihood.vocabulary(counts)
    net = pseudo_likelihood.Network(words, share, spelling=pseudo_likelihood.spelling(counts, words))
    groups = pseudo_likelihood.packed(d, net, 4)
    scores = pseudo_likelihood.score(groups, net, pseudo_likelihood.window_counts(groups, 7), 7)
    got = {x["doc_id"]: x["log_probability"] for x in d.select("doc_id", *pseudo_likelihood.text_keys("text")).join(scores, ["h1", "h2"]).collect()}
    windows = []
    for t in texts:
        edge = [None] * pseudo_likelihood.SIDE
        w = [*edge, *pseudo_likelihood.words_of(t), *edge]
        windows.append([((*w[k - 2 : k], *w[k + 1 : k + 3]), w[k]) for k in range(2, len(w) - 2)])
    for k, t in enumerate(texts):
        around, within = Counter(), Counter()
        for j, other in enumerate(windows):
            if j != k:
                for c, w in set(other):
                    around[c] += 1
                    within[c, w] += 1
        ids, others = net.numbered(t)
        if not len(ids):
            assert got[k] == 0
            continue
        p = net.log_probabilities(pseudo_likelihood.contexts(ids), ids).astype(float)
        p[ids > pseudo_likelihood.EDGE] += pseudo_likelihood.unmarked(pseudo_likelihood.marked(net.spelled(others), net.coded(t)[2]))
        want = 0.0
        for (c, w), lp in zip(windows[k], p, strict=True):
            n = around[c]
            want += lp if not n else np.log(pseudo_likelihood.KAPPA / (n + pseudo_likelihood.KAPPA) * np.exp(lp) + within[c, w] / (n + pseudo_likelihood.KAPPA))
        assert got[k] == pytest.approx(want, rel=2e-3, abs=1e-3)


def test_pseudo_likelihood_tells_copies_apart_and_ignores_the_files(spark, docs):
    texts = [x[1] for x in docs[:80]]
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(1000, texts[7], "x", 1), (1001, None, None, None), (None, texts[8], "x", 1), (None, None, None, None)], "doc_id bigint, text string, h1 string, copies int")
    one = {x["doc_id"]: x for x in pseudo_likelihood.pseudo_likelihood(d.coalesce(1)).collect() if x["doc_id"] is not None}
    four = {x["doc_id"]: x for x in pseudo_likelihood.pseudo_likelihood(d.repartition(4)).collect() if x["doc_id"] is not None}
    assert one.keys() == four.keys() and all(one[k]["log_probability"] == pytest.approx(four[k]["log_probability"], rel=1e-6) for k in one)
    rank = sorted((k for k in range(80) if one[k]["n_words"] > 20 and Counter(texts)[texts[k]] == 1), key=lambda k: one[k]["mean_log_probability"])
    assert one[7]["log_probability"] == one[1000]["log_probability"] and {7, 8} <= set(rank[-20:])
    assert one[1001]["n_words"] == 0 and one[1001]["mean_log_probability"] is None


def test_edges(spark, edges):
    empty = edges.limit(0)
    runs = {
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality": lambda d: quality.verdicts(d),
        "packing": lambda d: packing.pack_documents(d.where("doc_id is null or doc_id <> 4"), WORDS),
        "sharding": lambda d: sharding.shard_by_bytes(d),
        "language": lambda d: langid.languages(d),
        "pieces": lambda d: piece_sampling.encode(d, PIECES, check=True),
        "likelihood": lambda d: pseudo_likelihood.pseudo_likelihood(d, rounds=1),
    }
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        rows = run(edges).collect()
        assert len(rows) == 7 - (name == "packing"), name
    g = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(edges).collect()}
    assert g[1] == g[2] == g[5] == 1 and g[3] == 3
    assert all(r["lossless"] in (True, None) for r in piece_sampling.encode(edges, PIECES, check=True).collect())
    assert {r["doc_id"]: r["lang_pred"] for r in langid.languages(edges).collect()}[1] == "und"


def test_pipeline(spark, docs):
    """Against the stages' rules in plain Python: five words, similarity 0.8."""
    import corpus_pipeline

    # quality: copies of a text count once in its host
    lines, texts = defaultdict(set), defaultdict(set)
    for _, t, _, s in docs:
        texts[s].add(t)
        for x in t.split("\n"):
            lines[s, quality.line_hash(x)].add(t)
    limited = {s: {h for (host, h), v in lines.items() if host == s and len(v) > quality.HOST_DOCS and len(v) > quality.HOST_SHARE * len(texts[s])} for s in texts}
    good = {r["doc_id"] for r in catalog.op4_quality_rules(spark, SF).where("kept").collect()}
    kept = {d: quality.without(t, limited[s]) for d, t, _, s in docs if d in good and any(map(str.isalpha, t))}
    ids = sorted(kept)
    sets = {d: set(simhash.shingle_hashes(kept[d], 5)) for d in ids}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b]}
    rows = corpus_pipeline.run(spark, SF).collect()
    stay = {r["doc_id"] for r in rows}
    # no pair well above the similarity stays, and what went is close to what stays
    assert not [p for p, j in alike.items() if j >= 0.8 and set(p) <= stay]
    for d in set(ids) - stay:
        assert any(j >= 0.8 for p, j in alike.items() if d in p)
    check_packed(rows, brute_pieces([(d, kept[d]) for d in stay]))


def test_html_sample_of_mostly_empty_pages(spark, monkeypatch):
    """Where few pages with low hashes have text, the sample is drawn from all that have."""
    from vectrail.llm import html_blocks

    seen = []
    monkeypatch.setattr(html_blocks.Labeller, "fit", lambda self, pages, labels: seen.append(len(pages)) or self)
    page = "<html><body><nav><p>menu</p></nav><article><p>some words of text</p></article></body></html>"
    rows = [(k, "u", page if k % 100 == 0 else "") for k in range(1000)]
    html_blocks.fit_labeller(spark.createDataFrame(rows, "page_id bigint, url string, html string"), sample_pages=20)
    assert seen == [10 * (1 + html_blocks.LAYOUTS + html_blocks.SAMPLE_WEIGHT)]


def test_pseudo_likelihood_scores_every_word(spark):
    """Words outside the vocabulary are scored by their own spelling."""
    r = np.random.default_rng(2)
    rare = ["".join(r.choice(list("abcdefgh"), 6)) + f"{k:04d}" for k in range(3000)]
    base = [(k, " ".join([f"w{j}" for j in range(pseudo_likelihood.VOCAB + 80)] + rare[10 * k : 10 * k + 10])) for k in range(300)]
    more = [(1000, "w1 w2 " + rare[5] + " w3"), (1001, "w1 w2 " + rare[6] + " w3"), (1002, "w1 w2 zzzzqqqqzzzz w3")]
    d = spark.createDataFrame(base + more, "doc_id bigint, text string")
    counts = pseudo_likelihood.word_counts(d)
    words, share = pseudo_likelihood.vocabulary(counts)
    table = pseudo_likelihood.spelling(counts, words)
    assert np.allclose(np.exp(table.reshape(-1, 256).astype(float)).sum(1), 1, atol=1e-4)
    net = pseudo_likelihood.Network(words, share, spelling=table)
    both = net.spelled([b"ab", b"cd"])
    assert len(net.spelled([])) == 0 and both.tolist() == pytest.approx([net.spelled([b"ab"])[0], net.spelled([b"cd"])[0]])
    got = {x["doc_id"]: x["log_probability"] for x in pseudo_likelihood.pseudo_likelihood(d).collect()}
    assert len({round(got[k], 3) for k in (1000, 1001, 1002)}) == 3 and got[1002] < min(got[1000], got[1001])


def test_unseen_words_are_not_taken_for_seen_ones(spark):
    """A word that shares its bucket with one that is often seen there scores like any other unseen word,
    and the outcomes of one position sum to at most one."""
    p = pseudo_likelihood
    texts = ["alpha beta quixil0 gamma delta " + " ".join(f"x{k}y{j}" for j in range(20)) for k in range(20)]
    filler = [" ".join(f"w{j}" for j in range(p.VOCAB)) + f" vorptan{9000 + k}" for k in range(30)] * 2  # fill the vocabulary
    plain = p.Network(*p.vocabulary(p.word_counts(spark.createDataFrame([(k, t) for k, t in enumerate(texts + filler)], "doc_id bigint, text string"))))
    bucket = int(plain.ids("quixil0")[0])
    assert bucket > p.EDGE
    names = [f"vorptan{k}" for k in np.random.default_rng(3).permutation(90_000)[:20_000] + 10_000]
    ids = plain.ids(" ".join(names)).tolist()
    same = [w for w, i in zip(names, ids, strict=True) if i == bucket][:12]
    other = [w for w, i in zip(names, ids, strict=True) if i != bucket][:12]
    asked = [f"alpha beta {w} gamma delta" for w in ["quixil0", *same, *other]]
    d = spark.createDataFrame(list(enumerate(texts + filler + asked)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["log_probability"] for x in p.pseudo_likelihood(d).collect()}
    seen, *rest = [got[len(texts + filler) + k] for k in range(len(asked))]
    alike, unlike = rest[: len(same)], rest[len(same) :]
    assert seen > max(rest) + 10 and abs(np.median(alike) - np.median(unlike)) < 2

    # the middle word's probabilities after mixing, over words that share the bucket
    counts = p.word_counts(d)
    words, share = p.vocabulary(counts)
    net = p.Network(words, share, spelling=p.spelling(counts, words))
    many = ["quixil0", *[w for w, i in zip(names, ids, strict=True) if i == bucket]]
    own = spark.createDataFrame([(k, f"alpha beta {w} gamma delta") for k, w in enumerate(many)], "doc_id bigint, text string")
    every = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").union(own)
    groups = p.packed(every, net, 1)
    group = p.Group(groups.collect()[0].asDict())
    w = p.Windows(group, 1)
    table = p.window_counts(groups, 1).collect()[0]
    around, within = (np.frombuffer(table[n], np.uint32).astype(float) for n in ("around", "within"))
    ((_, part),) = w.parts()
    a, b = np.zeros(len(w.words)), np.zeros(len(w.words))
    a[part], b[part] = around, within
    mixed = p.remembered(p.word_scores(net, group), a[w.place] - w.own_neighbours(), b[w.place] - 1)
    at = [int(np.flatnonzero(group.doc == k)[2]) for k in range(len(group.lengths)) if group.lengths[k] == 5]
    assert len(at) == len(many) > 10 and np.exp(mixed[at]).sum() <= 1.01


def test_marks_keep_how_likely_a_spelling_is():
    p = pseudo_likelihood
    cost = np.concatenate([np.arange(0.1, 95, 0.37), [95.7, 95.9, 96, 150, 3000, 64_000, 90_000]])
    hashes = np.arange(len(cost)).astype(np.uint32) * np.uint32(77_777_777)
    back = -p.unmarked(p.marked(-cost, hashes))
    assert (abs(back - cost)[:-5] <= 0.35).all() and (abs(back / cost - 1)[-5:-1] < 0.03).all() and back[-1] == pytest.approx(65_000)


def test_pseudo_likelihood_trains_every_position():
    for n in (1, 2, 5, 100):
        for rounds in (1, 2, 3):
            got = np.concatenate([pseudo_likelihood.positions(b"some text", n, turn, rounds) for turn in range(rounds)])
            assert sorted(got.tolist()) == list(range(n))


def test_long_units_follow_the_lattice():
    """Boundary frequencies in a unit whose probability is far below any float, against exact ones."""
    from fractions import Fraction

    v = piece_sampling.vocabulary(PIECES)
    s = "\x01\x02" * 12 + "thenation" * 12 + "\x01\x02" * 30 + "international" * 10
    n, draws = len(s), 1500
    weight = lambda i, j: Fraction(v.weight[s[i:j]][1]) if s[i:j] in v.weight else Fraction(piece_sampling.BYTE_WEIGHT) if j == i + 1 else 0
    ahead, behind = [Fraction(1)], {n: Fraction(1)}
    for j in range(1, n + 1):
        ahead.append(sum(ahead[i] * weight(i, j) for i in range(max(0, j - piece_sampling.MAX_PIECE), j)))
    for i in range(n - 1, -1, -1):
        behind[i] = sum(weight(i, j) * behind[j] for j in range(i + 1, min(n, i + piece_sampling.MAX_PIECE) + 1))
    want = np.array([float(ahead[k] * behind[k] / ahead[n]) for k in range(n)])
    seen = np.zeros(n)
    for seed in piece_sampling.row_seeds(list(range(draws)), 1):
        seen[[i for i, _ in piece_sampling.sample_long(v, s, int(seed), 0)]] += 1
    assert np.abs(seen / draws - want).max() < 0.06


def test_top_k_keeps_large_components(spark):
    """Every finite vector takes part, with the order of exact scores."""
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(r.normal(size=4) * 10.0 ** r.integers(0, 38 if k % 3 == 0 else 7))]) for k in range(90)]
    rows += [(100, [2.0**53, 1.0, 0.0, 0.0]), (101, [2.0**53, 2.0, 0.0, 0.0]), (102, [1e6, 1.0, 0.0, 0.0]), (103, [0.0] * 4), (200, [float("inf"), 0.0, 0.0, 0.0]), (201, [1e9, float("nan"), 0.0, 0.0])]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = defaultdict(list)
    for x in topk.top_k(t, t, query_rows=8, candidate_rows=16).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows if i < 200}
    for q in whole:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert got[q] == [(i, -s if -(2**63) < s <= 2**63 and -s < 2**63 else None) for s, i in best]
    assert set(got) == set(whole)


def test_stages_tell_rows_apart(spark):
    """Rows with null or repeated ids have their own verdicts, and one of a group stays."""
    r = np.random.default_rng(6)
    vocabulary = ["".join(r.choice(list("abcdefghijklmnop"), 7)) for _ in range(2000)]
    texts = [" ".join(r.choice(vocabulary, 80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, "too short"), (8, "1 2 3"), (8, texts[4]), (9, texts[5]), (9, texts[5]), (None, texts[5]), (3, texts[5])]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    pairs = lambda x: sorted(((x["doc_id"], x["text"]) for x in x.collect()), key=str)
    long = [x for x in rows if len(x[1]) > 20]
    assert pairs(quality.keep_good(d)) == sorted(long, key=str)
    assert pairs(langid.keep_known(d)) == sorted([x for x in rows if x[1] != "1 2 3"], key=str)
    one = similar.keep_one(d.where("length(text) > 20"))
    assert pairs(one) == sorted([x for x in long if x[1] != texts[5]] + [(3, texts[5])], key=str)


def edited(r, words, share):
    """The words with some replaced, so that about ``share`` of the five-word shingles are common to both."""
    words = list(words)
    n = len(words)
    cut = max(1, round(n * (1 - share) / (1 + share)))  # shingles that change
    for at in r.choice(n - 5, max(1, round(cut / 5)), replace=False):
        words[at] = f"new{r.integers(1 << 30)}"
    return words


def test_similar_groups(spark):
    """Links are those of all pairs of fingerprints, and near copies from 0.8 on are found."""
    r = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(150):
        base = [f"w{x}" for x in r.integers(0, 4000, 250)]
        rows.append((10 * k, " ".join(base)))
        for j, share in enumerate((0.95, 0.9, 0.86)):
            rows.append((10 * k + 1 + j, " ".join(edited(r, base, share))))
            want[10 * k + 1 + j] = 10 * k
    rows += [(5000 + k, " ".join(f"w{x}" for x in r.integers(0, 4000, 200))) for k in range(100)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two WORDS"), (9005, "other words")]
    hot = [f"h{x}" for x in r.integers(0, 4000, 120)]
    rows += [(10_000 + k, " ".join(edited(r, hot, r.uniform(0.6, 0.98)))) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    node = {x["doc_id"]: x["node"] for x in similar.similar_groups(d).collect()}
    assert len(node) == len(rows)
    assert sum(node[a] == node[b] for a, b in want.items()) >= 0.99 * len(want)
    assert len({node[5000 + k] for k in range(100)}) == 100 and not {node[5000 + k] for k in range(100)} & {node[10 * k] for k in range(150)}
    assert node[9000] == node[9001] == node[9002] != node[9003] == node[9004] != node[9005]
    # all pairs of exact sets, by brute force
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] == sets[b] or sets[a] & sets[b] and similar.jaccard(rows[a][1], rows[b][1]) >= similar.SIMILARITY:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = lambda key: {frozenset(g) for g in by_value(key).values()}
    whole, found = groups({i: find(k) for k, (i, _) in enumerate(rows)}), groups(node)
    assert all(any(g <= w for w in whole) for g in found)  # no link that is not one
    assert len(found) - len(whole) <= 0.01 * len(rows)  # and all but MISS of the barely close
    assert similar.similar_groups(d.limit(0)).count() == 0


def test_rows_of_one_key_are_compared_in_linear_time_where_all_are_alike():
    n = 200_000
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 1)
    part = base ^ (np.int64(1) << r.integers(0, 62, n))  # two bits apart at most
    import pyarrow as pa

    def batches(key, part):
        table = pa.table({"key": key, "node": np.arange(len(key)), "part": part})
        return similar.alike(table.to_batches(max_chunksize=10_000))

    began = time.time()
    (got,) = batches(np.zeros(n, np.int64), part)
    assert got.num_rows == n and time.time() - began < 10
    # and no row is missed or made up
    key, part = np.sort(r.integers(0, 6, 600)), r.integers(0, 1 << 63, 600)
    part[::7] = part[3] ^ (1 << r.integers(0, 62, len(part[::7])))
    found = {x for b in batches(key, part) for x in b.column("node").to_pylist()}
    apart = lambda x, y: bin(int(part[x]) ^ int(part[y])).count("1")
    assert found == {x for x in range(600) if any(key[x] == key[y] and apart(x, y) <= similar.CHECK_LIMIT for y in range(600) if x != y)}
    began = time.time()
    fp = np.tile(r.integers(0, 1 << 63, 16).astype(np.uint64), (n // 10, 1))
    assert len(similar.spanning(fp, np.full(n // 10, 300.0), 0.77, 0.9)) == n // 10 - 1 and time.time() - began < 10


def test_spanning_links_are_the_most_alike():
    r = np.random.default_rng(9)
    base = r.integers(0, 2, (6, similar.BITS)).astype(np.uint8)
    rows = np.concatenate([np.where(r.random((15, similar.BITS)) < p, 1 - b, b) for b, p in zip(base, (0.01, 0.05, 0.08, 0.1, 0.12, 0.3), strict=True)])
    fp, size = np.packbits(rows, axis=1).view(np.uint64), np.full(len(rows), 200.0)
    links = similar.spanning(fp, size, 0.774, 0.9)
    root = list(range(len(rows)))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y, e in links:
        assert e >= 0.774 and find(root, x) != find(root, y)  # a forest
        root[find(root, x)] = find(root, y)
    whole = list(range(len(rows)))
    every = sorted(((similar.estimate(np.bitwise_count(fp[x] ^ fp[y]).sum(dtype=np.int64), 200.0, 200.0), x, y) for x in range(len(rows)) for y in range(x)), reverse=True)
    most = []
    for e, x, y in every:
        if e >= 0.774 and find(whole, x) != find(whole, y):
            whole[find(whole, x)] = find(whole, y)
            most.append(e)
    assert len(most) == len(links) and [e for e in sorted((e for *_, e in links), reverse=True) if e < 0.9] == pytest.approx([e for e in most if e < 0.9])


def test_close_links_join_all_close_fingerprints_without_pairs(spark):
    r = np.random.default_rng(7)
    flips = lambda n, bits: np.bitwise_xor.reduce(np.left_shift(np.int64(1), r.integers(0, 62, (n, bits))), axis=1)
    near = int(r.integers(0, 1 << 62)) ^ flips(2000, 2)  # a group of near copies
    chain = [int(r.integers(0, 1 << 62))]
    for _ in range(60):
        chain.append(chain[-1] ^ int(flips(1, 4)[0]))
    values = np.unique(np.concatenate([near, chain, r.integers(-(1 << 62), 1 << 62, 500)]))
    links = [tuple(x) for x in simhash.close_links(spark.createDataFrame([(int(v),) for v in values], "fp bigint")).collect()]
    assert all(a < b and (a ^ b).bit_count() <= 4 for a, b in links) and len(links) < 36 * len(values)
    root = {int(v): int(v) for v in values}

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(root, a)] = find(root, b)
    whole = {int(v): int(v) for v in values}
    for k, v in enumerate(values):
        for w in values[k + 1 :][np.bitwise_count(values[k + 1 :] ^ v) <= 4]:
            whole[find(whole, int(v))] = find(whole, int(w))
    groups = lambda root: {frozenset(g) for g in by_value({v: find(root, v) for v in root}).values()}
    assert groups(root) == groups(whole)


def by_value(mapping):
    out = defaultdict(set)
    for k, v in mapping.items():
        out[v].add(k)
    return out
