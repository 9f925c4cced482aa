"""Repeated rows, null ids, odd column names and other edges of the text operators."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vectrail.llm import common, langid, packing, quality, sharding, similar, topk, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_top_k_of_repeated_queries_and_empty_vectors(spark):
    rows = [(50, [1.0, 1.0])] * 2 + [(k, [k / 16, 0.0]) for k in range(1, 12)] + [(100, []), (101, []), (150, [])]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.top_k(t.where("id % 50 = 0"), t, query_rows=1, candidate_rows=2).collect()
    best = [(n + 1, 11 - n, 256 * 16 * (11 - n)) for n in range(5)]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50) == sorted(best * 2)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] != 50) == [(100, 1, 101, 0), (100, 2, 150, 0), (150, 1, 100, 0), (150, 2, 101, 0)]


def test_warc_pages_that_are_equal_throughout(spark, tmp_path):
    rows = [(1, "u", "same"), (7, "v", "same"), (7, "v", "same"), (7, "v", "same"), (3, "w", "other"), (3, "w", "other"), (None, None, None), (None, None, None)]
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.round_trip(p).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 4, sha("same"), "revisit", 7), (7, 4, sha("same"), "response", None), *[(7, 4, sha("same"), "revisit", 7)] * 2, (3, 5, sha("other"), "response", None), (3, 5, sha("other"), "revisit", 3), (None, 0, sha(""), "response", None), (None, 0, sha(""), "revisit", None)]
    assert got == sorted(want, key=str)
    # smaller payloads than min_bytes are all responses, repeated or not
    path = "file://" + str(tmp_path / "w")
    warc.write_archives(p, path, min_bytes=5)
    small = warc.captures(spark, path).where("payload_bytes < 5").collect()
    assert len(small) == 6 and {r["record_type"] for r in small} == {"response"}


def test_warc_reads_members_and_long_records():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3000000\r\n\r\n" + b"\r\n\r\n" * 750_000 + b"\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for data in (gzip.compress(one + two + one), gzip.compress(one) + gzip.compress(two) + gzip.compress(one)):
        assert [(f["warc-type"], len(b)) for f, b in warc.parse_records(data)] == [("response", 3_000_000), ("metadata", 2), ("response", 3_000_000)]
    assert list(warc.parse_records(gzip.compress(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(one[:-10])))


def test_packing_changes_no_id(spark):
    ids = [9007199254740993, None, 1152921504606846983, None]
    d = spark.createDataFrame([(i, "some words", 1) for i in ids], "doc_id bigint, text string, length int")
    assert Counter(r["doc_id"] for r in packing.pack_documents(d, WORDS).collect()) == Counter(ids)


def test_packing_deals_repeated_rows_evenly(spark):
    d = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("a few words").alias("text")).repartition(4)
    got = packing.pack_documents(d, WORDS, group_pieces=500).withColumn("group", F.expr("sequence_id >> 32"))
    sizes = [r["count"] for r in got.groupBy("group").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 6 and max(sizes) < 700
    full = got.groupBy("group").agg(F.ceil(F.sum("length") / packing.MAX_TOKENS).alias("least"), F.countDistinct("sequence_id").alias("n"))
    assert all(r["n"] == r["least"] for r in full.collect())


def test_packing_of_short_documents_needs_no_more_than_their_tokens(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    got = packing.pack_documents(d, WORDS)
    assert got.agg(F.sum("length")).first()[0] == 80_000
    assert got.select("sequence_id").distinct().count() == 40


def test_aims_never_add_a_sequence():
    r = np.random.default_rng(1)
    for lengths in (np.concatenate([np.full(500, 2048), np.full(6000, 4), r.integers(1, 600, 1500)]), r.integers(1, 30, 5000), np.full(10, 2048), np.array([1])):
        for rule in ("norm", "dot"):
            few, cost = 2 * len(lengths) / max(1, lengths.sum() / 2048), 2 * float((lengths.astype(float) ** 2).sum()) / max(1, lengths.sum() / 2048)
            aimed, offsets = packing.best_fit(lengths, 2048, few, cost, rule=rule, firm=(False, False))
            free, _ = packing.best_fit(lengths, 2048, 1e9, 1e15, rule=rule)
            assert aimed.max() <= free.max() + 1 and aimed.max() + 1 <= -(-lengths.sum() // 2048) + 2
            for b in range(aimed.max() + 1):
                own = aimed == b
                assert lengths[own].sum() <= 2048 and sorted(offsets[own]) == np.cumsum([0, *lengths[own][np.argsort(offsets[own])][:-1]]).tolist()
    # the aims do steer: short pieces are spread over more sequences than without them
    lengths = np.concatenate([np.full(300, 1500), np.full(3000, 30)])
    spread = lambda few: np.bincount(packing.best_fit(lengths, 2048, few, 1e15, firm=(False, False))[0]).max()
    assert spread(12) == 12 < spread(1e9)


def test_packing_respects_a_cost_limit(spark):
    d = spark.createDataFrame([(k, "word " * n) for k, n in enumerate([400, 300, 300, 200, 100, 50] * 20)], "doc_id bigint, text string")
    got = packing.pack_documents(d, WORDS, max_cost=200_000.0).groupBy("sequence_id").agg(F.sum(F.col("length") * F.col("length")).alias("cost"), F.count("*").alias("n"), F.sum("length").alias("tokens"))
    assert all(r["cost"] <= 200_000 or r["n"] == 1 for r in got.collect()) and got.agg(F.max("tokens")).first()[0] < 2048


def test_sharding_cuts_rows_that_are_equal_throughout(spark):
    d = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one text").alias("text"), F.lit("x").alias("key"))
    n = {r["shard"]: r["count"] for r in sharding.shard_by_bytes(d).groupBy("shard").count().collect()}
    assert sorted(n) == list(range(40)) and max(n.values()) < 1.1 * min(n.values())
    by = defaultdict(list)
    for r in sharding.shard_by_bytes(d, parts=1).collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_language_needs_letters_and_ignores_other_columns(spark):
    texts = [(k, "the house and the garden of this town " * 3, "en") for k in range(20)] + [(100 + k, "das haus und der garten dieser stadt " * 3, "de") for k in range(20)]
    odd = [(200, "½ ② Ⅷ", None), (201, "123 _ -", None), (202, None, "en"), (203, "", "en"), (None, "the town and this house", None), (None, "the town and this house", "fr")]
    d = spark.createDataFrame([(*r, 5, 6, 7) for r in texts + odd], "doc_id bigint, text string, lang string, __id long, `a.b` long, held_out long")
    got = langid.languages(d)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == len(texts + odd) and all(pred[k] == ("und", 0.0) for k in (200, 201, 202, 203)) and pred[None][0] == "en"
    assert langid.keep_known(d).columns == d.columns and langid.keep_known(d).count() == 42


def test_language_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Model, "__init__", lambda self, x, langs: seen.append(Counter(langs)) and None)
    d = spark.range(3000).select((F.col("id") % 3 + 1).alias("doc_id"), F.concat(F.lit("word "), F.chr(97 + F.col("id") % 26)).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    try:
        langid.fit(d)
    except TypeError:
        pass
    assert seen and max(seen[0].values()) <= 3
    assert set(seen[0]) == {"en", "de"}
    seen.clear()
    try:
        langid.fit(d.where("lang = 'en' or doc_id = 1"), most_languages=1)
    except TypeError:
        pass
    assert list(seen[0]) == ["en"]


def test_stages_keep_odd_columns(spark):
    d = spark.createDataFrame([(k, " ".join(f"the house{k}x{j}" for j in range(40)), "en", "s", 1, 2) for k in range(30)], "doc_id bigint, text string, lang string, source string, `a.b` int, `c``d` int")
    for stage in (quality.keep_good, langid.keep_known, similar.keep_one):
        assert stage(d).columns == d.columns and stage(d).where("`a.b` = 1").count() > 0


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(type("S", (), {"sparkContext": Context()})())


ODD = ["removed", "__removed", "__key", "a.b", "c`d", "c1"]


def odd_table(spark, name):
    """``documents`` with a column of this name, a map and an array; a map has no hash."""
    text = lambda k: " ".join(f"the house{chr(65 + k)}x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    rows = [(k, text(k), "en", "s", len(text(k)), f"own {k % 7}", {"a": k % 3, "b": None}, [{"x": k}]) for k in range(30)]
    rows += [(None, text(58), "en", None, 5, None, None, None), (40, "12 34", "en", "s", 5, "own 0", {}, []), (41, None, None, None, None, "own 0", {}, [])]
    quoted = name.replace("`", "``")
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars int, `{quoted}` string, tags map<string,int>, lists array<map<string,int>>")


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ODD)
def test_stages_leave_columns_of_any_name_as_they_are(spark, name):
    d = odd_table(spark, name)
    whole = plain_rows(d)
    for stage in (quality.keep_good, langid.keep_known, similar.keep_one):
        out = stage(d)
        assert out.schema.simpleString() == d.schema.simpleString()
        got = plain_rows(out)
        assert all(r in whole for r in got) and len(got) >= 31, stage
    assert len(plain_rows(langid.keep_known(d))) == 31 == len(plain_rows(quality.keep_good(d)))


def test_pipeline_with_odd_columns(spark, tmp_path):
    import corpus_pipeline

    odd_table(spark, "__key").withColumnRenamed("lists", "removed").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [None, *range(30)]))
