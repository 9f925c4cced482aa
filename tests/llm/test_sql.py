"""The text queries with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from vectrail.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    want, got = sorted(cur.fetchall(), key=key), sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert got == want and got


def test_quality_sql_on_odd_rows(spark):
    """Nulls, repeated rows, other white space and lines above the limit."""
    shared = "Copyright 2024 by the HOST of  all pages"
    rows = [(200 + k, "\n".join([shared.replace("2024", str(1000 + k)) if k % 2 else shared.lower(), " ".join(f"w{k}x{j}" for j in range(44 + k % 9)), "same line", "same line"]), "h") for k in range(40)]
    rows += [(100, None, "h"), (101, "", None), (102, " \n\t\x0b ", "h"), (3, "a b c a b c # |", None), (3, "a b c a b c # |", None), (None, "É é ß " * 60, "h"), (104, "x\r\nx\r\n" * 40, "t")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cur = c.execute(catalog.oracle_sql()["op4_quality_rules"])
    names = [x[0] for x in cur.description]
    from vectrail.llm import quality

    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in quality.verdicts(d).select(*names).collect()), key=key)
    assert got == sorted(cur.fetchall(), key=key)
    kept = {r[0]: r[names.index("kept")] for r in got if r[names.index("n_removed_words")]}
    assert set(kept.values()) == {True, False}
    # the lines are gone from the kept texts, and nothing else is
    good = {r["doc_id"]: r["text"] for r in quality.keep_good(d).collect()}
    text = {i: t for i, t, _ in rows}
    assert all(good[i] == "\n".join(text[i].split("\n")[1:2]) for i in kept if kept[i]) and not any(i in good for i in kept if not kept[i])
