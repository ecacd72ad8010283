"""The registered queries on the smallest tables: DuckDB where there is SQL, held-out accuracy and plain Python elsewhere."""

import zlib

import numpy as np
import pytest
from compare import connect, spark_rows, sql_rows

from driftline.llm.registry import ORACLE, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(connect(SF), ORACLE[name])


@pytest.mark.parametrize(("name", "label", "modulus", "rest"), [("op1_toxicity", "toxic", 5, 0), ("op10_quality_classifier", "quality", 4, 2)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    d = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % modulus == rest for i in rows["doc_id"]])
    assert (rows["held_out"].to_numpy() == held).all()
    y, p = rows[label].to_numpy()[held], rows["predicted"].to_numpy()[held]
    assert (y == p).mean() > 0.96
    rank = rows["score"].to_numpy()[held].argsort().argsort() + 1
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.93


def test_quality_rules_keep_good_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op2_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good = rows["quality"] == 1
    assert rows["kept"][good].mean() > 0.98 and rows["kept"][~good].mean() < 0.1


COUNTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(l[i:i + 4], ' ') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM d WHERE len(l) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS times FROM g), (SELECT unnest(range(5)) AS j) WHERE times > 1 GROUP BY doc_id
), s AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
)
SELECT d.doc_id, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
       len(l) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(l) AS base_failed
FROM d JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
"""


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_rule_counts_are_sqls(spark, sf):
    rows = QUERIES["op2_quality_rules"](spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert spark_rows(rows) == sql_rows(connect(sf), COUNTS_SQL)


def test_token_counts_bytes_are_sqls(spark):
    rows = QUERIES["op5_token_counts"](spark, SF).select("doc_id", "n_bytes")
    assert spark_rows(rows) == sql_rows(connect(SF), "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents")


@pytest.mark.parametrize(("sf", "recall"), [(SF, 0.8), ("/root/testdata/sf0.01", 0.8), ("/root/testdata/sf0.1", 0.88)])
def test_toxicity_by_scale(spark, sf, recall):
    """Few labels must not make clean rows toxic: at most 3 % of them, labelled or held out, and no flood among all rows."""
    rows = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    known = rows[rows["toxic"].notna()]
    assert known["predicted"][known["toxic"] == 1].mean() >= recall
    for some in (known, known[known["held_out"]]):
        assert some["predicted"][some["toxic"] == 0].mean() <= 0.03
    assert rows["predicted"].mean() < 1.3 * known["toxic"].mean()
    held = known[known["held_out"] & (known["toxic"] == 1)]
    assert len(held) < 50 or held["predicted"].mean() >= 0.8


def test_url_verdicts(spark):
    rows = QUERIES["op6_url_filters"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert all(r["verdict"] == "block" for r in rows if r["rule"] in ("net/", "example.com/de/"))


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from driftline.llm.token_counts import tokenizer_path

    model = Tokenizer.from_file(tokenizer_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["n_tokens"] == len(model.encode(docs[r["doc_id"]], add_special_tokens=False).ids) for r in rows)


def test_segmentation_is_lossless(spark):
    rows = QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(r["lossless"] for r in rows)
    assert rows == QUERIES["op8_sentencepiece"](spark, SF).collect()
