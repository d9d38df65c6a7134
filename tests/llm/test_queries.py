"""Queries of the subpackage against SQL, held-out labels and brute force."""

from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from winnower.llm import pii
from winnower.llm import queries as Q

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(name, spark, sf_dir, duck):
    assert_same(Q.queries()[name](spark, sf_dir), duck, Q.oracle_sql()[name])


@pytest.mark.parametrize(("name", "label", "accuracy"), [("op2_quality_classifier", "quality", 0.9), ("op9_toxicity", "toxic", 0.85)])
def test_held_out_labels(name, label, accuracy, spark):
    out = Q.queries()[name](spark, SMALL)
    assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= accuracy


def test_held_out_languages(spark):
    out = Q.op4_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def test_pseudonyms_of_whole_table(spark):
    """The query against the plain function on every row; all mail is hidden, equal mail alike, and the key turns all back."""
    key = pii.Pseudonyms(key=b"demonstration")
    back = pii.Pseudonyms(key=key.key, inverse=True)
    rows = Q.op3_pseudonyms(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text").alias("old")), "doc_id").collect()
    linked: dict[str, str] = {}
    for r in rows:
        assert (r.text, r.n_found) == (lambda x: (x[0], x[1].total()))(pii.pseudonymise(r.old, key)) if r.old else r.text == r.old
        before, after = MAIL.findall(r.old or ""), MAIL.findall(r.text or "")
        assert len(before) == len(after) and all(linked.setdefault(a.lower(), b.lower()) == b.lower() and a != b for a, b in zip(before, after, strict=True))
        assert pii.pseudonymise(r.text or "", back)[0] == (r.old or "")
    assert linked and len(set(linked.values())) == len(linked)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "leaks", "mix"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.run(spark, sf_dir)
    ids = {r.doc_id for r in docs.collect()}
    got = out.collect()
    assert {r.doc_id for r in got} <= ids and len({r.doc_id for r in got}) == len(got) > 100
    assert all(r.taken == r.size * r.copies for r in got)


def test_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
