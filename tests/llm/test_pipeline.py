"""The pipeline's stages against plain Python on the smallest tables."""

import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from plumbline.llm.token_queries import END_ID, TOKENIZER
from plumbline.session import materialize
from test_decontaminate import words
from test_mixing import poisson, unit

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, FOLDER), name)
        out.append(docs.collect())
    return out


def test_registered():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination",
                                               "mixing", "tokens"]
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names)
                                       for i in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_quality_keeps_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]}
    assert kept <= {r.doc_id for r in steps[0]} and set(steps[1]) <= set(steps[0])
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert np.mean(right) > 0.95


def test_one_document_of_each_group_stays(steps):
    shingles = {}
    for r in steps[1]:
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    kept = {r.doc_id for r in steps[2]}
    ids = sorted(shingles)

    def alike(a, b):
        return len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))

    for i, b in enumerate(ids):
        near = [a for a in ids if a != b and alike(a, b) >= 0.7]
        if b not in kept:
            assert near, b
        elif any(alike(a, b) >= 0.9 for a in ids[:i]):
            pytest.fail(f"{b} stayed beside a copy")


def test_contaminated_documents_leave(spark, steps):
    parts = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        parts |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}
    want = []
    for r in steps[2]:
        w = words(r.text)
        if not any(tuple(w[i:i + n]) in parts for n in {len(p) for p in parts}
                   for i in range(len(w) - n + 1)):
            want.append(r)
    assert sorted(steps[3]) == sorted(want) and len(want) < len(steps[2])


def test_mixture(steps):
    size = {}
    for r in steps[3]:
        size[r.source] = size.get(r.source, 0) + len(r.text)
    weight = {s: math.sqrt(n) for s, n in size.items()}
    want = []
    for r in steps[3]:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source]
        want += [r] * poisson(rate, unit(f"7|{r.doc_id}|count"))
    assert sorted(steps[4]) == sorted(want)


def test_token_files(steps):
    plain, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for r in sorted(steps[4], key=lambda r: (r.doc_id, r.text)):
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, END_ID]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert sorted(map(tuple, steps[5])) == sorted(want)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing"])
def test_columns_of_any_name_pass_unchanged(spark, name):
    """Rows come back with their extra columns, whatever those are called."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = {"Stats": "1", "_version_": "2", "_version": "3", "_id": "4", "_mix_u": "5", "_mix": "6", "_row": "7",
             "_kept": "8", "_own": "9", "_its": "10", "_text": "11", "_read": "12", "label": "13", "score": "14"}
    own = docs.selectExpr("*", *[f"doc_id * {n} AS {c}" for c, n in extra.items()])
    stage = dict(pipeline.STAGES)[name]
    got, plain = stage(spark, own, FOLDER), stage(spark, docs, FOLDER)
    assert got.columns == own.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())
    assert all(r[c] == r.doc_id * int(n) for r in rows for c, n in extra.items())
