"""Each stage of the pipeline against a plain version, on its own input."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_cases import plain_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(step))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_classifier_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = {r.doc_id for r in stages[0].collect()}
    good, bad = ([i in kept for i in ids if labels.get(i) == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(r.text == texts[r.doc_id] for r in stages[1].collect())


def plain_boilerplate(rows, least=10):
    """Lines on enough sites, in enough documents that differ apart from them; rows are (doc_id, text, source)."""
    full = [({x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}, s or "") for _, t, s in rows]
    sites, bodies = defaultdict(set), defaultdict(set)
    for lines, site in full:
        for line in lines:
            sites[line].add(site)
    wide = {line for line, s in sites.items() if len(s) >= least}
    for lines, _ in full:
        met, own = lines & wide, frozenset(lines - wide)
        for line in met:
            size, others = sum(map(len, own)), sum(map(len, lines)) - len(line)
            if 2 * len(own) >= len(lines) - 1 or 2 * size >= others:
                bodies[line].add(own)
            else:
                bodies[line].add(max((len(x), x) for x in met if x != line))
    return {line for line, b in bodies.items() if len(b) >= least}


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    gone = plain_boilerplate(before)
    want = [(i, "\n".join(x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c") not in gone), s) for i, t, s in before]
    assert after == want and gone


def test_near_copies(stages):
    before = rows(stages[2])
    keep = {i for i, _, c in plain_components(before) if i == c}
    assert [r[0] for r in rows(stages[3])] == sorted(keep)


def test_packing(stages):
    pieces = stages[4].collect()
    covered = Counter()
    for r in pieces:
        covered[r.doc_id] += r.length
    assert covered == {r.doc_id: r.doc_tokens for r in pieces} and set(covered) == {r.doc_id for r in stages[3].collect()}


def test_packed_ids(stages):
    """The pipeline's end product holds the training sequences themselves."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages[4].collect()))


def test_odd_rows(spark, documents):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text and further columns pass every stage."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    odd = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "a text without an id that is long enough to be one"), (4, long), (4, long), (5, "one")]
    out = documents(odd, 4).withColumns({"line": F.lit(1), "kept_id": F.lit("x"), "part": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER)
        assert out.columns == corpus_pipeline.COLUMNS
    kept = out.collect()
    assert {r.doc_id for r in kept} <= {1, 2, 3, 4, 5, None} and len(kept) == len({(r.doc_id, r.text) for r in kept})
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, FOLDER).collect()
    covered = Counter()
    for r in pieces:
        covered[r.doc_id] += r.length
    assert covered == {r.doc_id: r.doc_tokens for r in pieces} and set(covered) == {r.doc_id for r in kept}


def test_no_rows(spark, documents):
    out = documents([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, FOLDER)
        assert out.collect() == []
