"""The pipeline against its stages done one text after the other."""

import corpus_pipeline
import pytest
from brute import near_duplicates, secret_spans, token_ids
from test_operators import PYTHON_RULES

from chronofold.llm import decontaminate, quality, tokens
from chronofold.llm.scratch import Scratch


@pytest.fixture(scope="module")
def outputs(spark, sf):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], sf)))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_columns(outputs):
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_quality_stage_keeps_what_the_model_takes(spark, sf, outputs):
    model = quality.fit(outputs[0], spark.read.parquet(f"{sf}/labels.parquet"))
    want = quality.score_texts(outputs[0], model).where("score >= 0.3")
    assert ids(outputs[1]) == ids(want)


def test_near_dedup_stage(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[1].collect()]
    assert ids(outputs[2]) == sorted(i for i, _, _, kept in near_duplicates(rows, 5, 4, 5) if kept)


def test_decontamination_stage(spark, sf, outputs):
    tests = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set(ids(outputs[2])) - set(ids(outputs[3]))
    leaks = {r["doc_id"] for r in outputs[2].collect() if any(t in r["text"] for t in tests)}
    assert leaks <= gone
    found = decontaminate.find_copies(outputs[2], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert gone == {r["doc_id"] for r in found.collect()}


def test_secret_stage(outputs):
    after = {r["doc_id"]: r for r in outputs[4].collect()}
    for r in outputs[3].collect():
        text, end, out = r["text"], 0, []
        for a, _, b, _ in secret_spans(text, PYTHON_RULES):
            if a > end or not out:
                out.append(text[end:a])
                end = b
            end = max(end, b)
        out.append(text[end:])
        assert after[r["doc_id"]]["text"] == "[SECRET]".join(out)
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])


def test_packing_stage_and_run(spark, sf, outputs):
    library = tokens.encoder(tokens.default_tokenizer()).library
    want = sorted((r["doc_id"], len(token_ids(library, r["text"]))) for r in outputs[4].collect())
    got = outputs[5].groupBy("doc_id").sum("length").collect()
    assert sorted(tuple(r) for r in got) == want
    assert outputs[5].groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    run = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32")
    staged = outputs[5].select(*run.columns)
    assert run.exceptAll(staged).isEmpty() and staged.exceptAll(run).isEmpty()


def test_texts_under_one_id_are_judged_apart(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (5, a), (6, leak), (6, a + " more")], "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"][:2]) for r in kept if r["text"] != leak)[:1] == [(3, "b0")]
    assert sum(r["text"].startswith("a0") for r in kept) == 1 and sum(r["text"].startswith("b0") for r in kept) == 1
    clean = corpus_pipeline.drop_benchmark_copies(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean) == sorted([(5, a), (5, b), (3, b), (5, a), (6, a + " more")])


def test_columns_with_names_of_our_own_stay(spark, sf):
    row = (1, 'some plain text with password = "abcdefghijklmnop" in it', 17, "mine", "mine", "mine", 0.25, "mine")
    names = "doc_id bigint, text string, n_chars int, _text string, _blob string, _spans string, score double, _key string"
    docs = spark.createDataFrame([row], names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(tuple(r)[3:] == row[3:] for r in out.collect())
    masked = corpus_pipeline.mask_secrets(spark, docs, sf).first()
    assert "[SECRET]" in masked["text"] and masked["n_chars"] == len(masked["text"])


def test_stages_on_odd_tables(spark, sf, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
    masked = corpus_pipeline.mask_secrets(spark, edge_docs, sf)
    assert masked.count() == edge_docs.count()
    kept = corpus_pipeline.drop_near_copies(spark, edge_docs, sf)
    found = [r["doc_id"] for r in kept.collect()]
    assert found.count(1) == 1 and 3 not in found and found.count(None) == 2 and 2 not in found
