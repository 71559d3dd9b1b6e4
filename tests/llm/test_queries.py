"""Registered queries: twins where SQL has one, the contract's columns for all, the pipeline stage by stage."""

import random

import pytest

import corpus_pipeline
from tests.check_oracle import compare, duck
from tests.llm.test_pairs import brute, hits
from trendloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_wrapper_induction": ["page_id", "url", "text", "n_chars"],
    "op2_warc_transactions": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3_winnowing": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_subword_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_feistel_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_bpe_transducer": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_resampling": ["doc_id", "log_ratio", "kept"],
    "op11_hat_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_language_spans": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    result = queries.QUERIES[name](spark, FOLDER)
    assert result.columns == COLUMNS[name]
    if name == "op11_hat_collocations":  # ranked phrases, not one row a document
        return
    table = "pages" if name in ("op1_wrapper_induction", "op2_warc_transactions") else "documents"
    assert result.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    ok, line = compare(spark, duck(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, line


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "near_duplicates":
            assert _ids(docs) == [i for i, _, c in sorted(brute(before)) if i == c]
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert _ids(docs) == sorted(r[0] for r in hits(before, items) if not r[-1])
        if name != "token_ids":
            assert docs.columns == columns
        else:
            assert _ids(docs) == sorted(i for i, _ in before) and docs.where("n_tokens * 4 != length(ids)").count() == 0
    assert _ids(corpus_pipeline.run(spark, FOLDER)) == _ids(docs)


def test_stages_on_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "A b c d e f g h"), (None, "a b c d e f g h"), (None, "zz"), (5, None), (3, "other words here")]
    docs = frame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
    one = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(
        [(1, None), (2, ""), (3, "a b c d e f g h"), (None, "zz"), (5, None), (3, "other words here")], key=str
    )
    assert corpus_pipeline.no_benchmark(spark, docs, FOLDER).count() == len(rows)
    assert corpus_pipeline.token_ids(spark, docs, FOLDER).count() == len(rows)


CLASHING = """kept n_words n_symbols base_failed passes_length log_ratio sample_key row_number bits within at maybe bucket gone_id gone_key
id key twice_id _bits _in _at _maybe _bucket _gone_id _gone_key _id _key text_key component component_id n_shingles n_hit contaminated
good doc both _order_0 _tie _part""".split()


def test_columns_of_any_name_keep_their_values(spark, frame):
    """Documents with columns named like those of the stages, among them a very long text, come through each stage unchanged."""
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120).collect()
    words = [w for r in source if r.lang == "en" and "http" not in r.text for w in r.text.split()] * 3
    random.Random(1).shuffle(words)
    long_text = " ".join(w + "\n" * (i % 15 == 14) for i, w in enumerate(words))
    rows = [(r.doc_id, r.text) for r in source] + [(10_001, long_text), (10_002, None), (10_003, ""), (10_004, source[0].text), (10_004, source[0].text)]
    values = [(i, t, *[f"{c} of {i}" for c in CLASHING[:-1]], float(i)) for i, t in rows]
    docs = frame(values, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING[:-1]) + f", `{CLASHING[-1]}` double")
    given = {tuple(v) for v in values}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes, name
        got = [tuple(r) for r in found.collect()]
        assert got and set(got) <= given, name
        assert any(r[0] == 10_001 for r in got), name
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, FOLDER).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert last(spark, docs, FOLDER).count() == len(rows)
