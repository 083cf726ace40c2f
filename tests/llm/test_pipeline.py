"""Each stage of the pipeline against brute force on what the stage before it kept, and odd tables."""

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_contracts import ODD, _groups_of, _similar

from tidemark.llm import quality
from tidemark.llm.staging import staged

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def _stages(spark, docs, sf_dir):
    """Input and output of each stage, by name."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = staged(stage(spark, docs, sf_dir), name)
        out[name] = (docs, made)
        docs = made
    return out


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def _kept(rows, pairs):
    """The least of each group."""
    root = _groups_of(pairs, range(len(rows)))
    return [r for i, r in enumerate(rows) if root[i] == i]


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    got = _stages(spark, docs, data)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(got)
    for name in list(got)[:-1]:
        assert got[name][1].columns == docs.columns and got[name][1].count() > 50

    before, after = got["quality_classifier"]
    score = quality.fit(docs, labels, quality.fold_of(F.col("doc_id"), 3) != 1)
    assert sorted(_texts(after), key=str) == sorted([(d, t) for d, t in _texts(before) if score(t) >= 0.5], key=str)

    before, after = got["simhash_near_dedup"]
    rows = sorted(_texts(before))
    pairs = {(i, j) for i, j in _similar([(k, t) for k, (_, t) in enumerate(rows)])}
    empty = [i for i, (_, t) in enumerate(rows) if not (t or "").split()]
    pairs |= {(empty[0], e) for e in empty[1:]}
    assert sorted(_texts(after)) == _kept(rows, pairs)

    before, after = got["suffix_array_dedup"]
    want, seen = {}, set()
    for doc, text in sorted(_texts(before)):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        left = bytes(c for c, m in zip(raw, cover) if not m).decode("utf-8", "ignore")
        want[doc] = (left, len(left))
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == want and any(want[d][0] != t for d, t in _texts(before))

    before, after = got["benchmark_decontamination"]
    hit = brute.hits(_texts(before), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(_texts(after)) == sorted((d, t) for d, t in _texts(before) if not hit[d][4]) and any(h[4] for h in hit.values())

    before, after = got["sentencepiece"]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    rows = {r.doc_id: r for r in after.collect()}
    assert len(rows) == before.count()
    for doc, text in _texts(before):
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert list(rows[doc].ids) == ids and rows[doc].n_tokens == len(ids)
        assert rows[doc].decoded_sha256 == brute.sha(lib.decode(ids).encode())


def test_run_is_the_stages(spark, data):
    got = corpus_pipeline.run(spark, data)
    want = _stages(spark, spark.read.parquet(f"{data}/documents.parquet"), data)["sentencepiece"][1]
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.fixture
def odd_dir(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, empty and long texts, one more column."""
    rows = [(d, t, None if i % 3 else "en", "s" if i % 2 else None, None if i % 4 == 0 else len(t or ""), "x") for i, (d, t) in enumerate(ODD)]
    rows += [(20, "one two three four five six seven eight nine ten", None, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (5, None), (6, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1), (3, None), (77, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_odd_rows(spark, odd_dir):
    """Without usable labels nothing is rejected; of copies the first by doc_id stays, null ids last;
    all null, empty and wordless texts are one group."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    got = _stages(spark, docs, odd_dir)
    assert got["quality_classifier"][1].count() == docs.count() == len(ODD) + 2
    kept = sorted(got["simhash_near_dedup"][1].collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text) for r in kept] == [(1, None), (3, "a b c"), (6, "x " * 5000), (8, dict(ODD)[8]), (20, "one two three four five six seven eight nine ten")]
    cut = {r.doc_id: r.text for r in got["suffix_array_dedup"][1].collect()}
    assert cut[1] is None and cut[3] == "a b c" and cut[6] == "x "
    assert sorted(r.doc_id for r in got["benchmark_decontamination"][1].collect()) == [1, 3, 6, 8]
    out = {r.doc_id: r for r in got["sentencepiece"][1].collect()}
    assert out[1].n_tokens == 2 and list(out[1].ids) == [1, 2] and set(out) == {1, 3, 6, 8}
    assert np.isfinite([r.n_tokens for r in out.values()]).all()


def test_empty_tables(spark, odd_dir, tmp_path):
    empty = tmp_path / "empty"
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
