"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and columns that clash with names used inside."""

import pytest
from test_edges import TEXTS

import corpus_pipeline

#: Names that stages use inside, in tables that they join docs with or in columns that they add.
NAMES = [
    "gone", "cdf", "src", "rate", "copy", "copy_", "__mix_src", "__mix_u", "__mix_n", "__mix_key", "__mix_salt", "w", "n", "k", "tie", "score", "kept", "label", "toxic", "hub",
    "member", "rep", "component", "component_id", "node", "key", "keys", "part", "payload", "kind", "items", "item_id", "runs", "start", "ids", "block", "u", "v", "x", "y", "c", "h", "r",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('odd')}"
    rows = [(i, t, None if i == 3 else "en", None if (i or 0) % 3 == 0 else "s", None, *NAMES) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(TEXTS[8][1].split()[95:120])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return docs, d


def keyed(df):
    return sorted(str((r.doc_id, r.text, r.source)) for r in df.select("doc_id", "text", "source").collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, name, stage):
    docs, d = tables
    out = stage(spark, docs, d)
    if name == "token_output":
        assert out.count() == docs.count()
    else:
        assert out.columns == docs.columns
        before, after = keyed(docs), keyed(out)
        assert set(after) <= set(before)
        assert {r.cdf for r in out.select("cdf").collect()} <= {"cdf"} and {r.gone for r in out.select("gone").collect()} <= {"gone"}
    if name in ("toxicity", "near_dedup", "decontamination"):
        assert all(x in after for x in before if x.startswith(("(0, None", "(1, ''")))  # null and empty texts stay
    if name == "near_dedup":
        got = {r.doc_id for r in out.collect()}
        assert {3, 6, 10, None} <= got and not {4, 7, 11} & got
    if name == "decontamination":
        got = {r.doc_id for r in out.collect()}
        assert not {8, 9, None} & got and {6, 10, 14} <= got
    none = stage(spark, docs.limit(0), d)
    assert none.count() == 0
