import sys
from pathlib import Path

import corpus_pipeline
from bedledger.llm import pii
from helpers import SF, needs_tables, odd_rows, documents, table
from test_decontaminate import plain
from test_packing import check_packing
from test_simhash import plain_components, plain_fingerprint

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@needs_tables
def test_each_stage_like_plain_python(spark, tmp_path):
    docs = table(spark, "documents")
    columns, items = docs.columns, [tuple(r) for r in table(spark, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "packing":
            check_packing(rows, before)
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        if name == "toxicity":
            assert set(after) < set(before) and len(after) > 0.8 * len(before)
        elif name == "near_duplicates":
            assert set(after) == set(plain_components({i: plain_fingerprint(t) for i, t in before.items()}).values())
        elif name == "decontamination":
            assert set(after) == {r[0] for r in plain(list(before.items()), items) if not r[5]}
        elif name == "personal_data":
            assert set(after) == set(before) and not any(pii.strict_spans(t or "") for t in after.values())
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        if name != "personal_data":
            assert all(after[i] == before[i] for i in after)
        before = after


@needs_tables
def test_run_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and {r.doc_id for r in found} <= {i for i, _ in rows}


def test_stages_are_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
