import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import SF, edge_frame


def test_stages_on_edges(spark):
    docs = edge_frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()
        assert stage(spark, edge_frame(spark, empty=True), SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    assert 100 < len(rows) < 200 and len(ids) == len(rows)
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")}
