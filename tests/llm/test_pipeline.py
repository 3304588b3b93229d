"""The pipeline's stages take effect, in order, on all that came before."""

import corpus_pipeline
from webweft.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    docs = table(spark, FOLDER, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema.names == docs.schema.names
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == counts[-1]
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]
