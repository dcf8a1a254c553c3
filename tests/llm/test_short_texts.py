"""The pipeline's language stage on texts too short for the bar on the cosine."""

import corpus_pipeline as cp
from driftwood.llm.common import table


def test_short_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    far = spark.createDataFrame([(-1, "Πολλά κείμενα σε άλλη γλώσσα χωρίς ετικέτα. " * 9, None), (-2, "12 .. 34", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(far, allowMissingColumns=True)
    gone = {r.doc_id for r in both.select("doc_id").subtract(cp.keep_languages(spark, both, sf).select("doc_id")).collect()}
    assert not gone & {8352, 4616, 5375, 3217, 9118} and {-1, -2} <= gone
