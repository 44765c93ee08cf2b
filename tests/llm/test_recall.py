"""Toxic documents found among those that nothing was learned from, by language."""

from collections import Counter

from grainflow.llm import queries
from grainflow.llm.common import table

SF = "/root/testdata/sf0.1"


def test_toxic_documents_held_out_are_found_in_every_language(spark):
    scored = queries.op1_toxicity(spark, SF).where("held_out").select("doc_id", "predicted")
    known = table(spark, SF, "labels").select("doc_id", "toxic").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = scored.join(known, "doc_id").collect()
    toxic, found = (Counter(r.lang for r in rows if r.toxic == 1 and (r.predicted == 1 or every)) for every in (True, False))
    assert len(toxic) == 4 and all(found[lang] >= 0.9 * n for lang, n in toxic.items())
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * sum(r.toxic == 0 for r in rows)
