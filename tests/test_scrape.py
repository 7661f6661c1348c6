"""The per-page chain gives what its operators give one by one."""
import __spark_entry__ as E
from pagelake.operators import blocks as B
from pagelake.plans import detectors_q as D


def test_chain_equals_its_parts(spark, sf):
    q = E.queries()
    got = {r.page_id: r for r in q["scrape_pages"](spark, sf).collect()}
    outcome = {r.page_id: r for r in q["fetch_outcome"](spark, sf).collect()}
    assert set(got) == set(outcome) and len({r.outcome for r in outcome.values()}) > 1
    n = {r.page_id: r.block_count for r in B.block_type_counts(B.extract_blocks(D.responses(spark, sf).select("page_id", "html"))).collect()}
    for i, r in got.items():
        ok = outcome[i].outcome == "success"
        assert r.outcome == outcome[i].outcome and r.error == (None if ok else outcome[i].error)
        assert (r.labels is not None) == ok and (r.version_number == 1) == (ok and n.get(i, 0) > 0)
        assert r.blocks_changed == (n[i] if r.version_number else None)
        named = ok and r.labels != "Uncategorized"
        assert r.n_logs == 1 + named and ("Classified as" in r.messages) == named
