"""The report's Arrow UDFs share a Python worker; elements that no column asks for stay in it."""

from codedelta.operators import elements as E
from codedelta.operators import mapping as M
from codedelta.operators import report as REP
from tests.test_batches import _evaluations, _pairs


def test_positions_need_one_evaluation_and_equal_those_with_elements(spark):
    pairs = _pairs(spark)
    assert _evaluations(M.changed_positions(pairs)) == 1
    assert _evaluations(M.element_changes(pairs)) == 1
    a = {r.pair_id: r["_ch"] for r in M.changed_positions(pairs).collect()}
    b = {r.pair_id: r["_ch"] for r in M.element_changes(pairs).collect()}
    assert a == b and all(c["added"] == [200] for c in a.values())
    assert M.element_changes(pairs).first()["_re"][200]["name"] == "h()"
    assert len(E.LANGUAGES) == 5


def test_the_report_needs_one_evaluation(spark):
    report = REP.analyze(spark, _pairs(spark)).select("pair_id", "overall_score", "tokens_added", "nodes_added", "lines_added")
    assert _evaluations(report) == 1
    row = report.first()
    assert (row.lines_added, row.nodes_added, row.tokens_added) == (1, 1, 2)
