"""How little of the large tables the reports move: what their optimised plans say."""

import pytest

from bizlake.plans import sales, shipping
from bizlake.sources.star import star_tables


def _joins(node):
    """All joins of a logical plan, as (type, condition, node)."""
    own = [(node.joinType().toString(), node.condition().toString(), node)] if node.nodeName() == "Join" else []
    kids = node.children()
    return own + [j for i in range(kids.size()) for j in _joins(kids.apply(i))]


def _plan(spark, report, **given):
    return report(star_tables(spark, "/root/testdata/sf0.001"), **given)._jdf.queryExecution().optimizedPlan()


@pytest.mark.parametrize("strict", [False, True])
def test_changes_meet_lines_before_names(spark, strict):
    on_items = [n for kind, on, n in _joins(_plan(spark, sales.sale_item_status_times, strict=strict)) if kind == "LeftOuter" and on.count("sale_item_id") == 2]
    assert len(on_items) >= 2
    if not strict:  # the lead times of the strict report are pairs, which are joins
        assert not any(_joins(n.right()) for n in on_items)
    names = [n for _, on, n in _joins(_plan(spark, sales.sale_item_status_times, strict=strict)) if "_own_product" in on]
    assert names and all("sale_item_id" in str([on for _, on, _ in _joins(n.left())]) for n in names)


def test_margin_reads_costs_and_designs_of_kept_lines(spark):
    """Lines, costs and designs, beside factors, deliveries and receipts."""
    assert sum(kind == "LeftSemi" for kind, _, _ in _joins(_plan(spark, sales.sales_margin))) >= 9


def test_governance_reads_what_belongs_to_kept_lines(spark):
    """Lines, moves, costs and designs, beside start days."""
    assert sum(kind == "LeftSemi" for kind, _, _ in _joins(_plan(spark, sales.purchase_governance))) >= 5


def test_orders_vs_finance_reads_shipments_of_kept_orders(spark):
    """Shipments, and their items."""
    assert sum(kind == "LeftSemi" for kind, _, _ in _joins(_plan(spark, shipping.orders_vs_finance))) >= 2


def test_detail_reads_shipments_of_kept_orders(spark):
    """The shipments themselves, not only their items."""
    assert sum(kind == "LeftSemi" for kind, _, _ in _joins(_plan(spark, shipping.shipments_detail))) >= 8


def _read_under(node, name, path=()):
    """For each scan that has the column ``name``: what the nearest grouping or join above it is."""
    kids = node.children()
    if not kids.size():
        return [path[-1] if path else ""] if f"{name}#" in node.output().mkString(",") else []
    kind = node.joinType().toString() if node.nodeName() == "Join" else node.nodeName()
    here = (*path, kind) if kind == "Aggregate" or node.nodeName() == "Join" else path
    return [k for i in range(kids.size()) for k in _read_under(kids.apply(i), name, here)]


@pytest.mark.parametrize("report", [sales.sales_margin, sales.purchase_governance])
def test_lines_of_other_orders_are_dropped_before_they_are_grouped(spark, report):
    """Of every scan of the lines, and of the order's status changes, none is grouped or sent on unfiltered."""
    found = _read_under(_plan(spark, report), "l_linenumber")
    assert len(found) >= 8 and set(found) == {"LeftSemi"}
