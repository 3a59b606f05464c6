"""What two runs over the same exports share."""

import os

import pytest

from tributary.operators import staging
from tributary.plans import review_queries
from tributary.plans.source_queries import export_date_orders
from tributary.sources import bridge as b

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


def test_columns_are_profiled_and_their_dates_read_once_for_both_runs(spark, monkeypatch):
    calls = []
    for name in ("export_profiles", "export_date_orders"):
        made = getattr(review_queries, name)
        monkeypatch.setattr(review_queries, name, lambda *a, made=made, name=name: calls.append(name) or made(*a))
    read = staging.column_date_orders
    monkeypatch.setattr(staging, "column_date_orders", lambda df, source, *a: calls.append(source) or read(df, source, *a))
    assert review_queries.item_delta(spark, SF).count() > 0
    assert sorted(calls) == ["export_date_orders", "export_profiles", "src_a", "src_b", "src_c"]


def test_orders_with_rules_added_later_are_those_read_with_rules(spark):
    rules = review_queries.clients_rules(spark)
    later = staging.with_learned_orders(export_date_orders(spark, SF), rules)
    at_once = staging.all_date_orders(b.exports(spark, SF), b.MAPPINGS, b.CONTRACT, rules)
    assert sorted(later.select(at_once.columns).collect()) == sorted(at_once.collect())
    assert {r.decided_by for r in later.collect()} == {"agent", "rule"}
