"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.plans import delivery_queries, entity_queries, planted_queries, report_queries, review_queries, source_queries  # noqa: F401
from tributary.plans import oracle as o
from tributary.plans.registry import query
from tributary.sources import bridge as b


@query("canonical_records", o.with_blocks(f"""
SELECT canonical_key, {', '.join(b.CONTRACT.names)}, row_count, outcome, array_to_string(errors, ',') AS errors,
       array_to_string(list_filter([{', '.join(f"'{f}=' || {f}__source" for f in sorted(b.CONTRACT.names))}], lambda x: x IS NOT NULL), ',') AS provenance
FROM canonical""", "canonical"))
def canonical_records(spark, sf):
    checked = b.canonical(b.merged(spark, sf)[2])
    origin = F.array_sort(F.transform(F.map_entries("provenance"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return checked.select("canonical_key", *b.CONTRACT.names, "row_count", "outcome",
                          F.array_join("errors", ",").alias("errors"), F.array_join(origin, ",").alias("provenance"))
