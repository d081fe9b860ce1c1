"""churnlens: customer-insight analytics expressed as Spark DataFrame plans.

Layout
------
sources/    driver tables -> raw domain inputs, CSV scan, literal config tables, sinks
functions/  reusable Column expressions (lexicons, risk score, vectors, text rules)
operators/  DataFrame -> DataFrame operators (cleanse, features, insights, ...)
plans/      composed jobs (star-schema build, semantic request -> plan)
streaming/  incremental variants driven by Structured Streaming (foreachBatch)
"""

from churnlens.session import get_spark

__all__ = ["get_spark"]
