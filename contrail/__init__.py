"""contrail: customer-loyalty and churn analytics as Spark jobs.

Typical use::

    from contrail.session import get_spark
    from contrail.plans.layers import Loyalty
    from contrail.operators import kpis

    spark = get_spark()                       # or the cluster's own session
    L = Loyalty(spark, "/path/to/tables")     # lazy layers from the parquet tables
    kpis.executive_kpis(L.customers).show()

Every registered query is also available by name::

    from contrail.plans.registry import all_queries
    all_queries()["revenue_by_tier"](spark, "/path/to/tables")
"""

__version__ = "0.1.0"
