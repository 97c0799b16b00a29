"""hearth: housing-market analytics as Spark DataFrame, SQL and ML jobs.

Layout
------
sources/    readers, writers, schemas and the driver-table fixtures
functions/  column expressions (cleaning, rounding, index formulas)
operators/  DataFrame -> DataFrame building blocks (reshape, county joins,
            distributed positions, banded neighbour search, top-k)
plans/      end-to-end jobs: ETL builds, the feature mart, the query
            surface (explore, dashboard, recommend, valuation) and ML
streaming/  incremental ingestion of monthly panel files
"""

__version__ = "0.1.0"
