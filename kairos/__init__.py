"""kairos — panel time-series and interrupted-time-series analytics on Spark.

Every public function takes and returns Spark DataFrames (or Columns) so that
Catalyst sees one declarative plan; Python only runs inside Arrow-batched
``mapInPandas``/``applyInPandas`` tasks where a small dense solve is needed.
"""

__version__ = "0.1.0"
