"""tessera: distributed tabular analytics and machine learning on Spark DataFrames.

Every operator takes and returns Spark DataFrames (or a fitted ``PipelineModel``).
Statistics are computed as distributed aggregates; only bounded summaries
(one row per column, per class, per partition) ever reach the driver.
"""

__version__ = "0.1.0"
