"""panelforge: cross-sectional panel analytics as plain Spark DataFrame jobs.

Sub-packages
------------
sources    table loading, CSV/Parquet I/O, stage materialisation, raw -> panel
functions  Column builders: row-history indicators, exact distributed medians
operators  cleaning, group statistics, imputation, splits, metrics, models
plans      end-to-end flows (benchmark, processing) and the query catalogue used
           by ``__spark_entry__``
llm        operators for training-data pipelines (documents, pages, embeddings)
"""

__version__ = "0.1.0"
