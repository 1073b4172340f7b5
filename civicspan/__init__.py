"""Community-level public-data analysis as Spark DataFrame jobs."""

from civicspan.sources.datasets import Tables, parquet_tables

__all__ = ["Tables", "parquet_tables"]
