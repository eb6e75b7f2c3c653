"""A record query engine on Spark: a small query language over JSON and Parquet records, lowered to DataFrame expressions."""

__version__ = "0.1.0"


def engine_version() -> str:
    return __version__
