"""Named functions for SQL: `register_all(spark)` makes them temporary functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, body). Bodies are SQL, so calls are inlined into the plan.
FUNCTIONS = {
    "st_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
    "st_basename": ("path STRING", "STRING", "element_at(split(path, '/'), -1)"),
    "st_unix_path": ("path STRING", "STRING", r"translate(path, '\\', '/')"),
    "st_private_mode": ("mode INT", "BOOLEAN", "(mode & 63) = 0"),
    "st_rrf_k": ("n BIGINT", "INT", "cast(greatest(30, least(120, round(60 * log2(greatest(n, 1)) / log2(1024)))) AS INT)"),
    "st_iso_seconds": ("ts TIMESTAMP", "STRING", "date_format(date_trunc('second', ts), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
    "st_asset_status": ("source STRING, installed STRING", "STRING", "CASE WHEN source IS NULL THEN 'missing' WHEN installed IS NULL THEN 'would-create' WHEN source = installed THEN 'unchanged' ELSE 'would-update' END"),
    "st_host_of": ("url STRING", "STRING", r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)', 1))"),
}


def register_all(spark: SparkSession) -> list[str]:
    """The names registered. Registering again replaces them."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
