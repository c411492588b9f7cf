"""The engine's functions for SQL text: `register(spark)` makes them callable in spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body. Bodies are SQL, so calls are inlined into the plan and stay in generated code.
FUNCTIONS = {
    "normal_id": ("x STRING", "STRING", r"lower(regexp_replace(regexp_replace(x, '[^A-Za-z0-9]+', '_'), '^_+|_+$', ''))"),
    "label_norm": ("x STRING", "STRING", r"nullif(lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '')), '')"),
    "label_tokens": ("x STRING", "ARRAY<STRING>", r"filter(transform(split(regexp_replace(x, '(\\p{Ll})(\\p{Lu})', '$1 $2'), '[^\\p{L}\\p{N}]+'), t -> lower(t)), t -> octet_length(t) > 1)"),
    "token_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END"),
    "logical_key": ("path STRING, label STRING", "STRING", r"concat(substring_index(path, '/', -2), '::', regexp_replace(label, '\\(\\)$', ''))"),
    "line_number": ("location STRING", "INT", r"try_cast(regexp_extract(location, '^L*(\\d+)', 1) AS INT)"),
    "reinforced": ("confidence DOUBLE, times INT", "DOUBLE", "1 - (1 - confidence) * power(0.8D, times)"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v)) ELSE 0D END"),
    "recency_points": ("now BIGINT, at BIGINT", "DOUBLE", "CASE WHEN at > 0 AND at <= now THEN CASE WHEN floor((now - at) / 86400) < 7 THEN 10D WHEN floor((now - at) / 86400) < 30 THEN 5D WHEN floor((now - at) / 86400) < 90 THEN 0D WHEN floor((now - at) / 86400) < 180 THEN -5D ELSE -10D END ELSE 0D END"),
    "path_form": ("path STRING", "STRING", r"regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '')"),
}


def register(spark: SparkSession) -> None:
    for name, (given, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
