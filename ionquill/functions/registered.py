"""Functions for SQL text: expressions that Catalyst inlines, so they cost what the built-in ones do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ionquill.constants import PROTON

ARRAY = "ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
FUNCTIONS = {
    "array_dot": (f"a {ARRAY}, b {ARRAY}", "DOUBLE", _DOT.format(a="a", b="b")),
    "array_norm": (f"a {ARRAY}", "DOUBLE", f"sqrt({_DOT.format(a='a', b='a')})"),
    "spectral_angle": (
        f"a {ARRAY}, b {ARRAY}", "DOUBLE",
        "CASE WHEN array_norm(a) * array_norm(b) > 0 THEN 1 - 2 * acos(greatest(-1D, least(1D, array_dot(a, b) / (array_norm(a) * array_norm(b))))) / pi() ELSE 0D END",
    ),
    "fragment_mz": ("mass DOUBLE, charge INT, loss DOUBLE", "DOUBLE", f"(mass + charge * {PROTON}D - loss) / charge"),
    "fold_il": ("sequence STRING", "STRING", "translate(sequence, 'I', 'L')"),
    "nearest_peak": (f"mzs {ARRAY}, target DOUBLE", "STRUCT<distance: DOUBLE, index: INT>", "array_min(transform(mzs, (m, i) -> named_struct('distance', abs(m - target), 'index', i)))"),
    "bind_level": ("rank DOUBLE", "STRING", "CASE WHEN rank < 0.5 THEN '<=SB' WHEN rank < 2 THEN '<=WB' ELSE '' END"),
    "confidence": ("error DOUBLE", "DOUBLE", "floor((1 - error) * 10000) / 100"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them for this session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
