"""Column types of the relations. ``label`` names the snapshot or corpus member a row belongs to."""

from __future__ import annotations

from pyspark.sql import types as T

SCOPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())]))


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "p": SCOPE, "c": T.DecimalType(20, 0), "t": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


FUNCTIONS = _struct("name:s file:s module_path:s scope_path:p line:l lines:l params:l nesting_depth:l cyclomatic:l mutable_bindings:l internal_state_cardinality_log2:d assertions:l meaningful_assertions:l is_test:b is_pub:b")
TYPES = _struct("name:s file:s module_path:s scope_path:p line:l kind:s bool_fields:l option_fields:l total_fields:l state_cardinality:c state_cardinality_log2:d")
FINGERPRINTS = _struct("name:s file:s line:l shape:t scope_path:p")
OBSERVATIONS = _struct("kind:s file:s line:l name:s detail:s cohort:s size_hint:d raw:d normalized:d calibrated_score:d scope_path:p")
HEATMAP = _struct("file:s line:l function_name:s dimension:s responsibility:d detail:s scope_path:p")
CALL_EDGES = _struct("caller_module:s caller_file:s callee_module:s callee_file:s caller_function:s caller_line:l")
TYPE_CARDINALITIES = _struct("file:s module_path:s name:s cardinality_log2:d")
FUNCTION_CARDINALITIES = _struct("file:s module_path:s name:s line:l internal_state_cardinality_log2:d")
SEMANTIC = T.StructType(
    [
        T.StructField("type_cardinalities", T.ArrayType(TYPE_CARDINALITIES)),
        T.StructField("function_cardinalities", T.ArrayType(FUNCTION_CARDINALITIES)),
        T.StructField("call_edges", T.ArrayType(CALL_EDGES)),
    ]
)
