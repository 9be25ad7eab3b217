"""Table schemas, declared so that no reader has to infer one."""

from __future__ import annotations

from pyspark.sql import types as T

from posequarry.fixed_values import LEAD_COLUMNS, SCORE_WEIGHTS

ENERGY_COLUMNS = tuple(
    prefix + term for prefix in ("raw_", "raw_delta_") for term in SCORE_WEIGHTS
)


def pose_schema() -> T.StructType:
    """Pose rows of both stores: keys, lead scores, then 2 x 26 energy terms."""
    fields = [
        T.StructField("dataset", T.StringType()),
        T.StructField("pdb", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("row_idx", T.LongType()),
    ]
    fields += [T.StructField(name, T.FloatType()) for name in (*LEAD_COLUMNS, *ENERGY_COLUMNS)]
    return T.StructType(fields)


AFFINITY_CSV = T.StructType(
    [
        T.StructField("pdb", T.StringType()),
        T.StructField("new_split", T.StringType()),
        T.StructField("kd/ki", T.StringType()),
        T.StructField("covalent", T.BooleanType()),
    ]
)
