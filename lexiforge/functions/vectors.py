"""Half-precision vectors as little-endian bytes, by Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("array<float>")
def decode_f16(raw: pd.Series) -> pd.Series:
    """float16 little-endian bytes to floats; null stays null."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f2").astype(np.float32))


@pandas_udf("binary")
def encode_f16(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f2").tobytes())
