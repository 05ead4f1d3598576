"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .licenses import op4_licenses
from .media import op7_media
from .mixing import op2_mixing
from .neardup import op3_neardup
from .outliers import op10_outliers
from .packing import op9_packing
from .secrets import op1_secrets
from .sql import MIXING, NEARDUP
from .surrogates import op5_surrogates
from .toxicity import op6_toxicity
from .weak_labels import op8_quality

QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_neardup, op4_licenses, op5_surrogates, op6_toxicity, op7_media, op8_quality, op9_packing, op10_outliers)}
ORACLE_SQL = {"op2_mixing": MIXING, "op3_neardup": NEARDUP}
