"""Every query of the reference's operators by name, and its DuckDB equivalent."""

from . import assembled, building, chunks, cleaning, judging, reshaping, streams, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
