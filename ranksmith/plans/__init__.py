"""Named queries over the driver's tables; importing registers them all."""

from . import (  # noqa: F401
    clean_queries,
    dense_queries,
    eval_queries,
    grade_queries,
    io_queries,
    mining,
    profile_queries,
    relate_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLE, QUERIES  # noqa: F401
