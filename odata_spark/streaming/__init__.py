"""Row-wise options over streams: the reference language has no windows or state, so a stream takes
$filter, $search and $select, and $apply with groupby and aggregate under complete output mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..edm import Registry
from ..errors import Unsupported
from ..parser import parse_query_options
from ..plans import plan


def stream_query(registry: Registry, set_name: str, options: dict[str, str]) -> DataFrame:
    """The set's source must be a readStream DataFrame."""
    query = parse_query_options(options)
    if query.orderby or query.top is not None or query.skip or query.expand:
        raise Unsupported("a stream takes $filter, $search, $select and $apply")
    return plan(registry, registry.spec(set_name), query).df
