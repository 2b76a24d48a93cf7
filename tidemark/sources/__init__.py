"""Sources and sinks: driver tables, fixture views, CSV / split corpora / price files."""

from tidemark.sources.tables import table  # noqa: F401
from tidemark.sources.fixtures import tickets, prices, news, vectors  # noqa: F401
