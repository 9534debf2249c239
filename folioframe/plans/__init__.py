"""Example queries: importing this package fills the registry."""

from . import fields, matching, reading, rollups, sequences, spatial, streams, tables  # noqa: F401
from .demo import ORACLES, QUERIES  # noqa: F401
