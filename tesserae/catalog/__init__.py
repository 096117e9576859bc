from . import accounts, blocks, damage, library, records, runs, scores  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
