from . import catalogue, further, media, more, parts, scalars, stats  # noqa: F401
from .registry import COVERS, QUERIES, SQL  # noqa: F401
