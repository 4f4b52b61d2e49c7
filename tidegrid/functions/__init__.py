"""Column functions: distances, bucket arithmetic, names and codecs."""

from .buckets import in_range, slot  # noqa: F401
from .codecs import *  # noqa: F403
from .vectors import *  # noqa: F403
