"""Auditing and analysing electronic-health-record tables with Spark."""

from cohortlens.functions import *  # noqa: F403
from cohortlens.functions import __all__ as _functions
from cohortlens.operators import *  # noqa: F403
from cohortlens.operators import __all__ as _operators
from cohortlens.sources import *  # noqa: F403
from cohortlens.sources import __all__ as _sources

__all__ = [*_functions, *_operators, *_sources]
