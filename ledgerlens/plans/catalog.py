"""Imports every query module so their ``register`` calls run."""

from . import q_match  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_quality  # noqa: F401
from . import q_business  # noqa: F401
from . import q_consolidate  # noqa: F401
from . import q_tests  # noqa: F401
from . import q_cells  # noqa: F401
from . import q_summaries  # noqa: F401
from . import q_mapping  # noqa: F401
from . import q_io  # noqa: F401
from . import q_extra  # noqa: F401
