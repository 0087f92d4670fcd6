"""All named queries; importing a module here registers its queries.

The order matters: a module's SQL views build on those of the modules before it.
"""

from . import bars  # noqa: F401
from . import indicators  # noqa: F401
from . import book_profile  # noqa: F401
from . import options  # noqa: F401
from . import flows  # noqa: F401
from . import positioning  # noqa: F401
from . import research  # noqa: F401
from . import regimes  # noqa: F401
from . import joins  # noqa: F401
from . import scoring  # noqa: F401
from . import sources  # noqa: F401
from . import sinks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
