"""Column -> Column scalar functions (all built-in Spark expressions)."""

from chatprep.functions.text import *  # noqa: F401,F403
from chatprep.functions.records import *  # noqa: F401,F403
from chatprep.functions.chat import *  # noqa: F401,F403
from chatprep.functions.hashing import *  # noqa: F401,F403
