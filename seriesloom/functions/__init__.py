from seriesloom.functions.clean import (  # noqa: F401
    clip,
    finite_or_zero,
    nan_to_null,
    sentinel_to_null,
    to_number,
    to_time,
)
from seriesloom.functions.domain import *  # noqa: F401,F403
from seriesloom.functions.timeaxis import *  # noqa: F401,F403
