"""Column expressions shared by the operators (keys, cleaning, dates, rules)."""

from churnlens.functions.keys import *  # noqa: F401,F403
from churnlens.functions.rules import *  # noqa: F401,F403
