"""Column-expression helpers (JVM-side, codegen friendly)."""
from quarry.functions.exprs import *  # noqa: F401,F403
