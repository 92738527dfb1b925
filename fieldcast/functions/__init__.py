"""Column expressions (JVM-side built-ins only; no Python UDFs)."""

from fieldcast.functions.scalar import *  # noqa: F401,F403
