"""Column expressions: everything here stays inside the JVM."""

from .scalars import *  # noqa: F403
