"""Registered queries. The catalog comes first, whichever module is asked for: it loads the others in their order."""

from lineweave.plans import catalog  # noqa: F401
