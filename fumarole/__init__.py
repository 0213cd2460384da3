"""fumarole: company emissions analytics as PySpark DataFrame jobs."""

from fumarole.session import build_session, materialise, small_table

__all__ = ["build_session", "materialise", "small_table"]
__version__ = "0.1.0"
