"""furrow: agro-climate analytics as Spark DataFrame operators."""

from furrow.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
