"""A T-SQL analytics engine on Spark: queries are lowered to Spark SQL, and Catalyst does the rest."""

from .engine import Answer, Engine, ResultSet, Session
from .errors import TsqlError

__all__ = ["Answer", "Engine", "ResultSet", "Session", "TsqlError"]
