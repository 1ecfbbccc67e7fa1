from levelbook.sources.schemas import KEYS, SCHEMAS
from levelbook.sources.session import tuned
from levelbook.sources.tables import JdbcSplit, TableSet
from levelbook.sources.keys import check_keys  # noqa: I001 - needs the tables

__all__ = ["KEYS", "SCHEMAS", "JdbcSplit", "TableSet", "check_keys", "tuned"]
