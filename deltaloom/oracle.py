"""DuckDB SQL per query."""

from deltaloom import queries  # noqa: F401
from deltaloom.registry import ORACLE_SQL  # noqa: F401
