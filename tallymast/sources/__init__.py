"""Readers and writers."""

from .readers import read_cdr, read_ipdr, read_tower_dump, read_tower_dumps, read_towers
from .writers import consolidate, write_result, write_towers
from .xlsx import read_xlsx

__all__ = ["read_cdr", "read_ipdr", "read_tower_dump", "read_tower_dumps", "read_towers", "read_xlsx",
           "consolidate", "write_result", "write_towers"]
