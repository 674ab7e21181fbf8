"""Operators by family.  Each is ``DataFrame(s) -> DataFrame``, lazy and deterministic."""
