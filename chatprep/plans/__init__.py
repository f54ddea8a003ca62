"""Registered queries: one Spark plan per operator of the inventory, each with the
equivalent DuckDB SQL where one exists (used as the correctness oracle)."""

from chatprep.plans.registry import QUERIES, ORACLE_SQL, register  # noqa: F401


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from chatprep.plans import training, live, scalars, io  # noqa: F401
