"""Named queries over the test tables, and the SQL each must agree with."""
QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, sf_dir) -> DataFrame under `name`, with its oracle SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load():
    """Import the modules that register queries."""
    from . import models, profile, relational, storage, texts  # noqa: F401


load()
