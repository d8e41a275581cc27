"""Queries over the driver tables."""


def load():
    """(queries, oracle SQL) of every query module; the sections with the longest SQL come last."""
    from barspark.plans import (  # noqa: F401
        q_bars, q_book, q_detect, q_indicators, q_joins, q_sources, q_strata, q_stream, q_trips, q_universe,
    )
    from barspark.plans.registry import ORACLES, QUERIES

    late = lambda name: (name[0] in "GH") + (name.startswith(("G5", "H"))) + (name == "F13_expansion_tightness")
    names = sorted(QUERIES, key=late)
    return {n: QUERIES[n] for n in names}, {n: ORACLES[n] for n in names if n in ORACLES}
