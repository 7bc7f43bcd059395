"""Registered queries over the driver tables, each beside the SQL that gives the same rows.

The tables stand in for the domain's: ``events`` is the area fact (user = area,
event type = constellation, value = area, id = run), ``embeddings`` are 8 x 8
frames or 64-band pixels, ``orders`` is a long series, ``lineitem`` a wide fact.
"""

from tarn.queries import cubes, engine, relations, scenes, series
from tarn.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cubes", "engine", "relations", "scenes", "series"]
