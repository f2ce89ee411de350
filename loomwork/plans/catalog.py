"""Imports every module that registers queries."""

from loomwork.plans import queries_axis, queries_cube, queries_dynamics, queries_files, queries_misc, queries_models, queries_more, queries_net, queries_null, queries_pairs, queries_panel, queries_regions, queries_sequence, queries_space, queries_summaries, queries_windows  # noqa: F401
from loomwork.plans.registry import ORACLES, QUERIES  # noqa: F401
