"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import q_panel, q_windows, q_scaling, q_resample, q_fidelity, q_utility, q_classify, q_explore, q_contract  # noqa: F401
from .inputs import ORACLES, QUERIES
