"""All registered queries.  Importing this module registers every query."""

from __future__ import annotations

from tablelab.plans import (q_cluster_score, q_eda, q_ml, q_preprocess, q_profile, q_report,  # noqa: F401
                            q_sources, q_text)
from tablelab.plans.registry import REGISTRY, Entry  # noqa: F401
