"""All registered queries."""

from windowlab.plans import engineering, grids, inference, modelling, reshaping, scoring, splitting, transferring  # noqa: F401
from windowlab.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
