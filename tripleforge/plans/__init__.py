"""Queries over the synthetic tables, one module for each family of operators."""

from . import registry  # noqa: F401  isort: skip
from . import assemblies, baselines, building, connectors, datasets, evaluation, graphs, language, pairs, perturbation, ranking  # noqa: F401
