"""Imports every plan module, so that the registry is full."""

from casebook.plans import (  # noqa: F401
    answers, arrivals, counts, files, filters, joins, learned, order, samples, texts,
)
from casebook.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
