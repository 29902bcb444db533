"""Text-to-record extraction on Spark: tokens, centroids, lookups and their evaluation as DataFrame operations."""

from .operators.lookup import build_lookup, lookup, lookup_one
from .plans.extractor import CentroidModel, Extractor, NeuralModel, fit

__all__ = ["CentroidModel", "Extractor", "NeuralModel", "build_lookup", "fit", "lookup", "lookup_one"]
__version__ = "0.1.0"
