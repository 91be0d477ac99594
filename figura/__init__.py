"""figura: Spark-native corpus assembly, feature extraction, classification
and evaluation for verb-metaphor datasets.

Every operator takes and returns DataFrames; see ``figura.operators``.
"""

__version__ = "0.1.0"
