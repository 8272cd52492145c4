"""strandlake: genomic reads, features, coverage, variants and sequences as Spark DataFrames."""

__version__ = "0.1.0"
