"""codeloom - code knowledge graphs as Spark DataFrames."""

from codeloom.graph import Graph

__all__ = ["Graph"]
