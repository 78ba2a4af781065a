"""Readers and writers of graph files."""

from lattica.sources.dispatch import convert, graph_format, read_graph, write_graph
from lattica.sources.results import write_results

__all__ = ["convert", "graph_format", "read_graph", "write_graph", "write_results"]
