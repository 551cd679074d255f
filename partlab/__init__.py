"""Partitioning of weighted points, graphs, meshes and number sets on Spark."""
