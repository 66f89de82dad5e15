"""meshspark: geometry, graph and process-monitoring analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
