"""Graph analytics over data-transformation projects, expressed as Spark DataFrame programs."""

__version__ = "0.1.0"
