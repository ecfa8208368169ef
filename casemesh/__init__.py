"""casemesh: citation-graph analytics over large collections of rulings, expressed as Spark plans."""

__version__ = "0.1.0"
