"""sievelake: source-code security analysis as relational dataflow on Spark."""

__version__ = "0.1.0"
