"""candela: market-bar analytics and corpus preparation as Spark DataFrame operators."""

__version__ = "0.1.0"
