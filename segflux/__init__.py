"""Environmental flux accounting on segment networks, as PySpark DataFrame operators."""

__version__ = "0.1.0"
