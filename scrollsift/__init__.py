"""scrollsift: a PySpark-native analytics engine for terminal-session captures."""

__version__ = "0.1.0"
