"""statemesh: a PySpark-native engine that turns statements into typed claims and relates them."""

__version__ = "0.1.0"
