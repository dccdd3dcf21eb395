"""engramlake: a PySpark-native engine for long-term conversational memory."""

__version__ = "0.1.0"
