"""threadloom: a PySpark-native analytics engine for conversational session memory."""
