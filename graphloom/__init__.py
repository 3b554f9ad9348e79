"""A PySpark-native engine for code maps and the relational, graph and text operators they are made of."""
