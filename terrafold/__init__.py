"""A PySpark-native engine for species observations and environmental data."""
