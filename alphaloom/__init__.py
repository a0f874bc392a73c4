"""PySpark-native portfolio analytics and training-data preparation."""
