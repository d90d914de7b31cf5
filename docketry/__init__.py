"""docketry: a PySpark-native search, ranking and analytics engine for decision corpora."""
