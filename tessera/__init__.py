"""A Spark-native engine for exploring tables: a small query dialect, table views, profiles and flow analytics."""
