"""A Spark-native engine for inspection analytics: retrieval, graphs, rules, scoring, KPIs."""
