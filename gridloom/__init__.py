"""PySpark-native engine for iterated neighbourhood queries on toroidal grids."""
