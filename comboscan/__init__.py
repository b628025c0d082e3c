"""comboscan: Spark-native search over AND-combinations of bar predicates."""
