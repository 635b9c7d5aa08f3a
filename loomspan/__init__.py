"""A Spark-native analytics engine for test design: catalogues, targets, rules, instructions, graphs and trees."""
