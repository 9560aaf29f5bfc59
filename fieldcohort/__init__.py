"""fieldcohort: Spark-native analytics over cohorts of displacement fields and clinical tables."""
