"""Evidence synthesis, cohort analysis and corpus preparation as PySpark DataFrame operators."""
