"""A PySpark-native engine for auditable data pipelines: ingestion control, data-quality gates,
change-data-capture history, star schemas, reconciliation and training-data preparation."""
