"""Table definitions that can be run again and again."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The store's main tables.
TABLES = {
    "source_documents": "document_id string, filename string, document_type string, as_of_date date, file_hash string, page_count int, standard_json string",
    "products": "source_document_id string, product_key string, official_name string, fund_code string, is_retirement boolean, inception_date date",
    "risk_ratings": "source_document_id string, grade int, label string, method string, as_of_date date, evidence_ids array<string>",
    "product_classes": "source_document_id string, class_key string, class_name string, charge_type string, channel string, pension_type string, is_online boolean",
    "fees": "source_document_id string, class_key string, fee_type string, rate decimal(20,8), unit string, as_of_date date, evidence_ids array<string>",
    "performance": "source_document_id string, class_key string, metric string, period string, value double, unit string, as_of_date date, evidence_ids array<string>",
    "evidence": "source_document_id string, evidence_id string, field_path string, page int, section string, source_text string, confidence double",
    "field_status": "source_document_id string, field_path string, status string",
    "extraction_issues": "source_document_id string, issue_type string, field_path string, message string",
}


def ensure_tables(spark: SparkSession, database: str) -> list[str]:
    """Create what is missing, as Parquet tables; what is there stays as it is. Returns the names in order."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in sorted(TABLES.items()):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(TABLES)
