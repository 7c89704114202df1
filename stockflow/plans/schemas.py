"""Table schemas and value lists of the domain model."""

from pyspark.sql import types as T

# The enumerations of the row models.
CATEGORIES = ["electronics", "clothing", "food_beverage", "pharmaceuticals", "automotive", "furniture", "raw_materials", "other"]
LOCATIONS = ["northeast", "southeast", "midwest", "southwest", "west", "northwest"]
ORDER_STATUSES = ["pending", "confirmed", "processing", "shipped", "delivered", "cancelled", "returned", "refunded"]
SEVERITIES = ["info", "warning", "critical", "emergency"]
CHECK_TYPES = ["completeness", "uniqueness", "validity", "consistency"]


FACTOR = "STRUCT<factor: STRING, value: DOUBLE, expected: DOUBLE, deviation_sigma: DOUBLE, impact: STRING>"

# Table schemas as DDL text, which readers and createDataFrame take directly.
TABLES = {
    "products": (
        "product_id STRING NOT NULL, sku STRING NOT NULL, name STRING NOT NULL, category STRING NOT NULL,"
        " unit_price DECIMAL(12,2) NOT NULL, unit_cost DECIMAL(12,2) NOT NULL, lead_time_days INT, minimum_order_quantity INT,"
        " reorder_point INT, safety_stock_level INT, weight_kg DOUBLE, dimensions_cm MAP<STRING, DOUBLE>, is_active BOOLEAN,"
        " created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "warehouses": (
        "warehouse_id STRING NOT NULL, location STRING NOT NULL, name STRING NOT NULL, address STRING, capacity_sqft DOUBLE,"
        " storage_cost_per_unit DECIMAL(10,4), is_active BOOLEAN, created_at TIMESTAMP"
    ),
    "inventory_snapshots": (
        "snapshot_id STRING NOT NULL, product_id STRING NOT NULL, warehouse_id STRING NOT NULL, quantity_on_hand INT NOT NULL,"
        " quantity_allocated INT, quantity_in_transit INT, quantity_backordered INT, last_restock_date DATE,"
        " next_expected_delivery DATE, days_of_supply DOUBLE, turnover_rate DOUBLE, carrying_cost_per_unit DECIMAL(10,4),"
        " recorded_at TIMESTAMP"
    ),
    "sales_transactions": (
        "transaction_id STRING NOT NULL, product_id STRING NOT NULL, customer_id STRING, quantity INT NOT NULL,"
        " unit_price DECIMAL(12,2) NOT NULL, total_amount DECIMAL(14,2) NOT NULL, discount_amount DECIMAL(14,2), order_date TIMESTAMP,"
        " ship_date TIMESTAMP, delivery_date TIMESTAMP, warehouse_id STRING, order_status STRING, payment_method STRING,"
        " is_b2b BOOLEAN, channel STRING, currency STRING, created_at TIMESTAMP"
    ),
    "supplier_performance": (
        "supplier_id STRING NOT NULL, supplier_name STRING NOT NULL, on_time_delivery_rate DOUBLE NOT NULL,"
        " quality_acceptance_rate DOUBLE NOT NULL, average_lead_time_days DOUBLE NOT NULL, lead_time_variance DOUBLE NOT NULL,"
        " cost_competitiveness_score DOUBLE NOT NULL, responsiveness_score DOUBLE NOT NULL, total_orders INT NOT NULL,"
        " total_value DECIMAL(14,2) NOT NULL, last_evaluated TIMESTAMP"
    ),
    "anomaly_records": (
        "metric_name STRING, entity_id STRING, timestamp TIMESTAMP, actual_value DOUBLE, expected_value DOUBLE,"
        f" deviation_percentage DOUBLE, z_score DOUBLE, severity STRING, algorithm_used STRING, confidence_score DOUBLE,"
        f" contributing_factors ARRAY<{FACTOR}>, recommendation STRING, is_acknowledged BOOLEAN, is_resolved BOOLEAN"
    ),
    "forecast_records": (
        "metric_name STRING, entity_id STRING, forecast_date DATE, predicted_value DOUBLE, lower_bound_80 DOUBLE,"
        " upper_bound_80 DOUBLE, lower_bound_95 DOUBLE, upper_bound_95 DOUBLE, trend_direction STRING,"
        " seasonality_strength DOUBLE, model_mape DOUBLE, generated_at TIMESTAMP"
    ),
    "etl_logs": (
        "pipeline_name STRING NOT NULL, run_id STRING NOT NULL, status STRING NOT NULL, records_processed BIGINT,"
        " records_failed BIGINT, records_skipped BIGINT, error_message STRING, started_at TIMESTAMP NOT NULL,"
        " completed_at TIMESTAMP, duration_seconds DOUBLE, run_metadata MAP<STRING, STRING>"
    ),
    "data_quality_checks": (
        "table_name STRING NOT NULL, check_name STRING NOT NULL, check_type STRING NOT NULL, passed BOOLEAN NOT NULL,"
        " total_records BIGINT, failed_records BIGINT, failure_rate DOUBLE, details MAP<STRING, STRING>, checked_at TIMESTAMP"
    ),
}


def table_schema(name: str) -> T.StructType:
    """The schema of a table as a StructType (needs a session)."""
    return T.StructType.fromDDL(TABLES[name])
