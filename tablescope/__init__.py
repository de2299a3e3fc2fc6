"""Analysis tables from flat business tables, on Spark."""
