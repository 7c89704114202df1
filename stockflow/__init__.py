"""Inventory, order and shipment analytics as PySpark DataFrame operators."""
