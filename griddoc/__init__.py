"""Document-to-table analytics on PySpark: text matching, catalogue maintenance, quantities and training-text preparation."""
