"""Evidence, catalog, retrieval and rule analytics on PySpark."""
