"""Catalog viability analytics on Spark: clean catalogs, match listings, price, cost, score and rank products."""
