"""Retail price comparison on Spark: listings -> catalogue -> search and carts."""
