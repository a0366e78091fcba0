"""Lodestone: product search, entity labelling and text curation as PySpark DataFrame operators."""
