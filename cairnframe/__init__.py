"""Landscape analytics on Spark: text, tags, joins, funding, networks, taxonomies and viewer documents."""
