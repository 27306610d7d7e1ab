"""How iterations run: lineage cuts; and the catalogue of queries."""
