"""woonvonk: property-listing analytics as set-based PySpark jobs."""
