"""Entity resolution and large-scale text preparation on Apache Spark."""
