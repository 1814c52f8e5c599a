"""Average daily quantities of prescribed medicines, computed with Spark."""
