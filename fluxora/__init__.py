"""fluxora: territorial labour-movement analytics as Spark DataFrame jobs."""
