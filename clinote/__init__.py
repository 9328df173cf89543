"""Clinical-note analytics over OMOP-shaped tables, written as Spark DataFrame operators."""
