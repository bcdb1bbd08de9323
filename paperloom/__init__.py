"""paperloom: Spark jobs over scholarly-paper records and the software they name."""
