"""gneiss: exploratory analytics expressed as Spark plans."""
